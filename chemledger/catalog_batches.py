"""Queries over batches that name one entity several times."""

from __future__ import annotations

from pyspark.sql import functions as F

from chemledger.operators import registration, transitions
from chemledger.queryset import query

PRODUCTS = "p.product_id, p.product_name, p.manufacturer_product_code, p.manufacturer_id, p.use_description, p.use_restriction, {} AS usage_status, p.waste_type, p.waste_code"
HISTORY_ID = "SHA256(CAST(a.product_id AS VARCHAR) || '/' || CAST(a.request_id AS VARCHAR)) AS history_id"
HISTORY_ROW = f"SELECT {HISTORY_ID}, a.product_id, {{}} AS usage_status, p.use_description, p.use_restriction, p.waste_type, p.waste_code, a.at AS changed_at"

REVISIONS = """plain AS (SELECT r.*, CASE WHEN r.product_id NOT IN (SELECT product_id FROM b_products) THEN 'PRODUCT_NOT_FOUND' WHEN TRIM(r.relative_path) = '' THEN 'SOURCE_PATH_REQUIRED' WHEN r.sds_id IN (SELECT sds_id FROM b_sds_documents) THEN 'SDS_ID_TAKEN' END AS bad FROM b_many_revisions r),
checked AS (SELECT plain.*, CASE WHEN bad IS NOT NULL THEN bad WHEN ROW_NUMBER() OVER (PARTITION BY sds_id, bad IS NULL ORDER BY seq, request_id) > 1 THEN 'SDS_ID_TAKEN' END AS why FROM plain),
accepted AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq DESC, request_id DESC) AS back FROM checked WHERE why IS NULL)"""


def revised(reg):
    return transitions.register_revisions(reg.products, reg.sds_documents, reg.many_revisions)


@query("folded_revisions_documents", f"""WITH {REVISIONS} SELECT sds_id, product_id, original_filename, relative_path, issue_date, revision, CASE WHEN document_status = 'CURRENT' AND product_id IN (SELECT product_id FROM accepted) THEN 'ARCHIVED' ELSE document_status END AS document_status, registered_at, file_status FROM b_sds_documents
 UNION ALL SELECT sds_id, product_id, original_filename, relative_path, issue_date, revision, CASE WHEN back = 1 THEN 'CURRENT' ELSE 'ARCHIVED' END, accepted.at, 'AVAILABLE' FROM accepted""")
def folded_revisions_documents(reg):
    return revised(reg).tables["sds_documents"]


@query("folded_revisions_products", f"WITH {REVISIONS} SELECT {PRODUCTS.format(chr(67) + 'ASE WHEN p.product_id IN (SELECT product_id FROM accepted) THEN ' + repr('PENDING_APPROVAL') + ' ELSE p.usage_status END')} FROM b_products p")
def folded_revisions_products(reg):
    return revised(reg).tables["products"]


@query("folded_revisions_history", f"WITH {REVISIONS} {HISTORY_ROW.format(repr('PENDING_APPROVAL'))} FROM accepted a JOIN b_products p ON p.product_id = a.product_id")
def folded_revisions_history(reg):
    return revised(reg).history


@query("folded_revisions_rejected", f"WITH {REVISIONS} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def folded_revisions_rejected(reg):
    return revised(reg).rejected


DECIDED = """checked AS (SELECT r.*, CASE WHEN TRIM(r.original_filename) = '' THEN 'ORIGINAL_FILENAME_REQUIRED' WHEN p.product_id IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN s.sds_id IS NULL THEN 'SDS_NOT_FOUND' WHEN s.product_id <> r.product_id THEN 'SDS_OF_ANOTHER_PRODUCT'
 WHEN s.document_status <> 'CURRENT' THEN 'SDS_NOT_CURRENT' WHEN r.sds_id NOT IN (SELECT sds_id FROM b_safety_profiles) THEN 'SAFETY_DATA_MISSING' WHEN p.use_description IS NULL OR p.use_restriction IS NULL THEN 'USE_DATA_MISSING' END AS why
 FROM b_many_decisions r LEFT JOIN b_products p ON p.product_id = r.product_id LEFT JOIN b_sds_documents s ON s.sds_id = r.sds_id),
accepted AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sds_id ORDER BY seq DESC, request_id DESC) AS back, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq DESC, request_id DESC) AS product_back FROM checked WHERE why IS NULL)"""


def decided(reg):
    return transitions.register_decisions(reg.products, reg.sds_documents, reg.safety_profiles, reg.bhp_decisions, reg.decision_evidence, reg.many_decisions)


@query("folded_decisions", f"""WITH {DECIDED} SELECT decision_id, product_id, sds_id, decision_status, notes, registered_at, CASE WHEN record_status = 'CURRENT' AND sds_id IN (SELECT sds_id FROM accepted) THEN 'SUPERSEDED' ELSE record_status END AS record_status, evidence_id FROM b_bhp_decisions
 UNION ALL SELECT request_id, product_id, sds_id, decision_status, notes, accepted.at, CASE WHEN back = 1 THEN 'CURRENT' ELSE 'SUPERSEDED' END, request_id FROM accepted""")
def folded_decisions(reg):
    return decided(reg).tables["bhp_decisions"]


@query("folded_decisions_products", f"WITH {DECIDED} SELECT {PRODUCTS.format('CASE a.decision_status WHEN ' + repr('APPROVED') + ' THEN ' + repr('ACTIVE') + ' WHEN ' + repr('REJECTED') + ' THEN ' + repr('REJECTED') + ' ELSE p.usage_status END')} FROM b_products p LEFT JOIN accepted a ON a.product_id = p.product_id AND a.product_back = 1")
def folded_decisions_products(reg):
    return decided(reg).tables["products"]


@query("folded_decisions_rejected", f"WITH {DECIDED} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def folded_decisions_rejected(reg):
    return decided(reg).rejected


# One row a product and request, each looking at what the row before has left: withdrawn and restored documents, the current one, and the product's status.
WITHDRAWN = """RECURSIVE asked AS (SELECT r.*, p.usage_status AS old_status, t.product_id AS target_product, t.document_status AS target_status, b.product_id AS restored_product, b.document_status AS restored_status,
  r.sds_id IN (SELECT invalidated_sds_id FROM b_sds_invalidation) AS done, TRIM(reason_text) <> '' AS told,
  expected_status IN ('CURRENT', 'ARCHIVED') AND (mode = 'ARCHIVED_ONLY') = (expected_status = 'ARCHIVED') AND (mode = 'RESTORE_ARCHIVED') = (restored_sds_id IS NOT NULL) AND NOT COALESCE(restored_sds_id = r.sds_id, FALSE) AS fits,
  ROW_NUMBER() OVER (PARTITION BY r.product_id ORDER BY seq, request_id) AS k, (SELECT MIN(sds_id) FROM b_sds_documents c WHERE c.product_id = r.product_id AND c.document_status = 'CURRENT') AS cur
 FROM b_many_withdrawals r LEFT JOIN b_products p ON p.product_id = r.product_id LEFT JOIN b_sds_documents t ON t.sds_id = r.sds_id LEFT JOIN b_sds_documents b ON b.sds_id = r.restored_sds_id),
steps AS (
 SELECT product_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_id, MIN(cur) AS cur, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS back, MIN(old_status) AS status, CAST(NULL AS VARCHAR) AS why, FALSE AS waits FROM asked GROUP BY product_id
 UNION ALL
 SELECT product_id, k, request_id, CASE WHEN why IS NOT NULL THEN cur WHEN restored_sds_id IS NOT NULL THEN restored_sds_id WHEN cur = sds_id THEN NULL ELSE cur END, CASE WHEN why IS NULL THEN LIST_APPEND(gone, sds_id) ELSE gone END,
  CASE WHEN why IS NULL AND restored_sds_id IS NOT NULL THEN LIST_APPEND(back, restored_sds_id) ELSE back END, CASE WHEN why IS NULL AND expected_status = 'CURRENT' THEN 'PENDING_APPROVAL' ELSE status END, why,
  why IS NULL AND expected_status = 'CURRENT' AND status <> 'PENDING_APPROVAL'
 FROM (SELECT a.product_id, a.k, a.request_id, s.cur, s.gone, s.back, s.status, a.sds_id, a.restored_sds_id, a.expected_status, CASE WHEN NOT a.told THEN 'REASON_REQUIRED' WHEN a.fits IS NOT TRUE THEN 'MODE_DOES_NOT_FIT' WHEN a.old_status IS NULL THEN 'STALE_PRODUCT'
   WHEN a.target_product IS DISTINCT FROM a.product_id OR CASE WHEN LIST_CONTAINS(s.gone, a.sds_id) THEN 'INVALIDATED' WHEN LIST_CONTAINS(s.back, a.sds_id) THEN 'CURRENT' ELSE a.target_status END <> a.expected_status THEN 'STALE_DOCUMENT'
   WHEN s.cur IS DISTINCT FROM a.expected_current_sds_id THEN 'STALE_CURRENT' WHEN a.done THEN 'ALREADY_INVALIDATED'
   WHEN a.mode = 'RESTORE_ARCHIVED' AND (a.restored_product IS DISTINCT FROM a.product_id OR CASE WHEN LIST_CONTAINS(s.gone, a.restored_sds_id) THEN 'INVALIDATED' WHEN LIST_CONTAINS(s.back, a.restored_sds_id) THEN 'CURRENT' ELSE a.restored_status END <> 'ARCHIVED') THEN 'STALE_RESTORED' END AS why
  FROM steps s JOIN asked a ON a.product_id = s.product_id AND a.k = s.k + 1) t),
accepted AS (SELECT r.*, s.waits FROM steps s JOIN b_many_withdrawals r ON r.request_id = s.request_id WHERE s.why IS NULL)"""


def withdrawn(reg):
    return transitions.invalidate(reg.products, reg.sds_documents, reg.bhp_decisions, reg.sds_invalidation, reg.many_withdrawals)


@query("folded_withdrawals_documents", f"""WITH {WITHDRAWN} SELECT sds_id, product_id, original_filename, relative_path, issue_date, revision, CASE WHEN sds_id IN (SELECT sds_id FROM accepted) THEN 'INVALIDATED' WHEN sds_id IN (SELECT restored_sds_id FROM accepted WHERE restored_sds_id IS NOT NULL) THEN 'CURRENT' ELSE document_status END AS document_status,
 registered_at, file_status FROM b_sds_documents""")
def folded_withdrawals_documents(reg):
    return withdrawn(reg).tables["sds_documents"]


@query("folded_withdrawals_decisions", f"""WITH {WITHDRAWN} SELECT decision_id, product_id, sds_id, decision_status, notes, registered_at, CASE WHEN record_status = 'CURRENT' AND sds_id IN (SELECT sds_id FROM accepted WHERE expected_status = 'CURRENT' UNION SELECT restored_sds_id FROM accepted WHERE expected_status = 'CURRENT' AND restored_sds_id IS NOT NULL)
 THEN 'SUPERSEDED' ELSE record_status END AS record_status, evidence_id FROM b_bhp_decisions""")
def folded_withdrawals_decisions(reg):
    return withdrawn(reg).tables["bhp_decisions"]


@query("folded_withdrawals_history", f"WITH {WITHDRAWN} {HISTORY_ROW.format(repr('PENDING_APPROVAL'))} FROM accepted a JOIN b_products p ON p.product_id = a.product_id WHERE a.waits")
def folded_withdrawals_history(reg):
    return withdrawn(reg).history


@query("folded_withdrawals_rejected", f"WITH {WITHDRAWN} SELECT request_id, why AS reason FROM steps WHERE why IS NOT NULL")
def folded_withdrawals_rejected(reg):
    return withdrawn(reg).rejected


ADMINISTERED = "last AS (SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq DESC, request_id DESC) AS back FROM b_many_administrative r) t WHERE back = 1)"
ADMINISTRATIVE = ("use_description", "use_restriction", "waste_type", "waste_code")


@query("folded_administrative_products", f"WITH {ADMINISTERED} SELECT p.product_id, p.product_name, p.manufacturer_product_code, p.manufacturer_id, p.usage_status, {', '.join(f'CASE WHEN r.request_id IS NULL THEN p.{c} ELSE r.{c} END AS {c}' for c in ADMINISTRATIVE)} FROM b_products p LEFT JOIN last r ON r.product_id = p.product_id")
def folded_administrative_products(reg):
    return transitions.update_administrative(reg.products, reg.many_administrative).tables["products"]


@query("folded_administrative_history", f"SELECT {HISTORY_ID}, a.product_id, p.usage_status, {', '.join(f'a.{c}' for c in ADMINISTRATIVE)}, a.at AS changed_at FROM b_many_administrative a JOIN b_products p ON p.product_id = a.product_id")
def folded_administrative_history(reg):
    return transitions.update_administrative(reg.products, reg.many_administrative).history


CORRECTED = """RECURSIVE makers AS (SELECT manufacturer_name, COUNT(*) AS n, MIN(manufacturer_id) AS id FROM b_manufacturers_twice GROUP BY manufacturer_name),
asked AS (SELECT r.*, m.n, COALESCE(CAST(m.id AS VARCHAR), SHA256(r.manufacturer_name)) AS maker, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq, request_id) AS k FROM b_many_corrections r LEFT JOIN makers m ON m.manufacturer_name = r.manufacturer_name),
steps AS (
 SELECT product_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_id, product_name AS name, manufacturer_product_code AS code, CAST(manufacturer_id AS VARCHAR) AS maker, CAST(NULL AS VARCHAR) AS old_name, CAST(NULL AS VARCHAR) AS old_code, CAST(NULL AS VARCHAR) AS old_maker, 'START' AS why FROM b_products
 UNION ALL
 SELECT product_id, k, request_id, CASE WHEN why IS NULL THEN product_name ELSE name END, CASE WHEN why IS NULL THEN new_code ELSE code END, CASE WHEN why IS NULL THEN new_maker ELSE maker END, name, code, maker, why
 FROM (SELECT a.product_id, a.k, a.request_id, a.product_name, a.code AS new_code, a.maker AS new_maker, s.name, s.code, s.maker, CASE WHEN s.code IS NULL AND a.code IS NOT NULL THEN 'CODE_COMPLETION_IS_SEPARATE' WHEN a.n > 1 THEN 'MANUFACTURER_AMBIGUOUS'
   WHEN a.product_name = s.name AND a.code IS NOT DISTINCT FROM s.code AND a.maker = s.maker THEN 'NO_CHANGE' END AS why FROM steps s JOIN asked a ON a.product_id = s.product_id AND a.k = s.k + 1) t)"""


def corrected(reg):
    return registration.correct_identities(reg.products, reg.manufacturers_twice, reg.many_corrections)


@query("folded_corrections_products", f"WITH {CORRECTED} SELECT product_id, MAX_BY(name, k) AS product_name, CASE WHEN MAX_BY(code IS NULL, k) THEN NULL ELSE MAX_BY(code, CASE WHEN code IS NOT NULL THEN k END) END AS manufacturer_product_code, MAX_BY(maker, k) AS manufacturer_id FROM steps GROUP BY product_id")
def folded_corrections_products(reg):
    return corrected(reg).tables["products"].select("product_id", "product_name", "manufacturer_product_code", "manufacturer_id")


@query("folded_corrections_audit", f"WITH {CORRECTED} SELECT s.request_id AS change_id, s.product_id, 'CORRECTION' AS change_kind, old_name AS old_product_name, name AS new_product_name, old_code AS old_manufacturer_product_code, s.code AS new_manufacturer_product_code, old_maker AS old_manufacturer_id, maker AS new_manufacturer_id, r.at AS changed_at FROM steps s JOIN b_many_corrections r ON r.request_id = s.request_id WHERE why IS NULL")
def folded_corrections_audit(reg):
    return corrected(reg).history


@query("folded_corrections_rejected", f"WITH {CORRECTED} SELECT request_id, why AS reason FROM steps WHERE k > 0 AND why IS NOT NULL")
def folded_corrections_rejected(reg):
    return corrected(reg).rejected


BOTH = CORRECTED.replace("b_many_corrections", "sound").replace("RECURSIVE makers", """RECURSIVE plain AS (SELECT r.*, CASE WHEN TRIM(r.relative_path) = '' THEN 'SOURCE_PATH_REQUIRED' WHEN r.sds_id IN (SELECT sds_id FROM b_sds_documents) THEN 'SDS_ID_TAKEN' END AS bad FROM b_many_both r),
judged AS (SELECT plain.*, CASE WHEN bad IS NOT NULL THEN bad WHEN ROW_NUMBER() OVER (PARTITION BY sds_id, bad IS NULL ORDER BY seq, request_id) > 1 THEN 'SDS_ID_TAKEN' END AS unsound FROM plain),
sound AS (SELECT * FROM judged WHERE unsound IS NULL),
makers""") + """, done AS (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.product_id ORDER BY r.seq DESC, r.request_id DESC) AS back FROM sound r JOIN steps s ON s.request_id = r.request_id WHERE s.why IS NULL)"""


def corrected_and_registered(reg):
    return registration.correct_and_register(reg.products, reg.manufacturers_twice, reg.sds_documents, reg.many_both)


@query("corrected_revisions_documents", f"""WITH {BOTH} SELECT sds_id, product_id, CASE WHEN document_status = 'CURRENT' AND product_id IN (SELECT product_id FROM done) THEN 'ARCHIVED' ELSE document_status END AS document_status FROM b_sds_documents
 UNION ALL SELECT sds_id, product_id, CASE WHEN back = 1 THEN 'CURRENT' ELSE 'ARCHIVED' END FROM done""")
def corrected_revisions_documents(reg):
    return corrected_and_registered(reg).tables["sds_documents"].select("sds_id", "product_id", "document_status")


@query("corrected_revisions_products", f"""WITH {BOTH} SELECT p.product_id, l.product_name, p.usage_status FROM (SELECT product_id, CASE WHEN product_id IN (SELECT product_id FROM done) THEN 'PENDING_APPROVAL' ELSE usage_status END AS usage_status FROM b_products) p
 JOIN (SELECT product_id, MAX_BY(name, k) AS product_name FROM steps GROUP BY product_id) l ON l.product_id = p.product_id""")
def corrected_revisions_products(reg):
    return corrected_and_registered(reg).tables["products"].select("product_id", "product_name", "usage_status")


@query("corrected_revisions_rejected", f"WITH {BOTH} SELECT request_id, unsound AS reason FROM judged WHERE unsound IS NOT NULL UNION ALL SELECT request_id, why FROM steps WHERE k > 0 AND why IS NOT NULL")
def corrected_revisions_rejected(reg):
    return corrected_and_registered(reg).rejected


def quantity_sql(new: bool) -> str:
    late = "WHEN t.product_id IS NOT NULL THEN 'ALREADY_ASSIGNED'" if new else "WHEN t.product_id IS NULL THEN 'ASSIGNMENT_NOT_FOUND'"
    place = "WHEN l.location_id IS NULL THEN 'LOCATION_NOT_FOUND' WHEN l.status <> 'ACTIVE' THEN 'LOCATION_INACTIVE'" if new else ""
    first = "CASE WHEN bad IS NULL AND ROW_NUMBER() OVER (PARTITION BY product_id, location_id, bad IS NULL ORDER BY seq, request_id) > 1 THEN 'ALREADY_ASSIGNED' ELSE bad END" if new else "bad"
    return f"""plain AS (SELECT r.*, CASE {place} WHEN r.peak_quantity_value < 0 THEN 'QUANTITY_NOT_ALLOWED' WHEN r.peak_quantity_unit_id NOT IN (SELECT unit_id FROM b_units_some WHERE status = 'ACTIVE') THEN 'UNIT_INACTIVE' {late} END AS bad
 FROM b_many_quantities r LEFT JOIN b_usage_locations l ON l.location_id = r.location_id LEFT JOIN (SELECT DISTINCT product_id, location_id FROM b_product_usage_locations) t ON t.product_id = r.product_id AND t.location_id = r.location_id),
checked AS (SELECT plain.*, {first} AS why FROM plain),
last AS (SELECT * FROM (SELECT checked.*, ROW_NUMBER() OVER (PARTITION BY product_id, location_id ORDER BY seq DESC, request_id DESC) AS back FROM checked WHERE why IS NULL) t WHERE back = 1)"""


def stocked(reg, new: bool):
    return registration.set_quantities(reg.product_usage_locations, reg.usage_locations, reg.units_some, reg.many_quantities, new)


Q = ", ".join(registration.QUANTITIES)


@query("folded_quantities_assigned", f"WITH {quantity_sql(True)} SELECT product_id, location_id, {Q} FROM b_product_usage_locations UNION ALL SELECT product_id, location_id, {Q} FROM last")
def folded_quantities_assigned(reg):
    return stocked(reg, True).tables["product_usage_locations"].select("product_id", "location_id", *registration.QUANTITIES)


@query("folded_quantities_assigned_rejected", f"WITH {quantity_sql(True)} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def folded_quantities_assigned_rejected(reg):
    return stocked(reg, True).rejected


@query("folded_quantities_updated", f"WITH {quantity_sql(False)} SELECT p.product_id, p.location_id, {', '.join(f'CASE WHEN c.request_id IS NULL THEN p.{q} ELSE c.{q} END AS {q}' for q in registration.QUANTITIES)} FROM b_product_usage_locations p LEFT JOIN last c ON c.product_id = p.product_id AND c.location_id = p.location_id")
def folded_quantities_updated(reg):
    return stocked(reg, False).tables["product_usage_locations"].select("product_id", "location_id", *registration.QUANTITIES)


@query("folded_observations", """WITH asked AS (SELECT review_item_id, location_id, CAST(seq AS INTEGER) AS seq, CAST(CASE WHEN location_id % 11 = seq THEN -1 ELSE seq * 2 END AS DECIMAL(18,6)) AS value FROM b_physical_review_items i JOIN b_physical_reviews r ON r.review_id = i.review_id, (SELECT UNNEST([1, 2, 3]) AS seq) s WHERE r.status = 'DRAFT')
 SELECT i.review_item_id, COALESCE((SELECT MAX_BY(value, seq) FROM asked a WHERE a.review_item_id = i.review_item_id AND value >= 0), i.observed_quantity) AS observed_quantity FROM b_physical_review_items i""")
def folded_observations(reg):
    value = F.when(F.col("location_id") % 11 == F.col("seq"), -1).otherwise(F.col("seq") * 2).cast("decimal(18,6)")
    asked = reg.physical_review_items.select("review_item_id", "location_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    asked = asked.select(F.concat_ws("-", "review_item_id", "seq").alias("request_id"), "seq", "review_item_id", value.alias("observed_quantity"))
    return transitions.record_observed(reg.physical_reviews, reg.physical_review_items, asked).tables["physical_review_items"].select("review_item_id", "observed_quantity")
