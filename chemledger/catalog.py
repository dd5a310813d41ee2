"""Registry queries and the same results as SQL over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemledger import catalog_batches, catalog_sheets, schemas  # noqa: F401 - the first two register their queries
from chemledger.fixtures.bindings import Registry, oracle
from chemledger.functions import text
from chemledger.operators import approvals, audits, batch, corrections, dashboard, evidence, extraction, facts, history, identity, locations, registration, registry_reads, reviews, supervisory, transitions
from chemledger.queryset import QUERIES, SQL, joined, query

HERE = facts.Filters(dt.date(1994, 1, 1), dt.date(1996, 12, 31), location_id=5)
HERE_OR_NOWHERE = facts.Filters(dt.date(1994, 1, 1), dt.date(1996, 12, 31), location_id=5, include_no_active_location=True)
APPROVED = facts.Filters(dt.date(1994, 1, 1), dt.date(1996, 12, 31), sds_status="CURRENT_PRESENT", bhp_status="APPROVED")


# Product facts written once, as the read model defines them: one row for each product, CURRENT tested in the join conditions.
FACTS = """
base AS (
 SELECT p.product_id, p.product_name, p.usage_status, m.manufacturer_id, m.manufacturer_name,
  s.sds_id AS current_sds_id, s.original_filename AS current_sds_original_filename, s.relative_path AS current_sds_relative_path,
  s.registered_at AS current_sds_registered_at, s.revision AS current_sds_revision, s.issue_date AS current_sds_issue_date,
  d.decision_id AS current_bhp_decision_id, e.evidence_id AS current_evidence_id,
  e.original_filename AS current_evidence_original_filename, e.relative_path AS current_evidence_relative_path,
  COALESCE((SELECT COUNT(DISTINCT a.location_id) FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id
   WHERE l.status = 'ACTIVE' AND a.product_id = p.product_id), 0) AS active_location_count,
  (SELECT MAX(x.registered_at) FROM b_sds_documents x WHERE x.product_id = p.product_id) AS latest_sds_registered_at,
  CASE WHEN s.sds_id IS NULL THEN 'NOT_APPLICABLE_NO_CURRENT_SDS' WHEN d.decision_id IS NULL THEN 'NO_DECISION' ELSE d.decision_status END AS bhp_category
 FROM b_products p JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id
 LEFT JOIN b_sds_documents s ON s.product_id = p.product_id AND s.document_status = 'CURRENT'
 LEFT JOIN b_bhp_decisions d ON d.sds_id = s.sds_id AND d.record_status = 'CURRENT'
 LEFT JOIN b_decision_evidence e ON e.evidence_id = d.evidence_id),
states AS (
 SELECT base.*,
  CASE WHEN current_sds_id IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM b_file_listing f WHERE f.root = 'sds' AND f.relative_path = current_sds_relative_path)
   THEN 'AVAILABLE' ELSE 'MISSING' END AS current_sds_availability,
  CASE WHEN current_bhp_decision_id IS NULL THEN NULL
   WHEN NOT EXISTS (SELECT 1 FROM b_file_listing f WHERE f.root = 'evidence' AND f.relative_path = current_evidence_relative_path) THEN 'MISSING'
   WHEN EXISTS (SELECT 1 FROM b_file_listing f WHERE f.root = 'evidence' AND f.relative_path = current_evidence_relative_path AND f.length > 0) THEN 'AVAILABLE'
   ELSE 'CHECK_FAILED' END AS current_evidence_availability
 FROM base),
flags AS (
 SELECT states.*, current_sds_id IS NULL AS r1, bhp_category = 'NO_DECISION' AS r2,
  usage_status IN ('ACTIVE', 'PENDING_APPROVAL') AND active_location_count = 0 AS r3,
  COALESCE(current_sds_availability = 'MISSING', FALSE) OR COALESCE(current_evidence_availability = 'MISSING', FALSE) AS r4
 FROM states)"""


def scoped(where: str) -> str:
    return f"WITH {FACTS.strip()}, scoped AS (SELECT * FROM flags WHERE {where})"


LOCATED = "EXISTS (SELECT 1 FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id WHERE l.status = 'ACTIVE' AND a.location_id = 5 AND a.product_id = flags.product_id)"
ALL = scoped("TRUE")
COUNT = "CAST(COUNT(CASE WHEN {} THEN 1 END) AS BIGINT)"
ATTENTION = COUNT.format("r1 OR r2 OR r3 OR r4")


@query("manufacturer_summary", f"""{ALL}
SELECT manufacturer_name, manufacturer_id, COUNT(*) AS products_count, {COUNT.format('current_sds_id IS NOT NULL')} AS current_sds_count,
 {COUNT.format("bhp_category = 'APPROVED'")} AS bhp_approved_count, {ATTENTION} AS attention_products_count,
 MAX(latest_sds_registered_at) AS latest_sds_registered_at FROM scoped GROUP BY manufacturer_name, manufacturer_id""")
def manufacturer_summary(reg):
    return dashboard.ordered_summary(dashboard.manufacturer_summary(facts.dashboard_facts(reg)))


@query("manufacturers_by_products", f"{ALL} SELECT manufacturer_name, manufacturer_id, COUNT(*) AS products_count FROM scoped GROUP BY manufacturer_name, manufacturer_id")
def manufacturers_by_products(reg):
    return dashboard.manufacturers_by_products(facts.product_facts(reg))


@query("product_facts", f"""{ALL} SELECT product_id, product_name, usage_status, manufacturer_id, manufacturer_name, current_sds_id, current_sds_original_filename,
 current_sds_relative_path, current_sds_registered_at, current_sds_revision, current_sds_issue_date, current_bhp_decision_id, current_evidence_id,
 current_evidence_original_filename, current_evidence_relative_path, active_location_count, latest_sds_registered_at, bhp_category FROM scoped""")
def product_facts(reg):
    return facts.ordered_facts(facts.product_facts(reg))


@query("file_states", f"{ALL} SELECT product_id, current_sds_availability, current_evidence_availability FROM scoped")
def file_states(reg):
    return facts.dashboard_facts(reg).select("product_id", "current_sds_availability", "current_evidence_availability")


KPI = f"""SELECT COUNT(*) AS products_total, {COUNT.format('current_sds_id IS NOT NULL')} AS current_sds_count,
 {COUNT.format("bhp_category = 'APPROVED'")} AS bhp_approved_count, {ATTENTION} AS attention_products_count, """


@query("dashboard_kpi", f"{ALL} {KPI} (SELECT COUNT(*) FROM b_usage_locations WHERE status = 'ACTIVE') AS active_locations_count FROM scoped")
def dashboard_kpi(reg):
    return dashboard.kpi_row(reg, facts.dashboard_facts(reg))


@query("dashboard_kpi_by_location", f"""{scoped(f'({LOCATED}) OR active_location_count = 0')} {KPI} (SELECT COUNT(DISTINCT l.location_id) FROM b_usage_locations l
 JOIN b_product_usage_locations a ON a.location_id = l.location_id WHERE l.status = 'ACTIVE' AND l.location_id = 5 AND a.product_id IN (SELECT product_id FROM scoped)) AS active_locations_count FROM scoped""")
def dashboard_kpi_by_location(reg):
    return dashboard.kpi_row(reg, facts.dashboard_facts(reg, HERE_OR_NOWHERE), HERE_OR_NOWHERE)


@query("dashboard_kpi_approved", f"""{scoped("current_sds_id IS NOT NULL AND bhp_category = 'APPROVED'")} {KPI} (SELECT COUNT(DISTINCT l.location_id) FROM b_usage_locations l
 JOIN b_product_usage_locations a ON a.location_id = l.location_id WHERE l.status = 'ACTIVE' AND a.product_id IN (SELECT product_id FROM scoped)) AS active_locations_count FROM scoped""")
def dashboard_kpi_approved(reg):
    return dashboard.kpi_row(reg, facts.dashboard_facts(reg, APPROVED), APPROVED)


@query("bhp_distribution", f"""{ALL} SELECT {COUNT.format("bhp_category = 'APPROVED'")} AS approved, {COUNT.format("bhp_category = 'REJECTED'")} AS rejected,
 {COUNT.format("bhp_category = 'NO_DECISION'")} AS no_decision FROM scoped""")
def bhp_distribution(reg):
    return dashboard.bhp_distribution(facts.product_facts(reg))


@query("bhp_distribution_series", f"""{ALL} SELECT 'approved' AS series, {COUNT.format("bhp_category = 'APPROVED'")} AS value FROM scoped
 UNION ALL SELECT 'rejected', {COUNT.format("bhp_category = 'REJECTED'")} FROM scoped UNION ALL SELECT 'no_decision', {COUNT.format("bhp_category = 'NO_DECISION'")} FROM scoped""")
def bhp_distribution_series(reg):
    return dashboard.bhp_distribution_series(facts.product_facts(reg))


REASONS = dict(zip(("r1", "r2", "r3", "r4"), dashboard.ATTENTION_REASONS, strict=True))


@query("attention_by_reason", ALL + " UNION ALL ".join(f" SELECT '{name}' AS reason, {COUNT.format(r)} AS affected_products FROM scoped" for r, name in REASONS.items()))
def attention_by_reason(reg):
    return dashboard.attention_by_reason(facts.dashboard_facts(reg))


@query("attention_products", ALL + " UNION ALL ".join(f" SELECT '{name}' AS reason, product_id FROM scoped WHERE {r}" for r, name in REASONS.items()))
def attention_products(reg):
    return dashboard.attention_products(facts.dashboard_facts(reg))


TREND = """seq AS (SELECT product_id, registered_at, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY registered_at, sds_id) AS n FROM b_sds_documents
 WHERE product_id IN (SELECT product_id FROM scoped)), trend AS (SELECT CAST(DATE_TRUNC('month', registered_at) AS DATE) AS period_start,
 CAST(COUNT(CASE WHEN n = 1 THEN 1 END) AS BIGINT) AS new_sds_count, CAST(COUNT(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS updated_sds_count FROM seq
 WHERE CAST(registered_at AS DATE) BETWEEN DATE '{0}' AND DATE '{1}' GROUP BY 1)"""


@query("sds_trend_monthly", f"{ALL}, {TREND.format('1900-01-01', '2999-12-31')} SELECT * FROM trend")
def sds_trend_monthly(reg):
    return dashboard.sds_trend(reg.sds_documents, facts.product_facts(reg).select("product_id"))


@query("sds_trend_by_location", f"{scoped(LOCATED)}, {TREND.format('1994-01-01', '1996-12-31')} SELECT * FROM trend")
def sds_trend_by_location(reg):
    return dashboard.sds_trend(reg.sds_documents, facts.scope(facts.product_facts(reg), reg, HERE).select("product_id"), HERE)


@query("sds_trend_series", f"{ALL}, {TREND.format('1900-01-01', '2999-12-31')} SELECT period_start, 'new_sds_count' AS series, new_sds_count AS value FROM trend UNION ALL SELECT period_start, 'updated_sds_count', updated_sds_count FROM trend")
def sds_trend_series(reg):
    return dashboard.trend_series(dashboard.sds_trend(reg.sds_documents, facts.product_facts(reg).select("product_id")))


@query("registration_sequence", "SELECT product_id, sds_id, registered_at, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY registered_at, sds_id) AS sequence FROM b_sds_documents")
def registration_sequence(reg):
    return dashboard.registration_sequence(reg.sds_documents)


@query("facts_scoped_by_location", f"{scoped(f'({LOCATED}) OR active_location_count = 0')} SELECT product_id, active_location_count FROM scoped")
def facts_scoped_by_location(reg):
    return facts.scope(facts.product_facts(reg), reg, HERE_OR_NOWHERE).select("product_id", "active_location_count")


@query("facts_without_location", f"{scoped('active_location_count = 0')} SELECT product_id FROM scoped")
def facts_without_location(reg):
    return facts.scope(facts.product_facts(reg), reg, facts.Filters(dt.date(1994, 1, 1), dt.date(1996, 12, 31), include_no_active_location=True)).select("product_id")


@query("active_location_count", "SELECT COUNT(*) AS active_locations_count FROM b_usage_locations WHERE status = 'ACTIVE'")
def active_location_count(reg):
    return dashboard.active_location_count(reg)


@query("duplicate_facts", f"{ALL} SELECT product_id, COUNT(*) AS fact_rows FROM scoped GROUP BY product_id HAVING COUNT(*) > 1")
def duplicate_facts(reg):
    return facts.duplicate_facts(facts.product_facts(reg))


@query("filter_manufacturers", "SELECT manufacturer_id, manufacturer_name FROM b_manufacturers")
def filter_manufacturers(reg):
    return dashboard.filter_manufacturers(reg)


@query("filter_locations", "SELECT location_id, location_name FROM b_usage_locations WHERE status = 'ACTIVE'")
def filter_locations(reg):
    return dashboard.filter_locations(reg)


LATEST = """latest AS (SELECT * FROM (SELECT i.product_id, i.location_id, r.review_id, r.review_date, i.observed_quantity, i.baseline_max_quantity, i.baseline_unit_id,
 i.observed_quantity - i.baseline_max_quantity AS difference, ROW_NUMBER() OVER (PARTITION BY i.product_id, i.location_id
 ORDER BY r.review_date DESC NULLS FIRST, r.finalized_at DESC NULLS FIRST, r.review_id DESC) AS n
 FROM b_physical_review_items i JOIN b_physical_reviews r ON r.review_id = i.review_id WHERE r.status = 'FINAL') t WHERE n = 1)"""


@query("latest_final_review", f"WITH {LATEST} SELECT product_id, location_id, review_id, review_date, observed_quantity, baseline_max_quantity, baseline_unit_id, difference FROM latest")
def latest_final_review(reg):
    return reviews.latest_final_items(reg)


DETAIL = f""", {LATEST}, detail AS (SELECT s.product_id, s.product_name, s.manufacturer_name, a.location_id, l.location_name, a.peak_quantity_value, pu.code AS peak_quantity_unit_code,
 a.monthly_consumption_value, mu.code AS monthly_consumption_unit_code, s.usage_status, s.current_sds_revision, s.current_sds_issue_date, s.bhp_category,
 r.observed_quantity AS review_observed_quantity, r.difference AS review_difference, ru.code AS review_unit_code, s.active_location_count
 FROM scoped s LEFT JOIN (b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id AND l.status = 'ACTIVE') ON a.product_id = s.product_id
 LEFT JOIN b_units pu ON pu.unit_id = a.peak_quantity_unit_id LEFT JOIN b_units mu ON mu.unit_id = a.monthly_consumption_unit_id
 LEFT JOIN latest r ON r.product_id = a.product_id AND r.location_id = a.location_id LEFT JOIN b_units ru ON ru.unit_id = r.baseline_unit_id)"""
DETAIL_COLUMNS = """product_id, product_name, manufacturer_name, location_id, location_name, peak_quantity_value, peak_quantity_unit_code, monthly_consumption_value,
 monthly_consumption_unit_code, usage_status, current_sds_revision, current_sds_issue_date, bhp_category, review_observed_quantity, review_difference, review_unit_code"""


@query("product_location_detail", f"{ALL}{DETAIL} SELECT {DETAIL_COLUMNS} FROM detail")
def product_location_detail(reg):
    return locations.ordered_detail(locations.product_location_detail(reg))


@query("product_location_detail_filtered", f"{scoped(f'({LOCATED}) OR active_location_count = 0')}{DETAIL} SELECT {DETAIL_COLUMNS} FROM detail WHERE location_id = 5 OR (location_id IS NULL AND active_location_count = 0)")
def product_location_detail_filtered(reg):
    return locations.product_location_detail(reg, HERE_OR_NOWHERE)


def plain(value: str) -> str:
    return f"REGEXP_REPLACE(CAST({value} AS VARCHAR), '\\.?0+$', '')"


def cases(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


def amount(value: str, unit: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '—' ELSE TRIM({plain(value)} || ' ' || COALESCE({unit}, '')) END"


@query("product_location_labels", f"""{ALL}{DETAIL} SELECT product_id, location_id, COALESCE(NULLIF(location_name, ''), 'Brak') AS location_label,
 {amount('peak_quantity_value', 'peak_quantity_unit_code')} AS peak_label, {amount('review_observed_quantity', 'review_unit_code')} AS observed_label,
 CASE WHEN review_difference > 0 THEN '+' ELSE '' END || {amount('review_difference', 'review_unit_code')} AS difference_label,
 {amount('monthly_consumption_value', 'monthly_consumption_unit_code')} AS monthly_label, {cases('usage_status', locations.labels.STATUS_WORDS)} AS status_label,
 CASE WHEN current_sds_revision IS NULL AND current_sds_issue_date IS NULL THEN '—' ELSE CONCAT_WS(' · ', 'Rewizja ' || current_sds_revision, CAST(current_sds_issue_date AS VARCHAR)) END AS sds_label,
 {cases('bhp_category', locations.labels.CATEGORY_WORDS)} AS bhp_label FROM detail""")
def product_location_labels(reg):
    return locations.detail_labels(locations.product_location_detail(reg))


@query("review_list", "SELECT review_id, review_date, status, created_at, finalized_at FROM b_physical_reviews")
def review_list(reg):
    return reviews.review_list(reg.physical_reviews)


REVIEW = """SELECT i.review_id, i.review_item_id, i.product_id, p.product_name, i.location_id, l.location_code, l.location_name, i.baseline_max_quantity, u.code AS unit_code,
 i.observed_quantity, i.observed_quantity - i.baseline_max_quantity AS difference FROM b_physical_review_items i JOIN b_products p ON p.product_id = i.product_id
 JOIN b_usage_locations l ON l.location_id = i.location_id JOIN b_units u ON u.unit_id = i.baseline_unit_id"""


@query("review_details", REVIEW)
def review_details(reg):
    return reviews.ordered_review_details(reviews.review_details(reg))


@query("review_totals", f"SELECT review_id, COUNT(*) AS items, COUNT(observed_quantity) AS observed, COUNT(*) - COUNT(observed_quantity) AS unobserved FROM ({REVIEW}) d GROUP BY review_id")
def review_totals(reg):
    return reviews.review_totals(reviews.review_details(reg))


@query("review_population", "SELECT a.product_id, a.location_id, a.peak_quantity_value AS baseline_max_quantity, a.peak_quantity_unit_id AS baseline_unit_id FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id WHERE l.status = 'ACTIVE'")
def review_population(reg):
    return reviews.review_population(reg)


SUPERVISED = """WITH facts AS (SELECT p.product_id, p.product_name, p.manufacturer_product_code, p.usage_status, m.manufacturer_name, s.sds_id AS current_sds_id,
 s.issue_date AS current_sds_issue_date, s.revision AS current_sds_revision, d.decision_id AS current_bhp_decision_id, d.decision_status AS current_bhp_decision_status, d.notes AS current_bhp_notes,
 COALESCE(s.relative_path IN (SELECT relative_path FROM b_file_listing WHERE root = 'sds'), FALSE) AS current_sds_file_available,
 COALESCE(e.relative_path IN (SELECT relative_path FROM b_file_listing WHERE root = 'evidence'), FALSE) AS current_bhp_evidence_available
 FROM b_products p JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id LEFT JOIN b_sds_documents s ON s.product_id = p.product_id AND s.document_status = 'CURRENT'
 LEFT JOIN b_bhp_decisions d ON d.sds_id = s.sds_id AND d.record_status = 'CURRENT' LEFT JOIN b_decision_evidence e ON e.evidence_id = d.evidence_id),
located AS (SELECT a.product_id, l.location_name AS usage_location_name, a.peak_quantity_value, pu.code AS peak_quantity_unit, a.monthly_consumption_value, mu.code AS monthly_consumption_unit
 FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id AND l.status = 'ACTIVE' JOIN b_units pu ON pu.unit_id = a.peak_quantity_unit_id
 LEFT JOIN b_units mu ON mu.unit_id = a.monthly_consumption_unit_id),
supervised AS (SELECT f.*, l.usage_location_name, l.peak_quantity_value, l.peak_quantity_unit, l.monthly_consumption_value, l.monthly_consumption_unit,
 CONCAT_WS('; ', CASE WHEN usage_status = 'PENDING_APPROVAL' THEN 'BRAK DECYZJI BHP' END, CASE WHEN usage_status = 'REJECTED' THEN 'PRODUKT ODRZUCONY' END,
 CASE WHEN current_sds_id IS NULL THEN 'BRAK CURRENT SDS' WHEN NOT current_sds_file_available THEN 'BRAK PLIKU SDS' END,
 CASE WHEN l.usage_location_name IS NULL THEN 'BRAK MIEJSCA STOSOWANIA' END,
 CASE WHEN current_bhp_decision_id IS NOT NULL AND NOT current_bhp_evidence_available THEN 'BRAK PLIKU DOWODU BHP' END) AS action_reasons
 FROM facts f LEFT JOIN located l ON l.product_id = f.product_id)"""
SHOWN = ["product_id", "product_name", "manufacturer_name", "usage_status", "current_sds_id", "current_bhp_decision_id", "current_bhp_decision_status", "current_sds_file_available",
         "current_bhp_evidence_available", "usage_location_name", "peak_quantity_value", "peak_quantity_unit", "monthly_consumption_value", "monthly_consumption_unit", "action_reasons", "requires_action"]
SHOWN_SQL = f"SELECT {', '.join(SHOWN[:-1])}, action_reasons <> '' AS requires_action FROM supervised"


@query("supervisory_rows", f"{SUPERVISED} {SHOWN_SQL}")
def supervisory_rows(reg):
    return supervisory.ordered_rows(supervisory.supervisory_rows(reg)).withColumns(joined("action_reasons")).select(*SHOWN)


@query("supervisory_filtered", f"{SUPERVISED} {SHOWN_SQL} WHERE CONTAINS(LOWER(product_name), '00') AND action_reasons <> '' AND usage_location_name IS NULL AND current_bhp_decision_status IS NULL")
def supervisory_filtered(reg):
    choice = supervisory.Choice(search="00", only_action=True, location=supervisory.NONE, decision=supervisory.NONE)
    return supervisory.filtered(supervisory.supervisory_rows(reg), choice).withColumns(joined("action_reasons")).select(*SHOWN)


@query("supervisory_labels", f"""{SUPERVISED} SELECT product_id, product_name, manufacturer_name, COALESCE(NULLIF(manufacturer_product_code, ''), '—') AS code_label, usage_status, usage_location_name,
 COALESCE(NULLIF(usage_location_name, ''), 'Brak') AS location_label, COALESCE({plain('peak_quantity_value')}, '—') AS peak_label, COALESCE(peak_quantity_unit, '—') AS peak_unit_label,
 COALESCE({plain('monthly_consumption_value')}, '—') AS monthly_label, COALESCE(monthly_consumption_unit, '—') AS monthly_unit_label,
 CASE WHEN current_sds_id IS NULL THEN 'BRAK CURRENT SDS' WHEN NOT current_sds_file_available THEN 'BRAK PLIKU SDS' ELSE 'CURRENT' END AS sds_label,
 COALESCE(CAST(current_sds_issue_date AS VARCHAR), '—') AS issue_date_label, COALESCE(NULLIF(current_sds_revision, ''), '—') AS revision_label,
 CASE WHEN current_bhp_decision_id IS NULL THEN 'BRAK DECYZJI' ELSE current_bhp_decision_status END AS bhp_label, COALESCE(NULLIF(current_bhp_notes, ''), '—') AS notes_label,
 CASE WHEN action_reasons <> '' THEN action_reasons ELSE 'OK' END AS action_label FROM supervised""")
def supervisory_labels(reg):
    return supervisory.table_labels(supervisory.supervisory_rows(reg))


@query("ambiguous_products", """SELECT DISTINCT product_id FROM (SELECT product_id FROM b_sds_documents WHERE document_status = 'CURRENT' GROUP BY product_id HAVING COUNT(*) > 1
 UNION ALL SELECT product_id FROM b_bhp_decisions WHERE record_status = 'CURRENT' GROUP BY product_id, sds_id HAVING COUNT(*) > 1) t""")
def ambiguous_products(reg):
    return supervisory.ambiguous_products(reg)


LISTED = """SELECT p.product_id, p.product_name, p.manufacturer_product_code, p.manufacturer_id, m.manufacturer_name, p.usage_status, p.use_description, p.use_restriction, p.waste_type, p.waste_code
 FROM b_products p JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id"""


@query("product_list", LISTED)
def product_list(reg):
    return registry_reads.product_list(reg)


@query("product_registry_search", f"SELECT * FROM ({LISTED}) t WHERE CONTAINS(LOWER(product_name || ' ' || manufacturer_name || ' ' || COALESCE(manufacturer_product_code, '')), 'nation_1')")
def product_registry_search(reg):
    return registry_reads.sorted_registry(registry_reads.search(registry_reads.product_list(reg), " NATION_1 "), "product_name")


HISTORY = """history AS (SELECT s.sds_id, s.product_id, s.original_filename, s.relative_path, s.issue_date, s.revision, s.document_status, s.registered_at, i.invalidated_at,
 i.reason AS invalidation_reason, i.invalidated_from_status, i.restored_sds_id FROM b_sds_documents s LEFT JOIN b_sds_invalidation i ON i.invalidated_sds_id = s.sds_id)"""
WITHDRAWN = """withdrawn AS (SELECT product_id FROM history GROUP BY product_id HAVING COUNT(CASE WHEN document_status = 'CURRENT' THEN 1 END) = 0
 AND COUNT(CASE WHEN document_status = 'INVALIDATED' AND invalidated_at IS NOT NULL AND invalidated_from_status = 'CURRENT' AND restored_sds_id IS NULL THEN 1 END) > 0)"""


@query("sds_history", f"WITH {HISTORY} SELECT * FROM history")
def sds_history(reg):
    return registry_reads.ordered_sds_history(registry_reads.sds_history(reg))


@query("withdrawn_products", f"WITH {HISTORY}, {WITHDRAWN} SELECT product_id FROM withdrawn")
def withdrawn_products(reg):
    return registry_reads.withdrawn_products(registry_reads.sds_history(reg))


@query("restored_names", f"""WITH {HISTORY} SELECT h.product_id, h.sds_id, h.invalidated_from_status, h.invalidation_reason, h.restored_sds_id, r.original_filename AS restored_filename,
 COALESCE(NULLIF(r.original_filename, ''), 'Brak') AS restored_label FROM history h LEFT JOIN history r ON r.product_id = h.product_id AND r.sds_id = h.restored_sds_id WHERE h.document_status = 'INVALIDATED'""")
def restored_names(reg):
    return registry_reads.restored_names(registry_reads.sds_history(reg))


WORDS = registry_reads.labels


@query("registry_labels", f"""{SUPERVISED}, {HISTORY}, {WITHDRAWN}, shown AS (SELECT f.*, f.product_id IN (SELECT product_id FROM withdrawn) AND f.current_sds_id IS NULL AS gone FROM facts f)
SELECT product_id, COALESCE(NULLIF(manufacturer_product_code, ''), '—') AS code_label, CASE WHEN gone THEN '{WORDS.WITHDRAWN_STATUS}' ELSE {cases('usage_status', WORDS.STATUS_WORDS)} END AS status_label,
 CASE WHEN gone THEN '{WORDS.WITHDRAWN_DOCUMENT}' WHEN current_sds_id IS NULL THEN 'Brak CURRENT SDS' WHEN current_sds_file_available THEN 'CURRENT' ELSE 'Brak pliku SDS' END AS sds_label,
 CASE WHEN current_sds_id IS NULL THEN '—' ELSE COALESCE(NULLIF(current_sds_revision, ''), '—') END AS revision_label,
 CASE WHEN current_bhp_decision_status IS NULL THEN 'Brak decyzji' ELSE {cases('current_bhp_decision_status', WORDS.DECISION_WORDS)} END AS bhp_label FROM shown""")
def registry_labels(reg):
    return registry_reads.registry_labels(reg)


@query("decision_products", """SELECT p.product_id, p.product_name, p.manufacturer_product_code, m.manufacturer_name, p.usage_status, s.sds_id, s.original_filename AS sds_filename, s.issue_date AS sds_issue_date,
 s.revision AS sds_revision, NOT EXISTS (SELECT 1 FROM b_safety_profiles x WHERE x.sds_id = s.sds_id) AS safety_enrichment_pending, p.use_description IS NULL OR p.use_restriction IS NULL AS administrative_data_pending
 FROM b_products p JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id JOIN b_sds_documents s ON s.product_id = p.product_id AND s.document_status = 'CURRENT'""")
def decision_products(reg):
    return registry_reads.decision_products(reg)


DECISIONS = """SELECT d.sds_id, d.decision_id, d.decision_status, d.record_status, d.registered_at, d.notes, e.relative_path AS evidence_relative_path, e.original_filename AS evidence_original_filename
 FROM b_bhp_decisions d JOIN b_decision_evidence e ON e.evidence_id = d.evidence_id"""


@query("decision_history", DECISIONS)
def decision_history(reg):
    return registry_reads.decision_history(reg)


@query("superseded_decisions", f"SELECT * FROM ({DECISIONS}) t WHERE record_status = 'SUPERSEDED'")
def superseded_decisions(reg):
    return registry_reads.superseded_decisions(registry_reads.decision_history(reg))


@query("current_decisions", f"SELECT t.* FROM ({DECISIONS}) t JOIN b_sds_documents s ON s.sds_id = t.sds_id WHERE t.record_status = 'CURRENT' AND s.document_status = 'CURRENT'")
def current_decisions(reg):
    return registry_reads.current_decisions_of_current_documents(reg)


@query("product_details", f"SELECT t.*, (SELECT COUNT(*) FROM b_sds_documents s WHERE s.product_id = t.product_id) AS sds_count, (SELECT COUNT(*) FROM b_bhp_decisions d WHERE d.product_id = t.product_id) AS bhp_decision_count FROM ({LISTED}) t")
def product_details(reg):
    return registry_reads.product_details(reg)


@query("product_assignments", """SELECT a.product_id, a.location_id, l.location_name, l.location_code, l.status AS location_status, a.peak_quantity_value, a.peak_quantity_unit_id, pu.code AS peak_quantity_unit,
 a.monthly_consumption_value, a.monthly_consumption_unit_id, mu.code AS monthly_consumption_unit FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id
 JOIN b_units pu ON pu.unit_id = a.peak_quantity_unit_id LEFT JOIN b_units mu ON mu.unit_id = a.monthly_consumption_unit_id""")
def product_assignments(reg):
    return registry_reads.ordered_assignments(registry_reads.product_assignments(reg))


@query("quantity_totals", """SELECT p.product_id, CASE WHEN COUNT(a.product_id) = 0 THEN CAST(0 AS DECIMAL(28,6)) WHEN COUNT(DISTINCT a.peak_quantity_unit_id) > 1 THEN NULL ELSE CAST(SUM(a.peak_quantity_value) AS DECIMAL(28,6)) END AS peak_total,
 CASE WHEN COUNT(DISTINCT a.peak_quantity_unit_id) > 1 THEN 'MIXED_UNITS' ELSE 'OK' END AS total_status FROM b_products p LEFT JOIN b_product_usage_locations a ON a.product_id = p.product_id GROUP BY p.product_id""")
def quantity_totals(reg):
    return registry_reads.quantity_totals_of_products(reg)


NAMES = "SELECT relative_path, original_filename AS registered_name FROM (SELECT relative_path, original_filename, ROW_NUMBER() OVER (PARTITION BY relative_path ORDER BY evidence_id) AS n FROM b_decision_evidence) t WHERE n = 1"


@query("evidence_first_name", NAMES)
def evidence_first_name(reg):
    return registry_reads.first_evidence_names(reg.decision_evidence)


@query("evidence_options", f"""SELECT f.relative_path, COALESCE(NULLIF(n.registered_name, ''), REGEXP_EXTRACT(f.relative_path, '([^/]*)$', 1)) AS original_filename
 FROM b_file_listing f LEFT JOIN ({NAMES}) n ON n.relative_path = f.relative_path WHERE f.root = 'evidence' AND f.length > 0""")
def evidence_options(reg):
    return registry_reads.evidence_options(reg.file_listing, registry_reads.first_evidence_names(reg.decision_evidence))


@query("stored_evidence", "SELECT root, relative_path, length FROM b_file_listing WHERE root = 'evidence' AND length > 0")
def stored_evidence(reg):
    return registry_reads.stored_evidence(reg.file_listing)


@query("locations_without_code", "SELECT COUNT(*) AS locations_without_code FROM b_usage_locations WHERE location_code IS NULL")
def locations_without_code(reg):
    return registry_reads.locations_without_code(reg.usage_locations)


@query("current_document_probe", """SELECT product_id, CASE WHEN COUNT(*) = 1 THEN MIN(original_filename) END AS original_filename, CASE WHEN COUNT(*) = 1 THEN MIN(relative_path) END AS relative_path,
 CASE WHEN COUNT(*) = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS current_status FROM b_sds_documents WHERE document_status = 'CURRENT' GROUP BY product_id""")
def current_document_probe(reg):
    return registry_reads.current_document_probe(reg.sds_documents)


@query("existing_products", "SELECT DISTINCT o_custkey AS product_id FROM orders WHERE o_custkey IN (SELECT product_id FROM b_products)")
def existing_products(reg):
    return registry_reads.existing_products(reg, reg.sds_documents.sparkSession.read.parquet(f"{reg.sf_dir}/orders.parquet").select(F.col("o_custkey").alias("product_id")).distinct())


@query("active_units", "SELECT unit_id, code, name, category, status FROM b_units WHERE status = 'ACTIVE'")
def active_units(reg):
    return registry_reads.active_units(reg.unit_of_measure)


@query("usage_location_list", "SELECT location_id, location_code, location_name, status FROM b_usage_locations")
def usage_location_list(reg):
    return registry_reads.usage_location_list(reg.usage_locations)


@query("history_intervals", """SELECT history_id, product_id, usage_status, changed_at AS valid_from, LEAD(changed_at) OVER w AS valid_to, LEAD(changed_at) OVER w IS NULL AS is_latest
 FROM b_product_history WINDOW w AS (PARTITION BY product_id ORDER BY changed_at, history_id)""")
def history_intervals(reg):
    return history.validity_intervals(reg.product_history, ["product_id"])


@query("latest_states", "SELECT product_id, history_id, usage_status, changed_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY changed_at DESC, history_id DESC) AS n FROM b_product_history) t WHERE n = 1")
def latest_states(reg):
    return history.latest_states(reg.product_history, ["product_id"])


@query("product_history", "SELECT history_id, product_id, usage_status, changed_at FROM b_product_history")
def product_history(reg):
    return history.ordered_history(reg.product_history, ["product_id"])


@query("location_history_intervals", """SELECT history_id, location_id, status, changed_at AS valid_from, LEAD(changed_at) OVER w AS valid_to, LEAD(changed_at) OVER w IS NULL AS is_latest
 FROM b_usage_location_history WINDOW w AS (PARTITION BY location_id ORDER BY changed_at, history_id)""")
def location_history_intervals(reg):
    return history.validity_intervals(reg.usage_location_history, ["location_id"])


@query("assignment_history_intervals", """SELECT history_id, product_id, location_id, peak_quantity_value, peak_quantity_unit_id, monthly_consumption_value, monthly_consumption_unit_id, changed_at AS valid_from,
 LEAD(changed_at) OVER w AS valid_to, LEAD(changed_at) OVER w IS NULL AS is_latest FROM b_product_usage_location_history WINDOW w AS (PARTITION BY product_id, location_id ORDER BY changed_at, history_id)""")
def assignment_history_intervals(reg):
    return history.validity_intervals(reg.product_usage_location_history, ["product_id", "location_id"])


@query("identity_changes", "SELECT * FROM b_product_identity_changes")
def identity_changes(reg):
    return reg.product_identity_changes.orderBy("product_id", "changed_at", "change_id")


@query("sds_components", "SELECT * FROM b_sds_components")
def sds_components(reg):
    return reg.sds_components


# --- audits over seeded violations

AUDITED = {"manufacturers": "manufacturers", "products": "products", "usage_locations": "audit_locations", "unit_of_measure": "unit_of_measure", "product_usage_locations": "audit_assignments",
           "sds_documents": "audit_documents", "bhp_decisions": "audit_decisions", "decision_evidence": "decision_evidence", "sds_invalidation": "sds_invalidation", "physical_reviews": "physical_reviews",
           "physical_review_items": "physical_review_items", "product_history": "product_history", "product_identity_changes": "product_identity_changes",
           "usage_location_history": "usage_location_history", "product_usage_location_history": "product_usage_location_history"}


def audited(reg) -> dict[str, DataFrame]:
    return {name: getattr(reg, source) for name, source in AUDITED.items()}


def view(name: str) -> str:
    return {"unit_of_measure": "b_units"}.get(AUDITED[name], f"b_{AUDITED[name]}")


@query("orphans", "SELECT sds_id, product_id FROM b_audit_documents WHERE product_id NOT IN (SELECT product_id FROM b_products)")
def orphans(reg):
    return audits.orphans(SimpleNamespace(sds_documents=reg.audit_documents, products=reg.products))


@query("multi_current", "SELECT product_id, COUNT(*) AS current_documents FROM b_audit_documents WHERE document_status = 'CURRENT' GROUP BY product_id HAVING COUNT(*) > 1")
def multi_current(reg):
    return audits.multiple_current(reg.audit_documents)


@query("seeded_ambiguous_products", """SELECT DISTINCT product_id FROM (SELECT product_id FROM b_audit_documents WHERE document_status = 'CURRENT' GROUP BY product_id HAVING COUNT(*) > 1
 UNION ALL SELECT product_id FROM b_audit_decisions WHERE record_status = 'CURRENT' GROUP BY product_id, sds_id HAVING COUNT(*) > 1) t""")
def seeded_ambiguous_products(reg):
    return supervisory.ambiguous_products(SimpleNamespace(sds_documents=reg.audit_documents, bhp_decisions=reg.audit_decisions))


@query("seeded_document_probe", """SELECT product_id, CASE WHEN COUNT(*) = 1 THEN MIN(original_filename) END AS original_filename, CASE WHEN COUNT(*) = 1 THEN MIN(relative_path) END AS relative_path,
 CASE WHEN COUNT(*) = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS current_status FROM b_audit_documents WHERE document_status = 'CURRENT' GROUP BY product_id""")
def seeded_document_probe(reg):
    return registry_reads.current_document_probe(reg.audit_documents)


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {view(n)}" for n in AUDITED))
def table_counts(reg):
    return audits.table_counts(audited(reg))


@query("count_changes", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT COUNT(*) FROM {view(n)}) AS rows_before, (SELECT COUNT(*) FROM {view(m)}) AS rows_after" for n, m in (("products", "products"), ("sds_documents", "bhp_decisions"))) + ") t WHERE rows_before <> rows_after")
def count_changes(reg):
    tables = audited(reg)
    return audits.count_changes(audits.table_counts({n: tables[n] for n in ("products", "sds_documents")}), audits.table_counts({"products": tables["products"], "sds_documents": tables["bhp_decisions"]}))


def _keys_sql() -> str:
    parts = []
    for name in AUDITED:
        own = [(k, None, True) for k in [schemas.PRIMARY_KEYS[name]]] + [(k, w, False) for t, k, w in schemas.UNIQUE_KEYS if t == name]
        for keys, when, primary in own:
            null = " OR ".join(f"{k} IS NULL" for k in keys)
            having = f"COUNT(*) > 1 OR MAX(CASE WHEN {null} THEN 1 ELSE 0 END) = 1" if primary else f"COUNT(*) > 1 AND MAX(CASE WHEN {null} THEN 1 ELSE 0 END) = 0"
            rule = f"{'primary key' if primary else 'unique'} {', '.join(keys)}"
            parts.append(f"SELECT '{name}' AS table_name, '{rule}' AS rule, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violations FROM (SELECT COUNT(*) AS n FROM {view(name)} {f'WHERE {when}' if when else ''} GROUP BY {', '.join(keys)} HAVING {having}) t")
    return " UNION ALL ".join(parts)


def _references_sql() -> str:
    parts = []
    for name, keys, target, to in schemas.REFERENCES:
        if name in AUDITED and target in AUDITED:
            same = " AND ".join(f"b.{t} = a.{k}" for k, t in zip(keys, to, strict=True))
            parts.append(f"SELECT '{name}' AS table_name, '{', '.join(keys)} -> {target}' AS rule, COUNT(*) AS violations FROM {view(name)} a WHERE {' AND '.join(f'a.{k} IS NOT NULL' for k in keys)} AND NOT EXISTS (SELECT 1 FROM {view(target)} b WHERE {same})")
    return " UNION ALL ".join(parts)


def _rows_sql() -> str:
    parts = []
    bound = {"products": ("usage_status",), "product_history": ("usage_status",), "usage_locations": ("status",), "usage_location_history": ("status",), "unit_of_measure": ("category", "status"), "sds_documents": ("document_status", "file_status"),
             "bhp_decisions": ("decision_status", "record_status"), "decision_evidence": ("evidence_type", "file_format", "file_status"), "physical_reviews": ("status",), "product_identity_changes": ("change_kind",), "sds_invalidation": ("invalidated_from_status",)}
    for name in AUDITED:
        rules = [(f"domain {c}", f"{c} NOT IN ({', '.join(repr(m) for m in schemas.DOMAINS[name, c])})") for c in bound.get(name, ())]
        rules += [(f"check {r}", f"NOT ({sql})") for t, r, sql in schemas.CHECKS if t == name]
        parts += [f"SELECT '{name}' AS table_name, '{r}' AS rule, COUNT(CASE WHEN {bad} THEN 1 END) AS violations FROM {view(name)}" for r, bad in rules]
    return " UNION ALL ".join(parts).replace("location_code RLIKE '^[A-Z0-9][A-Z0-9_-]{0,31}$'", "REGEXP_FULL_MATCH(location_code, '[A-Z0-9][A-Z0-9_-]{0,31}')")


@query("key_audit", _keys_sql())
def key_audit(reg):
    return audits.key_violations(audited(reg))


@query("reference_audit", _references_sql())
def reference_audit(reg):
    return audits.reference_violations(audited(reg))


@query("row_audit", _rows_sql())
def row_audit(reg):
    return audits.row_violations(audited(reg))


# --- identity and batch

SIMILAR = """similar_ AS (SELECT w.name, m.manufacturer_id, m.manufacturer_name FROM wanted w JOIN b_makers m ON m.manufacturer_name <> w.name AND CONTAINS(LOWER(m.manufacturer_name), LOWER(SPLIT_PART(w.name, ' ', 1)))),
exact_ AS (SELECT w.name, m.manufacturer_id FROM wanted w JOIN b_makers m ON m.manufacturer_name = w.name)"""
WANTED = "wanted AS (SELECT DISTINCT canonical AS name FROM b_approved UNION SELECT 'Supplier of NATION_1' UNION SELECT 'N1 x')"


def wanted_makers(reg):
    return reg.approved.select(F.col("canonical").alias("name")).unionByName(reg.approved.limit(1).select(F.explode(F.array(F.lit("Supplier of NATION_1"), F.lit("N1 x"))).alias("name")))


@query("exact_manufacturers", f"WITH {WANTED}, {SIMILAR} SELECT name, manufacturer_id FROM exact_")
def exact_manufacturers(reg):
    return identity.exact_manufacturers(wanted_makers(reg), reg.makers)


@query("similar_manufacturers", f"WITH {WANTED}, {SIMILAR} SELECT name, manufacturer_id, manufacturer_name FROM similar_")
def similar_manufacturers(reg):
    return identity.similar_manufacturers(wanted_makers(reg), reg.makers)


@query("manufacturer_candidates", f"WITH {WANTED}, {SIMILAR} SELECT name, manufacturer_id, 'EXACT' AS kind FROM exact_ UNION ALL SELECT name, manufacturer_id, 'SIMILAR' FROM similar_ s WHERE NOT EXISTS (SELECT 1 FROM exact_ e WHERE e.name = s.name AND e.manufacturer_id = s.manufacturer_id)")
def manufacturer_candidates(reg):
    return identity.manufacturer_candidates(wanted_makers(reg), reg.makers)


def norm(column: str) -> str:
    return f"LOWER(TRIM(REGEXP_REPLACE({column}, '\\s+', ' ', 'g')))"


def starts(a: str, b: str) -> str:
    return f"STARTS_WITH({norm(a)}, {norm(b)} || ' ')"


def candidates_sql(names: str, goods: str) -> str:
    return f"""SELECT n.name, n.selected_id, p.product_id FROM {names} n JOIN {goods} p ON {norm('n.name')} = {norm('p.product_name')}
 OR (p.manufacturer_id <> n.selected_id AND ({starts('n.name', 'p.product_name')} OR {starts('p.product_name', 'n.name')}))"""


@query("candidate_products", candidates_sql("b_names", "b_goods"))
def candidate_products(reg):
    return identity.candidate_products(reg.names, reg.goods)


LIST = lambda *items: "CONCAT_WS(';', " + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in items) + ")"


@query("identity_plan", f"""WITH a AS (SELECT e.*, CASE WHEN name_state = 'FOUND' THEN name END AS product_name, CASE WHEN code_state = 'FOUND' THEN code END AS product_code, CASE WHEN issue_date_state = 'FOUND' THEN issue_date END AS raw_date,
 CASE WHEN manufacturers = 1 AND manufacturer_state = 'FOUND' THEN manufacturer END AS raw, code_state IN ('AMBIGUOUS', 'UNREADABLE') AS uncertain FROM b_evidence e),
b AS (SELECT a.*, COALESCE(m.canonical, a.raw) AS canonical, a.raw IS NOT NULL AND m.raw IS NULL AS unapproved FROM a LEFT JOIN b_approved m ON m.raw = a.raw),
wanted AS (SELECT DISTINCT canonical AS name FROM b WHERE canonical IS NOT NULL), {SIMILAR},
c AS (SELECT b.*, (SELECT COUNT(*) FROM exact_ x WHERE x.name = b.canonical) AS exact, (SELECT MIN(manufacturer_id) FROM exact_ x WHERE x.name = b.canonical) AS selected_id,
 EXISTS (SELECT 1 FROM similar_ x WHERE x.name = b.canonical AND NOT EXISTS (SELECT 1 FROM exact_ y WHERE y.name = x.name AND y.manufacturer_id = x.manufacturer_id)) AS alike, product_name IS NULL OR TRIM(product_name) = '' AS blank FROM b),
d AS (SELECT c.*, CASE WHEN canonical IS NULL OR unapproved OR exact > 1 THEN 'HUMAN_REVIEW' WHEN exact = 1 THEN 'LINK_CANDIDATE' ELSE 'CREATE_CANDIDATE' END AS manufacturer_status,
 (SELECT COUNT(*) FROM b_goods g WHERE g.product_name = c.product_name AND g.manufacturer_id = c.selected_id AND (c.product_code IS NULL OR g.manufacturer_product_code = c.product_code)) AS matches,
 EXISTS (SELECT 1 FROM b_goods g WHERE g.product_name = c.product_name) AS named FROM c),
f AS (SELECT d.*, CASE WHEN blank OR uncertain OR manufacturer_status = 'HUMAN_REVIEW' THEN 'HUMAN_REVIEW' WHEN manufacturer_status = 'LINK_CANDIDATE' THEN CASE matches WHEN 0 THEN 'CREATE_CANDIDATE' WHEN 1 THEN 'LINK_CANDIDATE' ELSE 'HUMAN_REVIEW' END
 WHEN named THEN 'PENDING_MANUFACTURER' ELSE 'CREATE_CANDIDATE' END AS product_status FROM d)
SELECT evidence_id, product_name, product_code, TRY_CAST(raw_date AS DATE) AS issue_date, revision, canonical, manufacturer_status, product_status,
 CASE WHEN manufacturer_status = 'LINK_CANDIDATE' AND product_status <> 'HUMAN_REVIEW' THEN matches END AS product_candidates,
 {LIST(("raw_date IS NOT NULL AND TRY_CAST(raw_date AS DATE) IS NULL", "INVALID_ISSUE_DATE"), ("blank", "PRODUCT_NAME_REQUIRES_HUMAN_REVIEW"), ("uncertain", "MANUFACTURER_PRODUCT_CODE_REQUIRES_HUMAN_REVIEW"), ("canonical IS NULL", "MANUFACTURER_REQUIRES_HUMAN_REVIEW"), ("unapproved", "UNAPPROVED_MANUFACTURER_RAW_VALUE"), ("product_status = 'PENDING_MANUFACTURER'", "PRODUCT_PENDING_MANUFACTURER"), ("validation_status = 'BLOCKED'", "EXTRACTION_VALIDATION_BLOCKED"), ("validation_status = 'REQUIRES_HUMAN_REVIEW'", "EXTRACTION_REQUIRES_HUMAN_REVIEW"), ("review_status <> 'APPROVED'", "DOCUMENT_HUMAN_APPROVAL_REQUIRED"))} AS blockers,
 {LIST(("alike AND exact = 0", "SIMILAR_MANUFACTURERS_REQUIRE_HUMAN_CONFIRMATION"), ("has_safety", "SAFETY_DATA_DEFERRED_TO_STAGE_2"))} AS warnings, 'NOT_READY' AS commit_readiness FROM f""")
def identity_plan(reg):
    return identity.identity_plan(reg.evidence, reg.makers, reg.goods, reg.approved)


@query("set_differences", "SELECT manifest_id, 'MISSING' AS side FROM (SELECT manifest_id FROM b_batch_items WHERE status <> 'COMPLETE' EXCEPT SELECT manifest_id FROM b_batch_items WHERE revision <> '0') a UNION ALL SELECT manifest_id, 'UNEXPECTED' FROM (SELECT manifest_id FROM b_batch_items WHERE revision <> '0' EXCEPT SELECT manifest_id FROM b_batch_items WHERE status <> 'COMPLETE') b")
def set_differences(reg):
    return identity.set_differences(reg.batch_items.where("status <> 'COMPLETE'"), reg.batch_items.where("revision <> '0'"), "manifest_id")


@query("snapshot_drift", "SELECT manifest_id, CASE WHEN product_code IS NOT DISTINCT FROM CASE WHEN manifest_id % 9 = 0 THEN NULL ELSE product_code END AND manifest_id % 10 <> 0 THEN 'CURRENT' ELSE 'STALE' END AS drift FROM b_batch_items")
def snapshot_drift(reg):
    planned = reg.batch_items.select("manifest_id", "product_name", "product_code")
    fresh = planned.where("manifest_id % 10 <> 0").withColumn("product_code", F.when(F.col("manifest_id") % 9 != 0, F.col("product_code")))
    return identity.drift(planned, fresh, "manifest_id")


FIRST = """problems AS (SELECT i.*, CASE
 WHEN logical_sds_count <> 1 OR status NOT IN ('COMPLETE', 'NEEDS_REVIEW') OR json_file <> CAST(manifest_id AS VARCHAR) || '_DOC-001.json' OR CONTAINS(source_file, '/') OR LENGTH(sha256_expected) <> 64 THEN 'BLOCKED_DATA/INVALID_MANIFEST_ENTRY'
 WHEN json_name IS NULL THEN 'BLOCKED_SOURCE/JSON_UNAVAILABLE' WHEN json_name <> source_file OR json_sha256 <> sha256_expected THEN 'BLOCKED_SOURCE/MANIFEST_JSON_SOURCE_MISMATCH'
 WHEN sha256 IS NULL OR sha256 <> sha256_expected THEN 'BLOCKED_SOURCE/PDF_SHA_MISMATCH' WHEN product_name = '' THEN 'BLOCKED_DATA/STAGE1_HEADER_INVALID_OR_UNPROVEN' END AS problem FROM b_batch_items i),
held AS (SELECT p.*, FIRST_VALUE(manifest_id) OVER w AS holder, FIRST_VALUE(CONCAT_WS('|', product_name, COALESCE(product_code, '?'), issue_date, revision, manufacturer)) OVER w AS first_identity,
 CONCAT_WS('|', product_name, COALESCE(product_code, '?'), issue_date, revision, manufacturer) AS own_identity FROM problems p WHERE problem IS NULL WINDOW w AS (PARTITION BY sha256 ORDER BY position)),
marked AS (SELECT h.*, MAX(CASE WHEN own_identity <> first_identity THEN manifest_id END) OVER (PARTITION BY sha256) AS last_other FROM held h),
judged AS (SELECT m.*, CASE WHEN own_identity <> first_identity THEN 'CONTRADICTORY' WHEN manifest_id <> holder THEN 'DUPLICATE' WHEN last_other IS NOT NULL THEN 'CONTRADICTED' END AS duplicate,
 CASE WHEN own_identity <> first_identity THEN NULL WHEN manifest_id <> holder THEN holder ELSE last_other END AS against FROM marked m)"""


@query("dedup_first_wins", f"WITH {FIRST} SELECT p.manifest_id, j.holder, j.duplicate, j.against FROM problems p LEFT JOIN judged j ON j.manifest_id = p.manifest_id")
def dedup_first_wins(reg):
    return batch.first_wins(reg.batch_items.withColumn("eligible", batch.entry_problem().isNull())).select("manifest_id", "holder", "duplicate", "against")


CLASSIFIED = f"""{FIRST}, wanted AS (SELECT DISTINCT product_name AS name, CAST(1 AS BIGINT) AS selected_id FROM judged WHERE duplicate IS NULL AND manufacturer = 'Maker'),
candidates AS (SELECT name, COUNT(*) AS n FROM ({candidates_sql('wanted', 'b_batch_products')}) c GROUP BY name),
facts AS (SELECT p.manifest_id, p.problem, j.duplicate, j.against, p.manufacturer, p.issue_date, p.sha256, COALESCE((SELECT n FROM candidates c WHERE c.name = p.product_name), 0) AS candidates,
 (SELECT COUNT(*) FROM b_batch_products g WHERE g.manufacturer_id = 1 AND g.product_name = p.product_name AND g.manufacturer_product_code IS NOT DISTINCT FROM p.product_code) AS exact,
 (SELECT MIN(product_id) FROM b_batch_products g WHERE g.manufacturer_id = 1 AND g.product_name = p.product_name AND g.manufacturer_product_code IS NOT DISTINCT FROM p.product_code) AS product_id, p.revision
 FROM problems p LEFT JOIN judged j ON j.manifest_id = p.manifest_id),
more AS (SELECT f.*, (SELECT COUNT(*) FROM b_batch_documents d WHERE d.product_id = f.product_id AND d.document_status = 'CURRENT') AS current, (SELECT MAX(issue_date) FROM b_batch_documents d WHERE d.product_id = f.product_id AND d.document_status = 'CURRENT') AS current_date_,
 (SELECT COUNT(*) FROM b_batch_documents d WHERE d.product_id = f.product_id AND d.issue_date = f.issue_date AND d.revision = f.revision) AS same_, (SELECT COUNT(*) FROM b_batch_documents d WHERE d.product_id = f.product_id AND d.issue_date = f.issue_date AND d.revision = f.revision AND d.sha256 <> f.sha256) AS other_ FROM facts f),
verdicts AS (SELECT manifest_id, CASE WHEN problem IS NOT NULL THEN problem WHEN duplicate = 'DUPLICATE' THEN 'SKIP_DUPLICATE_SOURCE/DUPLICATE_OF:' || CAST(against AS VARCHAR) WHEN duplicate = 'CONTRADICTORY' THEN 'BLOCKED_DATA/CONTRADICTORY_DUPLICATE_SOURCE'
 WHEN duplicate = 'CONTRADICTED' THEN 'BLOCKED_DATA/CONTRADICTORY_DUPLICATE_SOURCE:' || CAST(against AS VARCHAR) WHEN manufacturer <> 'Maker' THEN 'REVIEW_IDENTITY/MANUFACTURER_CANONICAL_NOT_APPROVED' WHEN exact > 1 THEN 'REVIEW_IDENTITY/MULTIPLE_EXACT_PRODUCTS'
 WHEN exact = 0 AND candidates > 0 THEN 'REVIEW_IDENTITY/SIMILAR_OR_CODE_CONFLICT_PRODUCT' WHEN exact = 0 THEN 'READY_CREATE/EXACT_PRODUCT_ABSENT' WHEN current > 1 THEN 'BLOCKED_DATA/MULTIPLE_CURRENT_SDS' WHEN other_ > 0 THEN 'BLOCKED_DATA/SDS_METADATA_SOURCE_CONFLICT'
 WHEN same_ > 0 THEN 'SKIP_EXACT_EXISTING/EXACT_PRODUCT_SDS_PDF' WHEN current = 0 THEN 'REVIEW_IDENTITY/NO_CURRENT_SDS_FOR_EXISTING_PRODUCT' WHEN current_date_ IS NULL OR issue_date <= current_date_ THEN 'REVIEW_IDENTITY/REVISION_NOT_NEWER' ELSE 'READY_ADD_REVISION/NEWER_ISSUE_DATE' END AS v FROM more),
classified AS (SELECT manifest_id, SPLIT_PART(v, '/', 1) AS classification, SUBSTRING(v, POSITION('/' IN v) + 1) AS reason FROM verdicts)"""


def classified(reg):
    return batch.classify(reg.batch_items, reg.batch_products, reg.batch_documents, "Maker", 1)


@query("batch_classification", f"WITH {CLASSIFIED} SELECT * FROM classified")
def batch_classification(reg):
    return classified(reg)


@query("classification_counts", f"WITH {CLASSIFIED} SELECT k.c AS classification, COUNT(x.manifest_id) AS items FROM (SELECT UNNEST({list(batch.CLASSES)!r}) AS c) k LEFT JOIN classified x ON x.classification = k.c GROUP BY k.c")
def classification_counts(reg):
    return batch.class_counts(classified(reg))


@query("batch_gate", f"WITH {CLASSIFIED} SELECT COUNT(CASE WHEN classification LIKE 'BLOCKED%' THEN 1 END) AS blocked, COUNT(CASE WHEN classification LIKE 'READY%' THEN 1 END) AS ready, CASE WHEN COUNT(CASE WHEN classification LIKE 'BLOCKED%' THEN 1 END) > 0 THEN 'STOPPED' ELSE 'OPEN' END AS gate FROM classified")
def batch_gate(reg):
    return batch.batch_gate(classified(reg))


REVIEWED = CLASSIFIED.replace("b_batch_items", "b_review_items").replace("b_batch_documents", "b_review_documents")


@query("review_resolutions", f"""WITH {REVIEWED}, x AS (SELECT i.*, d.action, d.observed, d.product_id AS pid, d.preserve_name, d.preserve_code, d.old_manufacturer_id, d.new_manufacturer_id, d.product_name AS d_name, d.product_code AS d_code, c.classification, c.reason
  FROM b_review_items i JOIN b_review_decisions d ON d.manifest_id = i.manifest_id JOIN classified c ON c.manifest_id = i.manifest_id),
 y AS (SELECT x.*, (SELECT COUNT(*) FROM b_batch_products p WHERE p.product_id = x.pid AND p.product_name = x.preserve_name AND p.manufacturer_product_code IS NOT DISTINCT FROM x.preserve_code AND p.manufacturer_id = x.old_manufacturer_id) AS kept,
  (SELECT MIN(sds_id) FROM b_review_documents s WHERE s.product_id = x.pid AND s.sha256 IS NULL) AS unread, (SELECT COUNT(*) FROM b_review_documents s WHERE s.product_id = x.pid AND s.document_status = 'CURRENT') AS current_n,
  (SELECT MAX(issue_date) FROM b_review_documents s WHERE s.product_id = x.pid AND s.document_status = 'CURRENT') AS current_d, (SELECT COUNT(*) FROM b_review_documents s WHERE s.product_id = x.pid AND s.issue_date = x.issue_date AND s.revision = x.revision) AS same_n,
  (SELECT COUNT(*) FROM b_review_documents s WHERE s.product_id = x.pid AND s.issue_date = x.issue_date AND s.revision = x.revision AND s.sha256 <> x.sha256) AS other_n, (SELECT COUNT(*) FROM b_review_documents s WHERE s.product_id = x.pid AND s.sha256 = x.sha256) AS file_n,
  (SELECT COUNT(*) FROM b_batch_products p WHERE p.manufacturer_id = 1 AND p.product_name = x.product_name) AS taken,
  CASE WHEN reason IN ('MULTIPLE_CURRENT_SDS', 'SDS_METADATA_SOURCE_CONFLICT', 'EXACT_PRODUCT_SDS_PDF', 'NO_CURRENT_SDS_FOR_EXISTING_PRODUCT', 'REVISION_NOT_NEWER', 'NEWER_ISSUE_DATE') THEN (SELECT MIN(s.sds_id) FROM b_review_documents s JOIN b_batch_products p ON p.product_id = s.product_id
   WHERE s.sha256 IS NULL AND p.manufacturer_id = 1 AND p.product_name = x.product_name AND p.manufacturer_product_code IS NOT DISTINCT FROM x.product_code) END AS shut FROM x),
 z AS (SELECT manifest_id, action, CASE WHEN classification LIKE 'BLOCKED%' AND reason NOT IN ('MULTIPLE_CURRENT_SDS', 'SDS_METADATA_SOURCE_CONFLICT') OR classification = 'SKIP_DUPLICATE_SOURCE' THEN classification || '/' || reason
  WHEN said <> COALESCE(observed, 'Maker') THEN 'BLOCKED_DATA/DECISION_SOURCE_MISMATCH'
  WHEN action = 'CORRECT_EXISTING_PRODUCT' THEN CASE WHEN kept = 0 OR new_manufacturer_id <> 1 OR product_code IS NOT NULL THEN 'REVIEW_IDENTITY/APPROVED_PRODUCT_SNAPSHOT_MISMATCH' WHEN unread IS NOT NULL THEN 'BLOCKED_DATA/REGISTERED_PDF_UNAVAILABLE:' || CAST(unread AS VARCHAR)
   WHEN current_n <> 1 THEN 'REVIEW_SOURCE_CONFLICT/CURRENT_SDS_NOT_UNIQUE' WHEN other_n > 0 THEN 'REVIEW_SOURCE_CONFLICT/SDS_METADATA_SOURCE_CONFLICT' WHEN same_n > 0 THEN 'READY_IDENTITY_CORRECTION_ONLY/EXACT_EXISTING_SDS_CORRECT_MANUFACTURER'
   WHEN file_n > 0 THEN 'REVIEW_SOURCE_CONFLICT/PDF_METADATA_CONFLICT' WHEN current_d IS NULL OR issue_date <= current_d THEN 'REVIEW_SOURCE_CONFLICT/INCOMING_NOT_NEWER_THAN_CURRENT_SDS' ELSE 'READY_IDENTITY_CORRECTION_AND_ADD_REVISION/NEW_SDS_AFTER_CORRECTION' END
  WHEN action = 'CREATE_DISTINCT_PRODUCT' AND (product_name <> d_name OR product_code IS DISTINCT FROM d_code) THEN 'BLOCKED_DATA/PRODUCT_DECISION_SOURCE_MISMATCH' WHEN action = 'CREATE_DISTINCT_PRODUCT' AND classification = 'REVIEW_IDENTITY' AND taken = 0 THEN 'READY_CREATE/APPROVED_DISTINCT_PRODUCT'
  WHEN shut IS NOT NULL THEN 'BLOCKED_DATA/REGISTERED_PDF_UNAVAILABLE:' || CAST(shut AS VARCHAR) ELSE classification || '/' || reason END AS v FROM y)
 SELECT manifest_id, action, SPLIT_PART(v, '/', 1) AS classification, SUBSTRING(v, POSITION('/' IN v) + 1) AS reason FROM z""")
def review_resolutions(reg):
    return corrections.resolve_reviews(reg.batch_items, reg.review_decisions, reg.batch_products, reg.review_documents, "Maker", 1)


VERIFIED = """c AS (SELECT * FROM b_batch_report WHERE action = 'COMMITTED'),
checked AS (SELECT c.manifest_id, CONCAT_WS(';', CASE WHEN p.product_id IS NULL THEN 'PRODUCT_MISSING' END, CASE WHEN p.product_name <> c.product_name THEN 'NAME_DIFFERS' END, CASE WHEN p.manufacturer_id <> 1 THEN 'MANUFACTURER_DIFFERS' END,
 CASE WHEN p.use_description IS NOT NULL OR p.use_restriction IS NOT NULL THEN 'USE_ALREADY_SET' END, CASE WHEN (SELECT COUNT(*) FROM b_products o WHERE o.product_name = c.product_name) > 1 THEN 'NAME_NOT_UNIQUE' END, CASE WHEN COUNT(*) OVER (PARTITION BY c.product_id) > 1 THEN 'PRODUCT_COMMITTED_TWICE' END,
 CASE WHEN (SELECT COUNT(*) FROM b_product_history h WHERE h.product_id = c.product_id) <> 1 THEN 'HISTORY_NOT_ONE' END, CASE WHEN s.sds_id IS NULL THEN 'DOCUMENT_MISSING' END, CASE WHEN s.product_id <> c.product_id THEN 'DOCUMENT_OF_ANOTHER_PRODUCT' END,
 CASE WHEN s.document_status <> 'CURRENT' THEN 'DOCUMENT_NOT_CURRENT' END, CASE WHEN s.sds_id IS NOT NULL AND f.sha256 IS DISTINCT FROM c.sha256 THEN 'FILE_DIFFERS' END, CASE WHEN COUNT(*) OVER (PARTITION BY c.sds_id) > 1 THEN 'DOCUMENT_COMMITTED_TWICE' END,
 CASE WHEN c.sds_id IN (SELECT sds_id FROM b_safety_profiles) THEN 'PROFILE_PRESENT' END, CASE WHEN c.sds_id IN (SELECT sds_id FROM b_sds_components) THEN 'COMPONENTS_PRESENT' END, CASE WHEN c.sds_id IN (SELECT sds_id FROM b_bhp_decisions WHERE record_status = 'CURRENT') THEN 'DECISION_PRESENT' END) AS issues
 FROM c LEFT JOIN b_products p ON p.product_id = c.product_id LEFT JOIN b_sds_documents s ON s.sds_id = c.sds_id LEFT JOIN b_batch_stored f ON f.relative_path = s.relative_path)"""


def verified(reg):
    decisions = reg.bhp_decisions.where("record_status = 'CURRENT'")
    return corrections.verify_batch(reg.batch_report, reg.products, reg.sds_documents, reg.product_history, reg.safety_profiles, reg.sds_components, decisions, reg.batch_stored, 1)


@query("batch_verification", f"WITH {VERIFIED} SELECT manifest_id, issues FROM checked")
def batch_verification(reg):
    return verified(reg).select("manifest_id", F.array_join("issues", ";").alias("issues"))


@query("batch_verified_counts", f"WITH {VERIFIED} SELECT classification, action, COUNT(*) AS items, COUNT(k.manifest_id) AS checked, COUNT(CASE WHEN k.issues <> '' THEN 1 END) AS failed FROM b_batch_report r LEFT JOIN checked k ON k.manifest_id = r.manifest_id GROUP BY classification, action")
def batch_verified_counts(reg):
    return corrections.batch_verified(reg.batch_report, verified(reg))


# --- scalar functions over the given tables

def raw(reg, table: str) -> DataFrame:
    return reg.spark.read.parquet(f"{reg.sf_dir}/{table}.parquet")


@query("location_codes", "SELECT s_suppkey, CASE WHEN REGEXP_FULL_MATCH(UPPER(TRIM(CASE WHEN s_suppkey % 3 = 0 THEN ' l_' || CAST(s_suppkey AS VARCHAR) || ' ' ELSE s_name END)), '[A-Z0-9][A-Z0-9_-]{0,31}') THEN UPPER(TRIM(CASE WHEN s_suppkey % 3 = 0 THEN ' l_' || CAST(s_suppkey AS VARCHAR) || ' ' ELSE s_name END)) END AS code FROM supplier")
def location_codes(reg):
    return raw(reg, "supplier").select("s_suppkey", text.location_code(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" l_"), F.col("s_suppkey").cast("string"), F.lit(" "))).otherwise(F.col("s_name"))).alias("code"))


@query("normal_names", f"SELECT product_id, {norm('product_name')} AS name FROM b_goods")
def normal_names(reg):
    return reg.goods.select("product_id", text.normal_name(F.col("product_name")).alias("name"))


MONTH_LIST = [names[0] for names in text.MONTHS]


@query("date_parsers", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS slash_iso, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dotted, CAST(o_orderdate AS DATE) AS slashed, CAST(o_orderdate AS DATE) AS named, "
       "CASE WHEN DAY(o_orderdate) > 12 OR o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) ELSE MAKE_DATE(YEAR(o_orderdate), DAY(o_orderdate), MONTH(o_orderdate)) END AS ambiguous FROM orders")
def date_parsers(reg):
    day = F.col("o_orderdate").cast("date")
    written = lambda p: F.date_format(day, p)
    month = F.element_at(F.array(*map(F.lit, MONTH_LIST)), F.month(day))
    # with an American neighbour, a date that reads both ways is taken month first
    mixed = F.when(F.col("o_orderkey") % 2 == 1, written("M/d/yyyy")).otherwise(written("d/M/yyyy"))
    before = F.when(F.col("o_orderkey") % 2 == 1, F.lit("1/31/1990"))
    swapped = F.when(F.col("o_orderkey") % 2 == 1, text.ambiguous_slash_date(mixed, before)).otherwise(text.ambiguous_slash_date(written("d/M/yyyy"), F.lit("1/31/1990")))
    return raw(reg, "orders").select(
        "o_orderkey", text.iso_date(written("yyyy-MM-dd")).alias("iso"), text.slash_iso_date(written("yyyy/MM/dd")).alias("slash_iso"),
        text.dotted_date(F.when(F.col("o_orderkey") % 10 == 0, F.lit("31.02.2023")).otherwise(written("dd.MM.yyyy"))).alias("dotted"), text.slash_date(written("dd/MM/yyyy")).alias("slashed"),
        text.month_name_date(F.concat_ws(" ", F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))).alias("named"), swapped.alias("ambiguous"))


@query("version_tokens", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CASE o_orderkey % 4 WHEN 0 THEN '0' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.10' ELSE CAST(o_orderkey AS VARCHAR) || '/PL' END END AS version FROM orders")
def version_tokens(reg):
    n = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 4
    return raw(reg, "orders").select("o_orderkey", text.version_token(F.when(k == 0, F.concat(F.lit("0"), n)).when(k == 1, F.concat(n, F.lit(".10"))).when(k == 2, F.concat(n, F.lit("/PL"))).otherwise(F.concat(n, F.lit(".x")))).alias("version"))


@query("trademarks_stripped", "SELECT p_partkey, p_name AS name FROM part")
def trademarks_stripped(reg):
    return raw(reg, "part").select("p_partkey", text.without_marks(F.concat("p_name", F.lit(" ®™"))).alias("name"))


@query("hazard_codes", "SELECT o_orderkey AS source_id, CASE WHEN 200 + o_orderkey % 150 = 300 THEN 'H300' ELSE 'H' || CAST(200 + o_orderkey % 150 AS VARCHAR) || ';H300' END AS codes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def hazard_codes(reg):
    return reg.pages.where("page_no = 1").select("source_id", F.array_join(text.hazard_codes(F.col("text")), ";").alias("codes"))


@query("first_matches", "SELECT o_orderkey AS source_id, c_name AS name, CASE WHEN o_orderkey % 5 <> 1 THEN 'Data' ELSE 'Kod' END AS present FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def first_matches(reg):
    return reg.pages.where("page_no = 1").select("source_id", text.first_match(F.col("text"), r"Nazwa produktu:\s*(.+)").alias("name"), text.first_present(F.col("text"), "Data", "Kod").alias("present"))


@query("evidence_types", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'DOCUMENT' WHEN 5 THEN NULL ELSE 'PHOTO_SCAN' END AS evidence_type FROM orders")
def evidence_types(reg):
    names = F.element_at(F.array(*map(F.lit, ("a.MSG", "b/c.pdf", "d.jpg", "e.JPEG", "f.png", "g.txt"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return raw(reg, "orders").select("o_orderkey", text.evidence_type(names).alias("evidence_type"))


@query("fingerprints", """SELECT p_partkey, SHA256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}') AS fingerprint FROM part""")
def fingerprints(reg):
    return raw(reg, "part").select("p_partkey", text.fingerprint("p_name", "p_brand").alias("fingerprint"))


@query("plain_file_names", "SELECT position, NOT CONTAINS(source_file, '/') AS plain FROM b_batch_items")
def plain_file_names(reg):
    return reg.batch_items.select("position", text.plain_file_name(F.col("source_file")).alias("plain"))


@query("quantities", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS DECIMAL(18,6)) END AS quantity FROM lineitem")
def quantities(reg):
    written = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))).when(F.col("l_linenumber") % 3 == 2, F.lit("-1.5")).otherwise(F.lit(" "))
    return raw(reg, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.quantity(written).alias("quantity"))


@query("entry_lists", "SELECT p_partkey, p_name || ';' || p_brand AS entries FROM part")
def entry_lists(reg):
    return raw(reg, "part").select("p_partkey", F.array_join(text.entries(F.concat(F.lit(" \n "), F.col("p_name"), F.lit(" \r\n\n\t"), F.col("p_brand"), F.lit("\n"))), ";").alias("entries"))


# --- extraction from rendered pages; the columns that a page was rendered from are what it must give back

PAGES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def rules(reg) -> DataFrame:
    return extraction.rule_table(reg.spark)


@query("page_lines", "SELECT source_id, page_no, CAST(i - 1 AS INT) AS line_no, lines[i] AS line, TRIM(lines[i]) = '' AS blank, LENGTH(lines[i]) - LENGTH(LTRIM(lines[i])) AS indent FROM (SELECT source_id, page_no, lines, UNNEST(RANGE(1, LEN(lines) + 1)) AS i FROM (SELECT source_id, page_no, STRING_SPLIT(text, CHR(10)) AS lines FROM b_pages) t) u")
def page_lines(reg):
    return extraction.page_lines(reg.pages)


@query("page_readability", "SELECT source_id, COUNT(*) AS pages, 'READABLE' AS readability_status FROM b_pages GROUP BY source_id")
def page_readability(reg):
    return extraction.readability(reg.pages)


@query("page_segments", f"SELECT o_orderkey AS source_id, p AS page_no, CASE WHEN p = 2 AND o_orderkey % 5 = 4 THEN 2 ELSE 1 END AS document_no, CASE WHEN p = 2 AND o_orderkey % 5 = 4 THEN 2 ELSE 1 END AS page_from, CASE WHEN p = 1 AND o_orderkey % 5 = 4 THEN 1 ELSE 2 END AS page_to FROM {PAGES}, (SELECT UNNEST([1, 2]) AS p) t")
def page_segments(reg):
    return extraction.segments(extraction.labelled_lines(reg.pages))


@query("source_language", f"SELECT o_orderkey AS source_id, 'pl' AS language FROM {PAGES}")
def source_language(reg):
    return extraction.source_language(reg.pages)


LABELS = f"""lines AS (SELECT source_id, page_no, i - 1 AS line_no, lines[i] AS line FROM (SELECT source_id, page_no, lines, UNNEST(RANGE(1, LEN(lines) + 1)) AS i FROM (SELECT source_id, page_no, STRING_SPLIT(text, CHR(10)) AS lines FROM b_pages) t) u),
marked AS (SELECT *, NULLIF(REGEXP_EXTRACT(line, '^SEKCJA (\\d+):', 1), '') AS own_section, NULLIF(REGEXP_EXTRACT(line, '^(1\\.[1-4]) ', 1), '') AS own_sub FROM lines),
sections AS (SELECT *, LAST_VALUE(own_section IGNORE NULLS) OVER w AS section, CASE WHEN own_section IS NOT NULL THEN 'none' ELSE own_sub END AS heading FROM marked WINDOW w AS (PARTITION BY source_id, page_no ORDER BY line_no)),
labelled AS (SELECT *, LAST_VALUE(heading IGNORE NULLS) OVER (PARTITION BY source_id, page_no ORDER BY line_no) AS sub, MIN(CASE WHEN own_section IS NOT NULL THEN line_no END) OVER (PARTITION BY source_id, page_no) AS first_section,
 MAX(CASE WHEN TRIM(line) <> '' THEN line_no END) OVER (PARTITION BY source_id, page_no) AS last_line FROM sections)"""


@query("line_sections", f"WITH {LABELS} SELECT source_id, page_no, CAST(line_no AS INT) AS line_no, section, CASE WHEN sub IN ('1.1', '1.3') THEN sub END AS subsection FROM labelled")
def line_sections(reg):
    return extraction.labelled_lines(reg.pages).select("source_id", "page_no", "line_no", "section", "subsection")


@query("context_lines", f"""WITH {LABELS}, placed AS (SELECT source_id, page_no, line_no, TRIM(line) AS line, UNNEST(LIST_FILTER([CASE WHEN sub IN ('1.1', '1.3') THEN sub END, CASE WHEN line_no < COALESCE(first_section, 30) THEN 'HEADER' END, CASE WHEN line_no > last_line - 16 THEN 'FOOTER' END], lambda x: x IS NOT NULL)) AS context FROM labelled WHERE TRIM(line) <> '')
 SELECT source_id, page_no, CAST(line_no AS INT) AS line_no, line, context, LEAD(line) OVER (PARTITION BY source_id, page_no, context ORDER BY line_no) AS next_line FROM placed""")
def context_lines(reg):
    return extraction.context_lines(extraction.labelled_lines(reg.pages))


STATES = f"""base AS (SELECT o_orderkey AS source_id, o_orderkey % 5 AS v, c_name, n_name, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 9 AS VARCHAR) || '.0' AS version FROM {PAGES}),
documents_ AS (SELECT base.*, 'DOC-001' AS document_key FROM base UNION ALL SELECT base.*, 'DOC-002' FROM base WHERE v = 4),
states AS (
 SELECT source_id, document_key, 'product_name' AS field, 'FOUND' AS state, CASE document_key WHEN 'DOC-001' THEN c_name ELSE c_name || ' B' END AS value FROM documents_
 UNION ALL SELECT source_id, document_key, 'product_code', CASE WHEN document_key = 'DOC-002' THEN 'NOT_FOUND' WHEN v = 3 THEN 'UNREADABLE' ELSE 'FOUND' END, CASE WHEN document_key = 'DOC-001' AND v <> 3 THEN 'K' || CAST(o_custkey AS VARCHAR) END FROM documents_
 UNION ALL SELECT source_id, document_key, 'issue_date', CASE WHEN document_key = 'DOC-002' OR v = 1 THEN 'NOT_FOUND' ELSE 'FOUND' END, CASE WHEN document_key = 'DOC-001' AND v <> 1 THEN day END FROM documents_
 UNION ALL SELECT source_id, document_key, 'revision', CASE WHEN v = 2 THEN 'AMBIGUOUS' ELSE 'FOUND' END, CASE WHEN v <> 2 THEN version END FROM documents_
 UNION ALL SELECT source_id, document_key, 'EU_REPRESENTATIVE', CASE WHEN document_key = 'DOC-001' THEN 'FOUND' ELSE 'NOT_FOUND' END, CASE WHEN document_key = 'DOC-001' THEN n_name END FROM documents_
 UNION ALL SELECT source_id, document_key, UNNEST(['MANUFACTURER_EXPORTER', 'SUPPLIER']), 'NOT_FOUND', NULL FROM documents_)"""


@query("field_states", f"WITH {STATES} SELECT * FROM states")
def field_states(reg):
    return extraction.field_states(reg.pages, rules(reg))


@query("documents_assembled", f"""WITH {STATES} SELECT source_id, document_key, {', '.join(f"MAX(CASE WHEN field = '{f}' THEN {c} END) AS {n}" for f in ('product_name', 'product_code', 'issue_date', 'revision') for c, n in (('value', f), ('state', f + '_state')))},
 COUNT(CASE WHEN field IN ('EU_REPRESENTATIVE', 'MANUFACTURER_EXPORTER', 'SUPPLIER') AND state = 'FOUND' THEN 1 END) AS parties FROM states GROUP BY source_id, document_key""")
def documents_assembled(reg):
    return extraction.documents(extraction.field_states(reg.pages, rules(reg)))


@query("rule_hits", f"""WITH base AS (SELECT o_orderkey AS source_id, o_orderkey % 5 AS v, c_name, n_name, o_custkey, STRFTIME(o_orderdate, '%d.%m.%Y') AS dotted, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 9 AS VARCHAR) || '.0' AS version FROM {PAGES})
 SELECT source_id, 1 AS page_no, '1.1' AS context, 'A-001' AS alias_id, c_name AS raw, c_name AS value, 'Nazwa produktu: ' || c_name AS source_text FROM base
 UNION ALL SELECT source_id, 2, '1.1', 'A-001', c_name || ' B', c_name || ' B', 'Nazwa produktu: ' || c_name || ' B' FROM base WHERE v = 4
 UNION ALL SELECT source_id, 1, '1.1', 'A-002', CASE WHEN v = 3 THEN 'K�' ELSE 'K' END || CAST(o_custkey AS VARCHAR), CASE WHEN v = 3 THEN 'K�' ELSE 'K' END || CAST(o_custkey AS VARCHAR), 'Kod produktu: ' || CASE WHEN v = 3 THEN 'K�' ELSE 'K' END || CAST(o_custkey AS VARCHAR) FROM base
 UNION ALL SELECT source_id, 1, '1.3', 'A-004', n_name, n_name, 'EU Only Representative: ' || n_name FROM base
 UNION ALL SELECT source_id, 1, 'HEADER', 'A-011', dotted, day, 'Data aktualizacji: ' || dotted FROM base WHERE v <> 1
 UNION ALL SELECT source_id, 1, UNNEST(['HEADER', 'FOOTER']), 'A-006', version, version, 'Wersja: ' || version FROM base
 UNION ALL SELECT source_id, 2, 'FOOTER', 'A-006', CASE WHEN v = 2 THEN '77.7' ELSE version END, CASE WHEN v = 2 THEN '77.7' ELSE version END, 'Wersja: ' || CASE WHEN v = 2 THEN '77.7' ELSE version END FROM base""")
def rule_hits(reg):
    return extraction.rule_hits(extraction.context_lines(extraction.labelled_lines(reg.pages)), rules(reg)).select("source_id", "page_no", "context", "alias_id", "raw", "value", "source_text")


# --- transitions: one query for each new table, for the history, and for what is refused

REVISIONS = """checked AS (SELECT r.*, CASE WHEN r.product_id NOT IN (SELECT product_id FROM b_products) THEN 'PRODUCT_NOT_FOUND' WHEN TRIM(r.relative_path) = '' THEN 'SOURCE_PATH_REQUIRED' WHEN r.issue_date IS NULL OR TRIM(r.revision) = '' THEN 'ISSUE_DATE_AND_REVISION_REQUIRED'
 WHEN r.sds_id IN (SELECT sds_id FROM b_sds_documents) THEN 'SDS_ID_TAKEN' END AS why FROM b_revision_requests r), accepted AS (SELECT * FROM checked WHERE why IS NULL)"""
PRODUCTS = "p.product_id, p.product_name, p.manufacturer_product_code, p.manufacturer_id, p.use_description, p.use_restriction, {} AS usage_status, p.waste_type, p.waste_code"
HISTORY_ROW = "SELECT SHA256(CAST(a.product_id AS VARCHAR) || '/' || CAST(a.request_id AS VARCHAR)) AS history_id, a.product_id, {} AS usage_status, p.use_description, p.use_restriction, p.waste_type, p.waste_code, a.at AS changed_at"


def revised(reg):
    return transitions.register_revisions(reg.products, reg.sds_documents, reg.revision_requests)


@query("revisions_documents", f"""WITH {REVISIONS} SELECT sds_id, product_id, original_filename, relative_path, issue_date, revision, CASE WHEN document_status = 'CURRENT' AND product_id IN (SELECT product_id FROM accepted) THEN 'ARCHIVED' ELSE document_status END AS document_status, registered_at, file_status FROM b_sds_documents
 UNION ALL SELECT sds_id, product_id, CASE WHEN original_filename <> '' THEN original_filename ELSE REGEXP_EXTRACT(relative_path, '([^/]*)$', 1) END, relative_path, issue_date, revision, 'CURRENT', accepted.at, 'AVAILABLE' FROM accepted""")
def revisions_documents(reg):
    return revised(reg).tables["sds_documents"]


@query("revisions_products", f"WITH {REVISIONS} SELECT {PRODUCTS.format(chr(67) + 'ASE WHEN a.product_id IS NOT NULL THEN ' + repr('PENDING_APPROVAL') + ' ELSE p.usage_status END')} FROM b_products p LEFT JOIN accepted a ON a.product_id = p.product_id")
def revisions_products(reg):
    return revised(reg).tables["products"]


@query("revisions_history", f"WITH {REVISIONS} {HISTORY_ROW.format(repr('PENDING_APPROVAL'))} FROM accepted a JOIN b_products p ON p.product_id = a.product_id")
def revisions_history(reg):
    return revised(reg).history


@query("revisions_rejected", f"WITH {REVISIONS} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def revisions_rejected(reg):
    return revised(reg).rejected


DECIDED = """checked AS (SELECT r.*, CASE WHEN TRIM(r.original_filename) = '' THEN 'ORIGINAL_FILENAME_REQUIRED' WHEN p.product_id IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN s.sds_id IS NULL THEN 'SDS_NOT_FOUND' WHEN s.product_id <> r.product_id THEN 'SDS_OF_ANOTHER_PRODUCT'
 WHEN s.document_status <> 'CURRENT' THEN 'SDS_NOT_CURRENT' WHEN r.sds_id NOT IN (SELECT sds_id FROM b_safety_profiles) THEN 'SAFETY_DATA_MISSING' WHEN p.use_description IS NULL OR p.use_restriction IS NULL THEN 'USE_DATA_MISSING' WHEN r.evidence_relative_path LIKE '%.txt' THEN 'EVIDENCE_FORMAT' END AS why
 FROM b_decision_requests r LEFT JOIN b_products p ON p.product_id = r.product_id LEFT JOIN b_sds_documents s ON s.sds_id = r.sds_id), accepted AS (SELECT * FROM checked WHERE why IS NULL)"""


def decided(reg):
    return transitions.register_decisions(reg.products, reg.sds_documents, reg.safety_profiles, reg.bhp_decisions, reg.decision_evidence, reg.decision_requests)


@query("decisions_registered", f"""WITH {DECIDED} SELECT decision_id, product_id, sds_id, decision_status, notes, registered_at, CASE WHEN record_status = 'CURRENT' AND sds_id IN (SELECT sds_id FROM accepted) THEN 'SUPERSEDED' ELSE record_status END AS record_status, evidence_id FROM b_bhp_decisions
 UNION ALL SELECT request_id, product_id, sds_id, decision_status, notes, accepted.at, 'CURRENT', request_id FROM accepted""")
def decisions_registered(reg):
    return decided(reg).tables["bhp_decisions"]


@query("decisions_evidence", f"""WITH {DECIDED} SELECT evidence_id, original_filename, relative_path, evidence_type, file_format, file_status FROM b_decision_evidence UNION ALL
 SELECT request_id, original_filename, evidence_relative_path, CASE product_id % 5 WHEN 0 THEN 'EMAIL' WHEN 2 THEN 'PHOTO_SCAN' ELSE 'DOCUMENT' END, CASE product_id % 5 WHEN 0 THEN 'MSG' WHEN 2 THEN 'JPEG' ELSE 'PDF' END, 'AVAILABLE' FROM accepted""")
def decisions_evidence(reg):
    return decided(reg).tables["decision_evidence"]


STATUS_GIVEN = "CASE a.decision_status WHEN 'APPROVED' THEN 'ACTIVE' ELSE 'REJECTED' END"


@query("decisions_products", f"WITH {DECIDED} SELECT {PRODUCTS.format(f'CASE WHEN a.product_id IS NULL THEN p.usage_status ELSE {STATUS_GIVEN} END')} FROM b_products p LEFT JOIN accepted a ON a.product_id = p.product_id")
def decisions_products(reg):
    return decided(reg).tables["products"]


@query("decisions_history", f"WITH {DECIDED} {HISTORY_ROW.format(STATUS_GIVEN)} FROM accepted a JOIN b_products p ON p.product_id = a.product_id")
def decisions_history(reg):
    return decided(reg).history


@query("decisions_rejected", f"WITH {DECIDED} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def decisions_rejected(reg):
    return decided(reg).rejected


WITHDRAWAL = """checked AS (SELECT r.*, p.usage_status AS old_status, CASE WHEN TRIM(reason_text) = '' THEN 'REASON_REQUIRED'
 WHEN expected_status NOT IN ('CURRENT', 'ARCHIVED') OR (mode = 'ARCHIVED_ONLY') <> (expected_status = 'ARCHIVED') OR (mode = 'RESTORE_ARCHIVED') <> (restored_sds_id IS NOT NULL) OR COALESCE(restored_sds_id = r.sds_id, FALSE) THEN 'MODE_DOES_NOT_FIT'
 WHEN p.product_id IS NULL THEN 'STALE_PRODUCT' WHEN t.sds_id IS NULL OR t.product_id <> r.product_id OR t.document_status <> r.expected_status THEN 'STALE_DOCUMENT'
 WHEN (SELECT MIN(sds_id) FROM b_sds_documents c WHERE c.product_id = r.product_id AND c.document_status = 'CURRENT') IS DISTINCT FROM expected_current_sds_id THEN 'STALE_CURRENT'
 WHEN r.sds_id IN (SELECT invalidated_sds_id FROM b_sds_invalidation) THEN 'ALREADY_INVALIDATED' WHEN mode = 'RESTORE_ARCHIVED' AND (b.sds_id IS NULL OR b.product_id <> r.product_id OR b.document_status <> 'ARCHIVED') THEN 'STALE_RESTORED' END AS why
 FROM b_invalidation_requests r LEFT JOIN b_products p ON p.product_id = r.product_id LEFT JOIN b_sds_documents t ON t.sds_id = r.sds_id LEFT JOIN b_sds_documents b ON b.sds_id = r.restored_sds_id),
accepted AS (SELECT * FROM checked WHERE why IS NULL), waits AS (SELECT * FROM accepted WHERE expected_status = 'CURRENT' AND old_status <> 'PENDING_APPROVAL')"""


def withdrawn(reg):
    return transitions.invalidate(reg.products, reg.sds_documents, reg.bhp_decisions, reg.sds_invalidation, reg.invalidation_requests)


@query("invalidation_documents", f"""WITH {WITHDRAWAL} SELECT sds_id, product_id, original_filename, relative_path, issue_date, revision, CASE WHEN sds_id IN (SELECT sds_id FROM accepted) THEN 'INVALIDATED' WHEN sds_id IN (SELECT restored_sds_id FROM accepted WHERE restored_sds_id IS NOT NULL) THEN 'CURRENT' ELSE document_status END AS document_status,
 registered_at, file_status FROM b_sds_documents""")
def invalidation_documents(reg):
    return withdrawn(reg).tables["sds_documents"]


@query("invalidation_decisions", f"""WITH {WITHDRAWAL} SELECT decision_id, product_id, sds_id, decision_status, notes, registered_at, CASE WHEN record_status = 'CURRENT' AND sds_id IN (SELECT sds_id FROM accepted WHERE expected_status = 'CURRENT' UNION SELECT restored_sds_id FROM accepted WHERE expected_status = 'CURRENT' AND restored_sds_id IS NOT NULL)
 THEN 'SUPERSEDED' ELSE record_status END AS record_status, evidence_id FROM b_bhp_decisions""")
def invalidation_decisions(reg):
    return withdrawn(reg).tables["bhp_decisions"]


@query("invalidation_products", f"WITH {WITHDRAWAL} SELECT {PRODUCTS.format(chr(67) + 'ASE WHEN a.product_id IS NOT NULL THEN ' + repr('PENDING_APPROVAL') + ' ELSE p.usage_status END')} FROM b_products p LEFT JOIN waits a ON a.product_id = p.product_id")
def invalidation_products(reg):
    return withdrawn(reg).tables["products"]


@query("invalidation_audit", f"WITH {WITHDRAWAL} SELECT invalidation_id, product_id, invalidated_sds_id, invalidated_from_status, restored_sds_id, reason, invalidated_at FROM b_sds_invalidation UNION ALL SELECT request_id, product_id, sds_id, expected_status, restored_sds_id, TRIM(reason_text), accepted.at FROM accepted")
def invalidation_audit(reg):
    return withdrawn(reg).tables["sds_invalidation"]


@query("invalidation_history", f"WITH {WITHDRAWAL} {HISTORY_ROW.format(repr('PENDING_APPROVAL'))} FROM waits a JOIN b_products p ON p.product_id = a.product_id")
def invalidation_history(reg):
    return withdrawn(reg).history


@query("invalidation_rejected", f"WITH {WITHDRAWAL} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def invalidation_rejected(reg):
    return withdrawn(reg).rejected


def administered(reg):
    return transitions.update_administrative(reg.products, reg.administrative_requests)


@query("administrative_products", "SELECT p.product_id, p.product_name, p.manufacturer_product_code, p.manufacturer_id, " + ", ".join(f"CASE WHEN r.request_id IS NULL THEN p.{c} ELSE r.{c} END AS {c}" for c in ("use_description", "use_restriction", "waste_type", "waste_code")) + ", p.usage_status FROM b_products p LEFT JOIN b_administrative_requests r ON r.product_id = p.product_id")
def administrative_products(reg):
    return administered(reg).tables["products"]


@query("administrative_history", "SELECT SHA256(CAST(p.product_id AS VARCHAR) || '/' || CAST(r.request_id AS VARCHAR)) AS history_id, p.product_id, p.usage_status, r.use_description, r.use_restriction, r.waste_type, r.waste_code, r.at AS changed_at FROM b_products p JOIN b_administrative_requests r ON r.product_id = p.product_id")
def administrative_history(reg):
    return administered(reg).history


@query("administrative_rejected", "SELECT request_id, 'PRODUCT_NOT_FOUND' AS reason FROM b_administrative_requests WHERE product_id NOT IN (SELECT product_id FROM b_products)")
def administrative_rejected(reg):
    return administered(reg).rejected


def relocated(reg):
    return transitions.set_location_status(reg.usage_locations, reg.location_requests)


@query("location_states", "SELECT l.location_id, l.location_code, l.location_name, COALESCE(r.new_status, l.status) AS status FROM b_usage_locations l LEFT JOIN b_location_requests r ON r.location_id = l.location_id AND r.new_status IN ('ACTIVE', 'INACTIVE')")
def location_states(reg):
    return relocated(reg).tables["usage_locations"]


@query("location_state_history", "SELECT r.request_id AS history_id, r.location_id, r.new_status AS status, r.at AS changed_at FROM b_location_requests r JOIN b_usage_locations l ON l.location_id = r.location_id WHERE r.new_status <> 'CLOSED'")
def location_state_history(reg):
    return relocated(reg).history


@query("location_rejected", "SELECT request_id, CASE WHEN location_id NOT IN (SELECT location_id FROM b_usage_locations) THEN 'LOCATION_NOT_FOUND' ELSE 'STATUS_NOT_ALLOWED' END AS reason FROM b_location_requests WHERE location_id NOT IN (SELECT location_id FROM b_usage_locations) OR new_status = 'CLOSED'")
def location_rejected(reg):
    return relocated(reg).rejected


POPULATION = "SELECT a.product_id, a.location_id, a.peak_quantity_value, a.peak_quantity_unit_id FROM b_product_usage_locations a JOIN b_usage_locations l ON l.location_id = a.location_id WHERE l.status = 'ACTIVE'"


def opened(reg, only_final: bool):
    rows = reg.physical_reviews.where("status = 'FINAL'") if only_final else reg.physical_reviews
    return transitions.create_review(rows, reg.physical_review_items, reviews.review_population(reg), 99999, F.to_date(F.lit("1999-01-01")), F.lit(dt.datetime(1999, 1, 1)).cast("timestamp_ntz"))


@query("review_snapshot", f"SELECT review_item_id, review_id, product_id, location_id, baseline_max_quantity, baseline_unit_id, observed_quantity FROM b_physical_review_items UNION ALL SELECT '99999/' || CAST(product_id AS VARCHAR) || '/' || CAST(location_id AS VARCHAR), 99999, product_id, location_id, peak_quantity_value, peak_quantity_unit_id, NULL FROM ({POPULATION}) t")
def review_snapshot(reg):
    return opened(reg, True).tables["physical_review_items"]


@query("review_opened", "SELECT review_id, review_date, status, created_at, finalized_at FROM b_physical_reviews WHERE status = 'FINAL' UNION ALL SELECT 99999, DATE '1999-01-01', 'DRAFT', TIMESTAMP '1999-01-01 00:00:00', NULL")
def review_opened(reg):
    return opened(reg, True).tables["physical_reviews"]


@query("review_refused", "SELECT 99999 AS request_id, 'DRAFT_EXISTS' AS reason FROM b_physical_reviews WHERE status = 'DRAFT' LIMIT 1")
def review_refused(reg):
    return opened(reg, False).rejected


def observed(reg):
    return transitions.record_observed(reg.physical_reviews, reg.physical_review_items, reg.observation_requests)


OBSERVED = """asked AS (SELECT q.request_id, q.review_item_id, q.observed_quantity, CASE WHEN i.review_item_id IS NULL THEN 'ITEM_NOT_FOUND' WHEN r.status <> 'DRAFT' THEN 'REVIEW_IS_FINAL' WHEN q.observed_quantity < 0 THEN 'NEGATIVE_QUANTITY' END AS reason
 FROM b_observation_requests q LEFT JOIN b_physical_review_items i ON i.review_item_id = q.review_item_id LEFT JOIN b_physical_reviews r ON r.review_id = i.review_id)"""


@query("review_observed", f"WITH {OBSERVED} SELECT i.review_item_id, i.review_id, i.product_id, i.location_id, i.baseline_max_quantity, i.baseline_unit_id, CASE WHEN a.request_id IS NULL THEN i.observed_quantity ELSE a.observed_quantity END AS observed_quantity FROM b_physical_review_items i LEFT JOIN asked a ON a.review_item_id = i.review_item_id AND a.reason IS NULL")
def review_observed(reg):
    return observed(reg).tables["physical_review_items"]


@query("review_observed_rejected", f"WITH {OBSERVED} SELECT request_id, reason FROM asked WHERE reason IS NOT NULL")
def review_observed_rejected(reg):
    return observed(reg).rejected


DRAFT = "(SELECT MAX(review_id) FROM b_physical_reviews)"


def draft_id(reg) -> int:
    return reg.physical_reviews.agg(F.max("review_id")).first()[0]


@query("review_finalized", "SELECT review_id, review_date, 'FINAL' AS status, created_at, CASE WHEN status = 'FINAL' THEN finalized_at ELSE TIMESTAMP '1999-01-01 00:00:00' END AS finalized_at FROM b_physical_reviews")
def review_finalized(reg):
    return transitions.finalize_review(reg.physical_reviews, draft_id(reg), F.lit(dt.datetime(1999, 1, 1)).cast("timestamp_ntz"))


@query("review_discarded", f"SELECT * FROM b_physical_review_items WHERE review_id <> {DRAFT}")
def review_discarded(reg):
    return transitions.discard_draft(reg.physical_reviews, reg.physical_review_items, draft_id(reg))[1]


BLOCKED = "SELECT product_id FROM b_sds_invalidation UNION SELECT product_id FROM b_physical_review_items"


def deleted(reg):
    tables = {t: getattr(reg, t) for t in ("products", "sds_documents", "bhp_decisions", "product_usage_locations", "product_history", "sds_invalidation")}
    return transitions.delete_products(tables | {"physical_review_items": reg.physical_review_items.where("location_id % 10 = 0")}, reg.delete_requests)


GOING = "going AS (SELECT product_id FROM b_delete_requests WHERE product_id IN (SELECT product_id FROM b_products) AND product_id NOT IN (SELECT product_id FROM b_sds_invalidation UNION SELECT product_id FROM b_physical_review_items WHERE location_id % 10 = 0))"


@query("products_deleted", f"WITH {GOING} SELECT product_id FROM b_products WHERE product_id NOT IN (SELECT product_id FROM going)")
def products_deleted(reg):
    return deleted(reg).tables["products"].select("product_id")


@query("documents_deleted", f"WITH {GOING} SELECT sds_id FROM b_sds_documents WHERE product_id NOT IN (SELECT product_id FROM going)")
def documents_deleted(reg):
    return deleted(reg).tables["sds_documents"].select("sds_id")


@query("deletions_rejected", f"WITH {GOING} SELECT request_id, CASE WHEN product_id IN (SELECT product_id FROM b_products) THEN 'STILL_REFERENCED' ELSE 'PRODUCT_NOT_FOUND' END AS reason FROM b_delete_requests WHERE product_id NOT IN (SELECT product_id FROM going)")
def deletions_rejected(reg):
    return deleted(reg).rejected


# --- more transitions

CODES = """checked AS (SELECT r.*, p.product_name, p.manufacturer_id, CASE WHEN TRIM(r.code) = '' THEN 'CODE_REQUIRED' WHEN p.product_id IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN p.manufacturer_product_code IS NOT NULL THEN 'CODE_KNOWN' END AS why
 FROM b_code_requests r LEFT JOIN b_products p ON p.product_id = r.product_id)"""


def coded(reg):
    return registration.complete_codes(reg.products, reg.code_requests)


@query("codes_completed", f"WITH {CODES} SELECT p.product_id, COALESCE(TRIM(c.code), p.manufacturer_product_code) AS manufacturer_product_code FROM b_products p LEFT JOIN checked c ON c.product_id = p.product_id AND c.why IS NULL")
def codes_completed(reg):
    return coded(reg).tables["products"].select("product_id", "manufacturer_product_code")


@query("codes_audit", f"WITH {CODES} SELECT request_id AS change_id, product_id, 'CODE_COMPLETION' AS change_kind, product_name AS old_product_name, product_name AS new_product_name, NULL AS old_manufacturer_product_code, TRIM(code) AS new_manufacturer_product_code, manufacturer_id AS old_manufacturer_id, manufacturer_id AS new_manufacturer_id, checked.at AS changed_at FROM checked WHERE why IS NULL")
def codes_audit(reg):
    return coded(reg).history


@query("codes_rejected", f"WITH {CODES} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def codes_rejected(reg):
    return coded(reg).rejected


CORRECTED = """makers AS (SELECT manufacturer_name, COUNT(*) AS n, MIN(manufacturer_id) AS id FROM b_manufacturers_twice GROUP BY manufacturer_name),
asked AS (SELECT r.*, p.product_name AS old_name, p.manufacturer_product_code AS old_code, CAST(p.manufacturer_id AS VARCHAR) AS old_maker, p.product_id AS found, m.n, COALESCE(CAST(m.id AS VARCHAR), SHA256(r.manufacturer_name)) AS maker
 FROM b_correction_requests r LEFT JOIN b_products p ON p.product_id = r.product_id LEFT JOIN makers m ON m.manufacturer_name = r.manufacturer_name),
checked AS (SELECT *, CASE WHEN found IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN old_code IS NULL AND code IS NOT NULL THEN 'CODE_COMPLETION_IS_SEPARATE' WHEN n > 1 THEN 'MANUFACTURER_AMBIGUOUS'
 WHEN product_name = old_name AND code IS NOT DISTINCT FROM old_code AND maker = old_maker THEN 'NO_CHANGE' END AS why FROM asked)"""


def corrected(reg):
    return registration.correct_identities(reg.products, reg.manufacturers_twice, reg.correction_requests)


@query("corrections_products", f"WITH {CORRECTED} SELECT p.product_id, CASE WHEN c.request_id IS NULL THEN p.product_name ELSE c.product_name END AS product_name, CASE WHEN c.request_id IS NULL THEN p.manufacturer_product_code ELSE c.code END AS manufacturer_product_code, CASE WHEN c.request_id IS NULL THEN CAST(p.manufacturer_id AS VARCHAR) ELSE c.maker END AS manufacturer_id FROM b_products p LEFT JOIN checked c ON c.product_id = p.product_id AND c.why IS NULL")
def corrections_products(reg):
    return corrected(reg).tables["products"].select("product_id", "product_name", "manufacturer_product_code", "manufacturer_id")


@query("corrections_manufacturers", f"WITH {CORRECTED} SELECT CAST(manufacturer_id AS VARCHAR) AS manufacturer_id, manufacturer_name FROM b_manufacturers_twice UNION ALL SELECT DISTINCT maker, manufacturer_name FROM checked WHERE why IS NULL AND n IS NULL")
def corrections_manufacturers(reg):
    return corrected(reg).tables["manufacturers"]


@query("corrections_audit", f"WITH {CORRECTED} SELECT request_id AS change_id, product_id, 'CORRECTION' AS change_kind, old_name AS old_product_name, product_name AS new_product_name, old_code AS old_manufacturer_product_code, code AS new_manufacturer_product_code, CAST(old_maker AS BIGINT) AS old_manufacturer_id, maker AS new_manufacturer_id, checked.at AS changed_at FROM checked WHERE why IS NULL")
def corrections_audit(reg):
    return corrected(reg).history


@query("corrections_rejected", f"WITH {CORRECTED} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def corrections_rejected(reg):
    return corrected(reg).rejected


@query("resolved_identities", """WITH makers AS (SELECT manufacturer_name, COUNT(*) AS n, MIN(manufacturer_id) AS id FROM b_manufacturers_twice GROUP BY manufacturer_name),
a AS (SELECT r.*, m.n, CASE WHEN COALESCE(m.n, 0) < 2 THEN COALESCE(CAST(m.id AS VARCHAR), SHA256(r.manufacturer_name)) END AS maker FROM b_correction_requests r LEFT JOIN makers m ON m.manufacturer_name = r.manufacturer_name),
b AS (SELECT a.*, (SELECT CAST(MIN(p.product_id) AS VARCHAR) FROM b_products p WHERE p.product_name = a.product_name AND p.manufacturer_product_code = a.code AND CAST(p.manufacturer_id AS VARCHAR) = a.maker) AS found FROM a)
SELECT request_id, maker AS manufacturer_id, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'LINKED' ELSE 'CREATED' END AS manufacturer_action, CASE WHEN maker IS NOT NULL THEN COALESCE(found, SHA256(product_name || CHR(1) || COALESCE(code, CHR(0)) || CHR(1) || maker)) END AS product_id,
 CASE WHEN maker IS NULL THEN 'REJECTED' WHEN found IS NOT NULL THEN 'LINKED' ELSE 'CREATED' END AS product_action FROM b""")
def resolved_identities(reg):
    return registration.resolve_or_create(reg.products, reg.manufacturers_twice, reg.correction_requests)


CODED = "CASE WHEN REGEXP_FULL_MATCH(UPPER(TRIM({0})), '[A-Z0-9][A-Z0-9_-]{{0,31}}') THEN UPPER(TRIM({0})) END"
PLACES = f"""asked AS (SELECT *, {CODED.format('location_code')} AS code FROM b_new_locations), checked AS (SELECT *, CASE WHEN code IS NULL THEN 'CODE_FORMAT' WHEN code IN (SELECT location_code FROM b_usage_locations WHERE location_code IS NOT NULL)
 OR request_id <> MIN(request_id) OVER (PARTITION BY code) THEN 'CODE_TAKEN' END AS why FROM asked)"""


@query("locations_created", f"WITH {PLACES} SELECT location_id, location_code, location_name, status FROM b_usage_locations UNION ALL SELECT location_id, code, location_name, 'ACTIVE' FROM checked WHERE why IS NULL")
def locations_created(reg):
    return registration.create_locations(reg.usage_locations, reg.new_locations).tables["usage_locations"]


@query("locations_refused", f"WITH {PLACES} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def locations_refused(reg):
    return registration.create_locations(reg.usage_locations, reg.new_locations).rejected


LEGACY = f"""asked AS (SELECT r.request_id, r.location_id, {CODED.format('r.location_code')} AS code, l.location_id AS found, l.location_code AS old FROM b_legacy_codes r LEFT JOIN b_usage_locations l ON l.location_id = r.location_id),
checked AS (SELECT *, CASE WHEN found IS NULL THEN 'LOCATION_NOT_FOUND' WHEN old IS NOT NULL THEN 'CODE_ASSIGNED' WHEN code IS NULL THEN 'CODE_FORMAT' WHEN code IN (SELECT location_code FROM b_usage_locations WHERE location_code IS NOT NULL) OR request_id <> MIN(request_id) OVER (PARTITION BY code) THEN 'CODE_TAKEN' END AS why FROM asked)"""


@query("legacy_codes", f"WITH {LEGACY} SELECT l.location_id, COALESCE(c.code, l.location_code) AS location_code FROM b_usage_locations l LEFT JOIN checked c ON c.location_id = l.location_id AND c.why IS NULL")
def legacy_codes(reg):
    return registration.assign_legacy_codes(reg.usage_locations, reg.legacy_codes).tables["usage_locations"].select("location_id", "location_code")


@query("legacy_codes_rejected", f"WITH {LEGACY} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def legacy_codes_rejected(reg):
    return registration.assign_legacy_codes(reg.usage_locations, reg.legacy_codes).rejected


def quantity_sql(requests: str, new: bool) -> str:
    place = "WHEN l.location_id IS NULL THEN 'LOCATION_NOT_FOUND' WHEN l.status <> 'ACTIVE' THEN 'LOCATION_INACTIVE' " if new else ""
    there = "WHEN a.product_id IS NOT NULL THEN 'ALREADY_ASSIGNED'" if new else "WHEN a.product_id IS NULL THEN 'ASSIGNMENT_NOT_FOUND'"
    active = "(SELECT unit_id FROM b_units_some WHERE status = 'ACTIVE')"
    return f"""checked AS (SELECT r.*, CASE {place}WHEN r.peak_quantity_value < 0 OR COALESCE(r.monthly_consumption_value < 0, FALSE) THEN 'QUANTITY_NOT_ALLOWED' WHEN (r.monthly_consumption_value IS NULL) <> (r.monthly_consumption_unit_id IS NULL) THEN 'MONTHLY_PAIR'
 WHEN r.peak_quantity_unit_id NOT IN {active} OR COALESCE(r.monthly_consumption_unit_id NOT IN {active}, FALSE) THEN 'UNIT_INACTIVE' {there} END AS why
 FROM {requests} r LEFT JOIN b_usage_locations l ON l.location_id = r.location_id LEFT JOIN b_product_usage_locations a ON a.product_id = r.product_id AND a.location_id = r.location_id)"""


QUANTITY_COLUMNS = ", ".join(registration.QUANTITIES)


def measured(reg, new: bool):
    return registration.set_quantities(reg.product_usage_locations, reg.usage_locations, reg.units_some, reg.assign_requests if new else reg.quantity_requests, new)


@query("quantities_updated", f"WITH {quantity_sql('b_quantity_requests', False)} SELECT p.product_id, p.location_id, {', '.join(f'CASE WHEN c.request_id IS NULL THEN p.{q} ELSE c.{q} END AS {q}' for q in registration.QUANTITIES)} FROM b_product_usage_locations p LEFT JOIN checked c ON c.product_id = p.product_id AND c.location_id = p.location_id AND c.why IS NULL")
def quantities_updated(reg):
    return measured(reg, False).tables["product_usage_locations"]


@query("quantities_rejected", f"WITH {quantity_sql('b_quantity_requests', False)} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def quantities_rejected(reg):
    return measured(reg, False).rejected


@query("quantities_assigned", f"WITH {quantity_sql('b_assign_requests', True)} SELECT product_id, location_id, {QUANTITY_COLUMNS} FROM b_product_usage_locations UNION ALL SELECT product_id, location_id, {QUANTITY_COLUMNS} FROM checked WHERE why IS NULL")
def quantities_assigned(reg):
    return measured(reg, True).tables["product_usage_locations"]


@query("assignment_history", f"WITH {quantity_sql('b_assign_requests', True)} SELECT request_id AS history_id, product_id, location_id, {QUANTITY_COLUMNS}, checked.at AS changed_at FROM checked WHERE why IS NULL")
def assignment_history(reg):
    return measured(reg, True).history


@query("assignments_rejected", f"WITH {quantity_sql('b_assign_requests', True)} SELECT request_id, why AS reason FROM checked WHERE why IS NOT NULL")
def assignments_rejected(reg):
    return measured(reg, True).rejected


# --- evidence, gates and the section-wise draft

def evidence_fields(reg) -> DataFrame:
    """The header fields of the bound evidence in long form, each with one proof where it was found."""
    names = ("name", "code", "issue_date", "revision")
    field = lambda n: F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.col(f"{n}_state").alias("state"))
    rows = reg.evidence.select("evidence_id", F.explode(F.array(*map(field, names))).alias("f")).select("evidence_id", "f.*")
    proof = F.struct(F.lit(1).alias("page"), F.lit("1").alias("section"), F.when(F.col("field").isin("name", "code"), "1.1").alias("subsection"), F.col("field").alias("label"), F.col("value").alias("source_text"))
    return rows.withColumns({"domain_value": F.when(F.col("evidence_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.lower("value")), "has_domain": F.col("evidence_id") % 3 == 0, "evidence": F.when(F.col("state") == "FOUND", F.array(proof)).otherwise(F.array().cast("array<struct<page:int,section:string,subsection:string,label:string,source_text:string>>"))})


FIELDS = "fields AS (" + " UNION ALL ".join(f"SELECT evidence_id, '{n}' AS field, {n} AS value, {n}_state AS state, '{'1 / 1.1' if n in ('name', 'code') else '1'} / {n}' AS context FROM b_evidence" for n in ("name", "code", "issue_date", "revision")) + ")"


@query("evidence_flat", f"WITH {FIELDS} SELECT evidence_id, field, CASE WHEN evidence_id % 3 = 0 THEN CASE WHEN evidence_id % 4 = 0 THEN NULL ELSE LOWER(value) END ELSE value END AS value, state, CASE WHEN state = 'FOUND' THEN 1 END AS page, CASE WHEN state = 'FOUND' THEN context ELSE '' END AS context, CASE WHEN state = 'FOUND' THEN value END AS source_text FROM fields")
def evidence_flat(reg):
    return evidence.flat(evidence_fields(reg))


@query("value_provenance", f"WITH {FIELDS}, p AS (SELECT *, CASE WHEN state = 'FOUND' THEN CASE WHEN evidence_id % 3 = 0 THEN CASE WHEN evidence_id % 4 = 0 THEN NULL ELSE LOWER(value) END ELSE value END END AS proposed, CASE WHEN evidence_id % 5 = 0 THEN NULL WHEN evidence_id % 5 = 1 THEN 'x' ELSE value END AS chosen FROM fields) "
       "SELECT evidence_id, field, CASE WHEN chosen IS NULL THEN CASE WHEN proposed IS NULL THEN 'NO_DECISION' ELSE 'NO_DECISION_PROPOSED' END WHEN chosen IS NOT DISTINCT FROM proposed THEN 'FROM_EVIDENCE' ELSE 'BY_HAND' END AS provenance FROM p")
def value_provenance(reg):
    chosen = F.when(F.col("evidence_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("evidence_id") % 5 == 1, "x").otherwise(F.col("value"))
    return evidence_fields(reg).select("evidence_id", "field", evidence.provenance(chosen, F.col("value"), F.col("domain_value"), F.col("has_domain"), F.col("state")).alias("provenance"))


@query("header_completeness", "SELECT evidence_id, name_state = 'FOUND' AND issue_date_state = 'FOUND' AND manufacturers = 1 AND manufacturer_state = 'FOUND' AND code_state <> 'AMBIGUOUS' AS complete FROM b_evidence")
def header_completeness(reg):
    named = evidence_fields(reg).select("evidence_id", F.when(F.col("field") == "name", "product_name").when(F.col("field") == "code", "product_code").otherwise(F.col("field")).alias("field"), "state", F.size("evidence").alias("proofs"))
    makers = reg.evidence.select("evidence_id", F.lit("MANUFACTURER").alias("field"), F.col("manufacturer_state").alias("state"), F.explode(F.sequence(F.lit(1), F.col("manufacturers"))).alias("proofs"))
    return evidence.header_complete(named.unionByName(makers))


@query("proof_issues", "SELECT source_id, field, page_no, CASE WHEN page_no = 3 THEN 'PAGE_OUTSIDE_SOURCE' WHEN source_text = '' THEN 'QUOTE_EMPTY' ELSE 'QUOTE_NOT_ON_PAGE' END AS issue FROM b_proofs WHERE page_no = 3 OR source_text = '' OR source_text = 'Nazwa produktu: other'")
def proof_issues(reg):
    return evidence.proof_issues(reg.proofs, reg.pages)


ROLES = ("MANUFACTURER", "MANUFACTURER_EXPORTER", "SUPPLIER", "IMPORTER", "DISTRIBUTOR", "EU_REPRESENTATIVE", "OTHER")


@query("role_gate", f"""WITH p AS (SELECT source_id, MAX(CASE WHEN role NOT IN {ROLES} THEN 1 ELSE 0 END) = 1 AS invalid, MAX(CASE WHEN role = 'MANUFACTURER' THEN 1 ELSE 0 END) = 0 AS missing, COUNT(*) > COUNT(DISTINCT role || '|' || LOWER(name)) AS twice FROM b_parties GROUP BY source_id)
 SELECT source_id, CONCAT_WS(';', CASE WHEN invalid THEN 'INVALID_ROLE' END, CASE WHEN twice THEN 'DUPLICATE_PARTY' END, CASE WHEN missing THEN 'MANUFACTURER_MISSING' END) AS issues, CASE WHEN invalid THEN 'FAIL' ELSE 'PASS' END AS status FROM p""")
def role_gate(reg):
    return evidence.role_issues(reg.parties, ROLES)


def own_section(reg, number: int) -> DataFrame:
    return evidence.section_texts(reg.safety_pages).select("source_id", evidence.section(F.col("text"), number).alias("text"))


@query("safety_draft", """SELECT o_orderkey AS source_id, 'Mieszanina ' || CAST(o_custkey AS VARCHAR) AS product_definition, CASE WHEN o_orderkey % 3 = 0 THEN 'NO' END AS hazardous_classification_status, o_orderpriority AS clp_classification_text, CASE WHEN o_orderkey % 3 <> 0 THEN 'Uwaga' END AS signal_word,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'H225;H' || CAST(300 + o_orderkey % 100 AS VARCHAR) END AS hazard_statements, '' AS supplemental_hazard_statements, 'NO_DATA' AS pbt_status, 'NO_DATA' AS vpvb_status, 'NO_DATA' AS endocrine_section_2_status,
 'NO_DATA' AS carcinogenicity_status, 'NO_DATA' AS germ_cell_mutagenicity_status, 'NO_DATA' AS reproductive_toxicity_status, 'NO_DATA' AS endocrine_section_11_status, 'NO_DATA' AS skin_sensitization_status, 'NO_DATA' AS respiratory_sensitization_status FROM orders""")
def safety_draft(reg):
    return evidence.safety_draft(own_section(reg, 2))


@query("components", """SELECT o_orderkey AS source_id, 1 AS ordinal, 'Part ' || CAST(o_custkey AS VARCHAR) AS component_name, CAST(100 + o_orderkey % 900 AS VARCHAR) || '-00-0' AS cas_number, '200-' || CAST(o_orderkey % 100 AS VARCHAR) || '-1' AS ec_number, '01-' || CAST(o_orderkey AS VARCHAR) AS reach_registration_number,
 CAST(NULL AS VARCHAR) AS concentration_text, 'Flam. Liq. 2, H225' AS classification_text, 'H225' AS hazard_statements FROM orders UNION ALL SELECT o_orderkey, 2, 'Flam. Liq. 2, H225', '7-11-9', '300-' || CAST(o_orderkey % 100 AS VARCHAR) || '-2', NULL, '<', NULL, '' FROM orders WHERE o_orderkey % 2 = 0""")
def components(reg):
    return evidence.components(own_section(reg, 3))


# --- sources of evidence and frozen decisions

@query("source_binding", """WITH m AS (SELECT json_file, COUNT(*) AS n, MIN(source_file) AS name, MIN(sha256) AS sha FROM b_bound_manifest GROUP BY json_file)
 SELECT s.json_file, CASE WHEN s.file_name IS NULL OR CONTAINS(s.file_name, '/') OR NOT ENDS_WITH(LOWER(s.file_name), '.pdf') OR LENGTH(s.sha256) <> 64 THEN 'INVALID_SOURCE' WHEN m.n > 1 OR m.name <> s.file_name OR m.sha <> s.sha256 THEN 'PDF_MISMATCH'
 WHEN m.n IS NOT NULL AND t.file_name IS NOT NULL THEN CASE WHEN t.is_pdf AND t.sha256 = s.sha256 THEN 'AUTO_BOUND' ELSE 'PDF_MISMATCH' END WHEN f.json_file IS NULL THEN 'FALLBACK_REQUIRED' WHEN f.file_name = 'given.PDF' AND f.sha256 = s.sha256 THEN 'MANUAL_BOUND' ELSE 'PDF_MISMATCH' END AS status
 FROM b_bound_sources s LEFT JOIN m ON m.json_file = s.json_file LEFT JOIN b_bound_stored t ON t.file_name = s.file_name LEFT JOIN b_bound_fallback f ON f.json_file = s.json_file""")
def source_binding(reg):
    return batch.source_binding(reg.bound_sources, reg.bound_manifest, reg.bound_stored, reg.bound_fallback)


@query("frozen_decisions", """WITH now AS (SELECT evidence_id, CASE WHEN issue_date_state = 'FOUND' THEN TRY_CAST(issue_date AS DATE) END AS day, revision, validation_status = 'BLOCKED' AS blocked FROM b_evidence),
 makers AS (SELECT manufacturer_name, COUNT(*) AS n, MIN(manufacturer_id) AS id FROM b_makers GROUP BY manufacturer_name)
 SELECT d.decision_id, CASE WHEN NOT d.approved THEN 'BATCH_DECISION_NOT_APPROVED' WHEN d.json_sha256 = 'j0' AND d.evidence_id <> 0 THEN 'SOURCE_CHANGED' WHEN d.pdf_sha256 = 'p0' AND d.evidence_id <> 0 THEN 'PDF_MISMATCH'
 WHEN n.revision <> d.revision OR n.day IS DISTINCT FROM d.issue_date OR n.blocked THEN 'BATCH_DECISION_MISMATCH' WHEN COALESCE(m.n, 0) <> 1 THEN 'MANUFACTURER_NOT_UNIQUE'
 WHEN d.canonical IS NULL OR NOT (d.existing_manufacturer = d.canonical OR CONTAINS(LOWER(d.existing_manufacturer), LOWER(SPLIT_PART(d.canonical, ' ', 1)))) THEN 'LINK_TARGET_NOT_APPROVED'
 WHEN EXISTS (SELECT 1 FROM b_goods g WHERE g.product_name = d.product_name AND g.manufacturer_id = m.id AND (d.product_code IS NULL OR g.manufacturer_product_code = d.product_code)) THEN 'STALE_RESOLUTION' ELSE 'READY' END AS verdict
 FROM b_frozen d JOIN now n ON n.evidence_id = d.evidence_id LEFT JOIN makers m ON m.manufacturer_name = d.existing_manufacturer""")
def frozen_decisions(reg):
    plans = identity.identity_plan(reg.evidence, reg.makers, reg.goods, reg.approved)
    plans = plans.withColumns({"json_sha256": F.concat(F.lit("j"), F.col("evidence_id").cast("string")), "pdf_sha256": F.concat(F.lit("p"), F.col("evidence_id").cast("string"))})
    names = plans.where("canonical is not null").select(F.col("canonical").alias("name")).distinct()
    return batch.frozen_check(reg.frozen, plans, reg.makers, identity.manufacturer_candidates(names, reg.makers), reg.goods)


# --- approval of decisions

APPROVED_SQL = f"""plans AS ({{plan}}), snaps AS (SELECT DISTINCT manufacturer_name AS name FROM b_decisions WHERE manufacturer_name IS NOT NULL),
hits AS (SELECT s.name, m.manufacturer_id AS id, m.manufacturer_name AS called, CASE WHEN m.manufacturer_name = s.name THEN 0 ELSE 1 END AS rank FROM snaps s JOIN b_makers m ON m.manufacturer_name = s.name OR CONTAINS(LOWER(m.manufacturer_name), LOWER(SPLIT_PART(s.name, ' ', 1)))),
makers_ AS (SELECT name, STRING_AGG(CAST(id AS VARCHAR) || '=' || called, '; ' ORDER BY rank, id) AS makers, MAX(CASE WHEN rank = 0 THEN 1 END) AS exact FROM hits GROUP BY name),
goods_ AS (SELECT d.decision_id, STRING_AGG(CAST(g.product_id AS VARCHAR) || '=' || COALESCE(g.manufacturer_product_code, ''), '; ' ORDER BY g.product_id) AS goods FROM b_decisions d JOIN b_goods g ON d.manufacturer_action = 'LINK' AND g.product_name = d.product_name AND g.manufacturer_id = d.manufacturer_id AND (d.product_code IS NULL OR d.product_code = g.manufacturer_product_code) GROUP BY d.decision_id),
seen AS (SELECT d.*, p.product_name AS planned_name, p.product_code AS planned_code, p.canonical, p.manufacturer_status, p.blockers, m.makers, m.exact, g.goods, (SELECT MIN(h.called) FROM hits h WHERE h.name = d.manufacturer_name AND h.id = d.manufacturer_id) AS called, d.product_id IS NOT NULL AND d.manufacturer_action = 'LINK'
  AND EXISTS (SELECT 1 FROM b_goods x WHERE x.product_id = d.product_id AND x.product_name = d.product_name AND x.manufacturer_id = d.manufacturer_id) AS product_hit, d.manufacturer_action = 'LINK' AS linked, has_safety OR use_description IS NOT NULL OR use_restriction IS NOT NULL AS manual
 FROM b_decisions d LEFT JOIN plans p ON p.evidence_id = d.evidence_id LEFT JOIN makers_ m ON m.name = d.manufacturer_name LEFT JOIN goods_ g ON g.decision_id = d.decision_id),
ruled AS (SELECT seen.*, CASE WHEN manufacturer_status IS NULL OR CONTAINS(blockers, 'EXTRACTION_VALIDATION_BLOCKED') THEN 'INVALID_EVIDENCE_JSON'
 WHEN manufacturer_action = 'DROP' OR product_name IS DISTINCT FROM planned_name OR product_code IS DISTINCT FROM planned_code OR CONTAINS(blockers, 'MANUFACTURER_PRODUCT_CODE_REQUIRES') OR (manufacturer_status <> 'HUMAN_REVIEW' AND manufacturer_name IS DISTINCT FROM canonical) THEN 'DECISION_DOES_NOT_MATCH_DRY_RUN'
 WHEN manufacturer_status = 'HUMAN_REVIEW' AND (canonical IS NULL OR TRIM(COALESCE(manufacturer_name, '')) = '') THEN 'MANUFACTURER_REQUIRES_HUMAN_REVIEW' WHEN NOT linked AND (exact IS NOT NULL OR manufacturer_id IS NOT NULL OR seen_name IS NOT NULL) THEN 'DECISION_DOES_NOT_MATCH_DRY_RUN'
 WHEN linked AND called IS NULL THEN 'LINK_TARGET_NOT_APPROVED' WHEN linked AND NOT link_confirmed THEN 'MANUFACTURER_LINK_CONFIRMATION_REQUIRED' WHEN linked AND seen_name <> called THEN 'STALE_MANUFACTURER_SNAPSHOT'
 WHEN product_action = 'LINK' AND NOT linked THEN 'PRODUCT_LINK_REQUIRES_MANUFACTURER_LINK' WHEN product_action = 'CREATE' AND (goods IS NOT NULL OR product_id IS NOT NULL) THEN 'DECISION_DOES_NOT_MATCH_DRY_RUN' WHEN product_action = 'LINK' AND NOT product_hit THEN 'LINK_TARGET_NOT_APPROVED'
 WHEN product_action = 'LINK' AND product_code IS NULL AND NOT null_code_confirmed THEN 'NULL_CODE_LINK_CONFIRMATION_REQUIRED'
 WHEN TRIM(approved_by) = '' OR NOT manufacturer_confirmed OR (manual AND NOT manual_confirmed) OR (has_safety AND NOT safety_confirmed) THEN 'HUMAN_CONFIRMATION_REQUIRED'
 WHEN (use_description IS NOT NULL OR has_safety) AND TRIM(COALESCE(use_description, '')) = '' THEN 'PLAN_NOT_READY: use_description' WHEN (use_restriction IS NOT NULL OR has_safety) AND TRIM(COALESCE(use_restriction, '')) = '' THEN 'PLAN_NOT_READY: use_restriction'
 WHEN CONTAINS(original_filename, '/') OR NOT is_pdf THEN 'PDF_REQUIRED' WHEN NOT has_safety AND pdf_sha256 <> source_sha256 THEN 'PDF_MISMATCH' ELSE 'APPROVED' END AS verdict FROM seen)"""


def plan_first(sql: str) -> str:
    """The oracle of the identity plans as one of the tables of another."""
    return "WITH " + APPROVED_SQL.replace("{plan}", SQL["identity_plan"]) + " " + sql


def kept(reg, table: str):
    """A bound table that many steps of a query read, made once and kept by the executors: in their plans it is a leaf, as plans that named all its joins in each place filled the driver."""
    name = f"kept_{table}"
    if name not in reg._seen:
        reg._seen[name] = getattr(reg, table).localCheckpoint(eager=False)
    return reg._seen[name]


def approved(reg, shown=None):
    makers, goods = kept(reg, "makers"), kept(reg, "goods")
    return approvals.approvals(kept(reg, "decisions"), identity.identity_plan(kept(reg, "evidence"), makers, goods, reg.approved), makers, goods, shown)


@query("approvals", plan_first("SELECT decision_id, verdict, CASE WHEN verdict = 'APPROVED' THEN COALESCE(makers, '') END AS makers, CASE WHEN verdict = 'APPROVED' THEN COALESCE(goods, '') END AS goods FROM ruled"))
def approvals_(reg):
    listed = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(x["id"].cast("string"), F.lit("="), F.coalesce(x[f], F.lit("")))), "; ")
    return approved(reg, listed).select("decision_id", "verdict", "makers", "goods")


@query("stale_approvals", plan_first("SELECT decision_id, CASE WHEN CONTAINS(makers, 'Works NATION_1 ') OR CONTAINS(makers, '=NATION_7') THEN 'STALE' ELSE 'CURRENT' END AS drift FROM ruled WHERE verdict = 'APPROVED'"))
def stale_approvals(reg):
    later = kept(reg, "makers").withColumn("manufacturer_name", F.when(F.col("manufacturer_name").startswith("Works NATION_1 ") | (F.col("manufacturer_name") == "NATION_7"), F.concat("manufacturer_name", F.lit(" B"))).otherwise(F.col("manufacturer_name")))
    # the hashes alone, kept for the two uses of them
    old = approved(reg).select("decision_id", "verdict", "makers_hash", "goods_hash").localCheckpoint(eager=False)
    return approvals.stale_approvals(old, kept(reg, "decisions"), later, kept(reg, "goods"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, build=build: build(Registry(spark, sf_dir)) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in SQL.items()}
