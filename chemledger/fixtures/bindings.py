"""Registry tables bound to the driver tables.

Each binding is portable SQL: Spark runs it over the Parquet files and the oracle prepends the same
text as common table expressions, so both sides start from identical registry rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chemledger.plans import spread

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
       "pages", "benchmark", "labels", "conversations")

BINDINGS: dict[str, str] = {
    "b_manufacturers": "SELECT n_nationkey AS manufacturer_id, n_name AS manufacturer_name FROM nation",
    "b_products": """
SELECT c_custkey AS product_id, c_name AS product_name,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE c_name END AS manufacturer_product_code,
 c_nationkey AS manufacturer_id,
 CASE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'use' END AS use_description,
 CASE WHEN c_custkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE 'limit' END AS use_restriction,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ACTIVE' WHEN 'BUILDING' THEN 'PENDING_APPROVAL'
  WHEN 'FURNITURE' THEN 'REJECTED' ELSE 'INACTIVE' END AS usage_status,
 CAST(NULL AS STRING) AS waste_type, CAST(NULL AS STRING) AS waste_code
FROM customer""",
    "b_sds_documents": """
SELECT sds_id, product_id, CONCAT('card-', CAST(sds_id AS STRING), '.pdf') AS original_filename,
 CONCAT('sds/', CAST(sds_id AS STRING), '.pdf') AS relative_path, issue_date, revision,
 CASE WHEN inval THEN 'INVALIDATED' WHEN rn = 1 AND product_id % 13 <> 0 THEN 'CURRENT' ELSE 'ARCHIVED' END AS document_status,
 registered_at, 'AVAILABLE' AS file_status
FROM (SELECT o_orderkey AS sds_id, CASE WHEN o_custkey % 11 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END AS product_id, o_orderdate AS registered_at,
 CAST(o_orderdate AS DATE) AS issue_date, CAST(o_orderkey % 5 AS STRING) AS revision,
 o_orderpriority = '5-LOW' AS inval,
 ROW_NUMBER() OVER (PARTITION BY CASE WHEN o_custkey % 11 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END, o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders) t""",
    "b_bhp_decisions": """
SELECT o_orderkey AS decision_id, CASE WHEN o_custkey % 11 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END AS product_id, o_orderkey AS sds_id,
 CASE o_orderstatus WHEN 'F' THEN 'APPROVED' ELSE 'REJECTED' END AS decision_status,
 CASE WHEN o_orderkey % 4 = 0 THEN 'note' ELSE CAST(NULL AS STRING) END AS notes,
 o_orderdate AS registered_at, CASE WHEN o_orderstatus IN ('F','O') THEN 'CURRENT' ELSE 'SUPERSEDED' END AS record_status, o_orderkey AS evidence_id
FROM orders
UNION ALL
SELECT -o_orderkey - 1, CASE WHEN o_custkey % 11 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END, o_orderkey, 'REJECTED', CAST(NULL AS STRING), o_orderdate, 'SUPERSEDED', -o_orderkey - 1
FROM orders WHERE o_orderkey % 3 = 0""",
    "b_decision_evidence": """
SELECT evidence_id, CASE WHEN evidence_id % 10 = 0 THEN CAST(NULL AS STRING) WHEN evidence_id % 10 = 5 THEN ''
  ELSE CONCAT('decision-', CAST(evidence_id AS STRING), '.pdf') END AS original_filename,
 CASE WHEN evidence_id < 0 THEN CONCAT('bhp/s', CAST(-evidence_id - 1 AS STRING), '.pdf')
  ELSE CONCAT('bhp/', CAST(evidence_id AS STRING), '.pdf') END AS relative_path,
 'DOCUMENT' AS evidence_type, 'PDF' AS file_format, 'AVAILABLE' AS file_status
FROM b_bhp_decisions""",
    "b_file_listing": """
SELECT 'sds' AS root, relative_path, CAST(1 AS BIGINT) AS length FROM b_sds_documents WHERE sds_id % 17 <> 0
UNION ALL
SELECT 'evidence', e.relative_path, CAST(CASE WHEN e.evidence_id % 23 = 0 THEN 0 ELSE 1 END AS BIGINT)
FROM b_decision_evidence e JOIN b_bhp_decisions d ON d.evidence_id = e.evidence_id WHERE d.sds_id % 19 <> 0""",
    "b_sds_invalidation": """
SELECT -sds_id - 1 AS invalidation_id, product_id, sds_id AS invalidated_sds_id,
 CASE WHEN sds_id % 2 = 0 THEN 'CURRENT' ELSE 'ARCHIVED' END AS invalidated_from_status,
 CASE WHEN sds_id % 2 = 0 AND sds_id % 3 = 0 THEN (sds_id + 3) ELSE CAST(NULL AS BIGINT) END AS restored_sds_id,
 'withdrawn' AS reason, registered_at AS invalidated_at
FROM b_sds_documents WHERE document_status = 'INVALIDATED'""",
    "b_safety_profiles": "SELECT sds_id FROM b_sds_documents WHERE sds_id % 4 <> 0",
    "b_usage_locations": """
SELECT s_suppkey AS location_id, CASE WHEN s_suppkey % 10 = 9 THEN CAST(NULL AS STRING)
  ELSE CONCAT('L-', CAST(s_suppkey AS STRING)) END AS location_code, s_name AS location_name,
 CASE WHEN s_suppkey % 4 = 3 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM supplier""",
    "b_units": """
SELECT unit_id, CASE unit_id WHEN 'F' THEN 'kg' ELSE 'l' END AS code, CASE unit_id WHEN 'F' THEN 'kilogram' ELSE 'litre' END AS name,
 CASE unit_id WHEN 'F' THEN 'MASS' ELSE 'VOLUME' END AS category, 'ACTIVE' AS status
FROM (SELECT DISTINCT l_linestatus AS unit_id FROM lineitem) t""",
    "b_product_usage_locations": """
SELECT product_id, location_id, peak_quantity_value, peak_quantity_unit_id, monthly_consumption_value,
 CASE WHEN monthly_consumption_value IS NOT NULL THEN peak_quantity_unit_id END AS monthly_consumption_unit_id
FROM (SELECT CASE WHEN o_custkey % 9 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END AS product_id, l_suppkey AS location_id,
 CAST(MAX(l_quantity) AS DECIMAL(18,6)) AS peak_quantity_value, MIN(l_linestatus) AS peak_quantity_unit_id,
 CASE WHEN COUNT(*) > 1 THEN CAST(SUM(l_quantity) AS DECIMAL(18,6)) END AS monthly_consumption_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY CASE WHEN o_custkey % 9 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END, l_suppkey) t""",
    "b_physical_reviews": """
SELECT review_id, review_date, status, created_at, CASE WHEN status = 'FINAL' THEN created_at END AS finalized_at
FROM (SELECT review_id, CAST(MAX(l_shipdate) AS DATE) AS review_date, MIN(l_shipdate) AS created_at,
 CASE WHEN review_id = (SELECT MAX(YEAR(l_shipdate) * 10 + QUARTER(l_shipdate)) FROM lineitem) THEN 'DRAFT' ELSE 'FINAL' END AS status
FROM (SELECT YEAR(l_shipdate) * 10 + QUARTER(l_shipdate) AS review_id, l_shipdate FROM lineitem) t GROUP BY review_id) u""",
    "b_physical_review_items": """
SELECT CONCAT(CAST(review_id AS STRING), '/', CAST(product_id AS STRING), '/', CAST(location_id AS STRING)) AS review_item_id,
 review_id, product_id, location_id, baseline_max_quantity, baseline_unit_id, observed_quantity
FROM (SELECT YEAR(l_shipdate) * 10 + QUARTER(l_shipdate) AS review_id, o_custkey AS product_id, l_suppkey AS location_id,
 CAST(MAX(l_quantity) AS DECIMAL(18,6)) AS baseline_max_quantity, MIN(l_linestatus) AS baseline_unit_id,
 CAST(SUM(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END) AS DECIMAL(18,6)) AS observed_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY YEAR(l_shipdate) * 10 + QUARTER(l_shipdate), o_custkey, l_suppkey) t""",
    "b_product_history": """
SELECT sds_id AS history_id, product_id, CASE WHEN sds_id % 3 = 0 THEN 'ACTIVE' WHEN sds_id % 3 = 1 THEN 'REJECTED'
  ELSE 'PENDING_APPROVAL' END AS usage_status, registered_at AS changed_at FROM b_sds_documents""",
    "b_usage_location_history": """
SELECT CONCAT(CAST(l_suppkey AS STRING), '@', CAST(CAST(l_shipdate AS DATE) AS STRING)) AS history_id, l_suppkey AS location_id,
 CASE WHEN DAY(l_shipdate) % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, MIN(l_shipdate) AS changed_at
FROM lineitem GROUP BY CONCAT(CAST(l_suppkey AS STRING), '@', CAST(CAST(l_shipdate AS DATE) AS STRING)), l_suppkey, CASE WHEN DAY(l_shipdate) % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END""",
    "b_product_usage_location_history": """
SELECT CONCAT(CAST(product_id AS STRING), '/', CAST(location_id AS STRING), '@', CAST(day AS STRING)) AS history_id, product_id, location_id, peak_quantity_value, peak_quantity_unit_id,
 CASE WHEN DAY(day) % 3 = 0 THEN peak_quantity_value END AS monthly_consumption_value, CASE WHEN DAY(day) % 3 = 0 THEN peak_quantity_unit_id END AS monthly_consumption_unit_id, changed_at
FROM (SELECT o_custkey AS product_id, l_suppkey AS location_id, CAST(l_shipdate AS DATE) AS day, CAST(MAX(l_quantity) AS DECIMAL(18,6)) AS peak_quantity_value,
 MIN(l_linestatus) AS peak_quantity_unit_id, MIN(l_shipdate) AS changed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey, CAST(l_shipdate AS DATE)) t""",
    "b_product_identity_changes": """
SELECT o_orderkey AS change_id, o_custkey AS product_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CODE_COMPLETION' ELSE 'CORRECTION' END AS change_kind,
 c_name AS old_product_name, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE CONCAT(c_name, ' ', o_orderpriority) END AS new_product_name,
 CAST(NULL AS STRING) AS old_manufacturer_product_code, CONCAT('K', CAST(o_orderkey AS STRING)) AS new_manufacturer_product_code,
 c_nationkey AS old_manufacturer_id, c_nationkey AS new_manufacturer_id, o_orderdate AS changed_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b_sds_components": """
SELECT CONCAT(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING)) AS component_id, l_orderkey AS sds_id, MIN(p_name) AS component_name,
 CONCAT(CAST(50 + l_partkey % 900 AS STRING), '-', CAST(10 + l_orderkey % 90 AS STRING), '-', CAST(l_partkey % 10 AS STRING)) AS cas_number,
 CAST(NULL AS STRING) AS ec_number, CONCAT('>= ', CAST(MIN(l_discount) AS STRING)) AS concentration_text
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey""",
    "b_audit_documents": """
SELECT sds_id, CASE WHEN sds_id % 97 = 0 THEN product_id + 100000000 ELSE product_id END AS product_id, original_filename, relative_path, issue_date, revision,
 CASE WHEN sds_id % 7 = 0 THEN 'CURRENT' WHEN sds_id % 101 = 0 THEN 'LOST' ELSE document_status END AS document_status, registered_at, file_status
FROM b_sds_documents""",
    "b_audit_decisions": """
SELECT decision_id, CASE WHEN sds_id % 53 = 0 THEN product_id + 1 ELSE product_id END AS product_id, sds_id, decision_status, notes, registered_at,
 CASE WHEN sds_id % 11 = 0 THEN 'CURRENT' ELSE record_status END AS record_status, CASE WHEN decision_id % 41 = 0 THEN evidence_id + 1 ELSE evidence_id END AS evidence_id
FROM b_bhp_decisions""",
    "b_audit_locations": """
SELECT CASE WHEN location_id % 29 = 5 THEN location_id - 1 ELSE location_id END AS location_id, CASE WHEN location_id % 13 = 0 THEN 'bad code' WHEN location_id % 17 = 0 THEN 'SAME' ELSE location_code END AS location_code,
 location_name, CASE WHEN location_id % 19 = 0 THEN 'UNKNOWN' ELSE status END AS status FROM b_usage_locations""",
    "b_audit_assignments": """
SELECT CASE WHEN product_id % 59 = 0 THEN CAST(NULL AS BIGINT) ELSE product_id END AS product_id, location_id, CASE WHEN (product_id + location_id) % 83 = 0 THEN -peak_quantity_value ELSE peak_quantity_value END AS peak_quantity_value,
 CASE WHEN product_id % 61 = 0 THEN 'X' ELSE peak_quantity_unit_id END AS peak_quantity_unit_id, monthly_consumption_value,
 CASE WHEN location_id % 23 = 0 THEN CAST(NULL AS STRING) ELSE monthly_consumption_unit_id END AS monthly_consumption_unit_id FROM b_product_usage_locations""",
    "b_makers": """
SELECT n_nationkey AS manufacturer_id, n_name AS manufacturer_name FROM nation
UNION ALL SELECT 1000 + s_suppkey, CONCAT('Works ', n_name, ' ', s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 100000 + s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = (SELECT MIN(s_suppkey) FROM supplier)""",
    "b_goods": """
SELECT p_partkey AS product_id, CASE WHEN p_size % 3 = 0 THEN CONCAT(UPPER(p_name), '  ', p_brand) WHEN p_size % 3 = 1 THEN p_name ELSE SUBSTRING(p_name, 1, POSITION(' ' IN p_name) - 1) END AS product_name,
 CASE WHEN p_size % 4 = 0 THEN CAST(NULL AS STRING) ELSE CONCAT('C', CAST(p_size AS STRING)) END AS manufacturer_product_code, CAST(p_size % 25 AS BIGINT) AS manufacturer_id FROM part""",
    "b_names": "SELECT DISTINCT p_name AS name, CAST(1 AS BIGINT) AS selected_id FROM part",
    "b_approved": "SELECT CONCAT(n_name, ' AG') AS raw, n_name AS canonical FROM nation UNION ALL SELECT 'Works', 'Works'",
    "b_evidence": """
SELECT o_orderkey AS evidence_id, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN o_orderkey % 19 = 0 THEN 'NOT_FOUND' ELSE 'FOUND' END AS name_state,
 CONCAT('C', CAST(p_size AS STRING)) AS code, CASE o_orderkey % 6 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'NOT_FOUND' ELSE 'FOUND' END AS code_state,
 CASE WHEN o_orderkey % 29 = 0 THEN '1995-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS issue_date, CASE WHEN o_orderkey % 31 = 0 THEN 'UNREADABLE' ELSE 'FOUND' END AS issue_date_state,
 CAST(o_orderkey % 5 AS STRING) AS revision, 'FOUND' AS revision_state, CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 1 END AS manufacturers,
 CASE o_orderkey % 8 WHEN 0 THEN 'Unknown maker' WHEN 1 THEN 'Works' ELSE CONCAT(n_name, ' AG') END AS manufacturer, CASE WHEN o_orderkey % 41 = 0 THEN 'NOT_FOUND' ELSE 'FOUND' END AS manufacturer_state,
 CASE o_orderkey % 3 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'REQUIRES_HUMAN_REVIEW' ELSE 'READY_FOR_HUMAN_REVIEW' END AS validation_status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS review_status, o_orderkey % 7 = 0 AS has_safety
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = o_custkey""",
    "b_batch_items": """
SELECT doc_id AS position, doc_id AS manifest_id, CASE WHEN doc_id % 43 = 0 THEN 'FAILED' WHEN doc_id % 2 = 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS status,
 CAST(1 AS INT) AS logical_sds_count, CONCAT(CAST(doc_id AS STRING), CASE WHEN doc_id % 47 = 0 THEN '_DOC-002.json' ELSE '_DOC-001.json' END) AS json_file,
 CONCAT(source, CASE WHEN doc_id % 53 = 0 THEN '/' ELSE '-' END, CAST(doc_id AS STRING), '.pdf') AS source_file, CONCAT(MD5(text), MD5(text)) AS sha256_expected,
 CASE WHEN doc_id % 59 = 0 THEN CAST(NULL AS STRING) WHEN doc_id % 61 = 0 THEN CONCAT(MD5(lang), MD5(text)) ELSE CONCAT(MD5(text), MD5(text)) END AS sha256,
 CASE WHEN doc_id % 67 = 0 THEN CAST(NULL AS STRING) WHEN doc_id % 71 = 0 THEN 'other.pdf' ELSE CONCAT(source, CASE WHEN doc_id % 53 = 0 THEN '/' ELSE '-' END, CAST(doc_id AS STRING), '.pdf') END AS json_name,
 CONCAT(MD5(text), MD5(text)) AS json_sha256, CASE WHEN doc_id % 73 = 0 THEN '' ELSE source END AS product_name, CASE WHEN lang = 'es' THEN CAST(NULL AS STRING) ELSE lang END AS product_code,
 CAST(CONCAT(CAST(1990 + n_chars % 20 AS STRING), '-0', CAST(1 + n_chars % 9 AS STRING), '-1', CAST(n_chars % 10 AS STRING)) AS DATE) AS issue_date, CAST(n_chars % 3 AS STRING) AS revision,
 CASE WHEN n_chars % 5 = 0 THEN 'Other' ELSE 'Maker' END AS manufacturer FROM documents""",
    "b_batch_products": """
SELECT CONCAT(source, '/', lang) AS product_id, CASE WHEN lang = 'fr' THEN CONCAT(source, ' ', lang) ELSE source END AS product_name, CASE WHEN lang = 'es' THEN CAST(NULL AS STRING) ELSE lang END AS manufacturer_product_code,
 CASE WHEN source LIKE '%3' THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS manufacturer_id FROM (SELECT DISTINCT source, lang FROM documents WHERE source NOT LIKE '%7') t""",
    "b_batch_documents": """
SELECT CONCAT(source, '/', lang) AS product_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 AND source NOT LIKE '%4' THEN 'CURRENT' ELSE 'ARCHIVED' END AS document_status,
 CAST(CONCAT(CAST(1990 + n_chars % 20 AS STRING), '-0', CAST(1 + n_chars % 9 AS STRING), '-1', CAST(n_chars % 10 AS STRING)) AS DATE) AS issue_date, CAST(n_chars % 3 AS STRING) AS revision,
 CONCAT(MD5(text), MD5(text)) AS sha256 FROM documents WHERE n_chars % 4 < 3""",
    "b_review_decisions": """
SELECT i.manifest_id, CASE WHEN i.manifest_id % 10 = 0 THEN 'Nobody' WHEN i.manufacturer = 'Other' THEN 'Other' END AS observed, CASE WHEN i.product_code IS NULL AND i.manifest_id % 5 > 0 THEN 'CORRECT_EXISTING_PRODUCT' WHEN i.manifest_id % 3 = 0 THEN 'RESOLVE_EXACT' WHEN i.manifest_id % 13 = 0 THEN 'CORRECT_EXISTING_PRODUCT' ELSE 'CREATE_DISTINCT_PRODUCT' END AS action,
 p.product_id, CASE WHEN i.manifest_id % 29 = 0 THEN 'x' ELSE p.product_name END AS preserve_name, p.manufacturer_product_code AS preserve_code, p.manufacturer_id AS old_manufacturer_id, CAST(CASE WHEN i.manifest_id % 31 = 0 THEN 9 ELSE 1 END AS BIGINT) AS new_manufacturer_id,
 CASE WHEN i.manifest_id % 11 = 0 THEN 'wrong' ELSE i.product_name END AS product_name, i.product_code
FROM b_batch_items i LEFT JOIN b_batch_products p ON p.product_id = CONCAT(i.product_name, '/', COALESCE(i.product_code, 'es'))""",
    "b_review_documents": """
SELECT doc_id AS sds_id, CONCAT(source, '/', lang) AS product_id, CASE WHEN n = 1 AND source NOT LIKE '%4' THEN 'CURRENT' ELSE 'ARCHIVED' END AS document_status,
 CAST(CONCAT(CAST(1990 + n_chars % 20 AS STRING), '-0', CAST(1 + n_chars % 9 AS STRING), '-1', CAST(n_chars % 10 AS STRING)) AS DATE) AS issue_date, CASE WHEN doc_id % 5 = 1 THEN '7' ELSE CAST(n_chars % 3 AS STRING) END AS revision,
 CASE WHEN n = 2 AND source LIKE '%5' THEN CAST(NULL AS STRING) ELSE CONCAT(MD5(text), MD5(text)) END AS sha256
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE n_chars % 4 < 3) t""",
    "b_review_items": """
SELECT i.position, i.manifest_id, status, logical_sds_count, json_file, source_file, sha256_expected, sha256, json_name, json_sha256, i.product_name, i.product_code, issue_date, revision,
 CASE WHEN i.manufacturer = COALESCE(d.observed, 'Maker') THEN 'Maker' ELSE '' END AS manufacturer, i.manufacturer AS said FROM b_batch_items i JOIN b_review_decisions d ON d.manifest_id = i.manifest_id""",
    "b_batch_report": """
SELECT s.sds_id AS manifest_id, CASE WHEN s.sds_id % 4 = 0 THEN 'REVIEW_IDENTITY' ELSE 'READY_CREATE' END AS classification, CASE WHEN s.sds_id % 4 = 0 THEN 'NOT_ATTEMPTED' ELSE 'COMMITTED' END AS action,
 CASE WHEN s.sds_id % 17 = 0 THEN -s.product_id - 1 WHEN s.sds_id % 19 = 0 THEN s.product_id + 1 ELSE s.product_id END AS product_id, CASE WHEN s.sds_id % 23 = 0 THEN -s.sds_id - 1 ELSE s.sds_id END AS sds_id,
 CASE WHEN s.sds_id % 11 = 0 THEN 'other' ELSE p.product_name END AS product_name, MD5(s.relative_path) AS sha256 FROM b_sds_documents s JOIN b_products p ON p.product_id = s.product_id""",
    "b_batch_stored": "SELECT relative_path, CASE WHEN sds_id % 13 = 0 THEN '' ELSE MD5(relative_path) END AS sha256 FROM b_sds_documents WHERE sds_id % 14 <> 0",
    "b_revision_requests": """
SELECT product_id * 10 + 1 AS request_id, CASE WHEN product_id % 29 = 0 THEN product_id + 100000000 ELSE product_id END AS product_id, 1000000000 + product_id AS sds_id,
 CASE WHEN product_id % 4 = 0 THEN '' ELSE CONCAT('new-', CAST(product_id AS STRING), '.pdf') END AS original_filename, CASE WHEN product_id % 15 = 0 THEN ' ' ELSE CONCAT('new/', CAST(product_id AS STRING), '.pdf') END AS relative_path,
 CASE WHEN product_id % 17 = 0 THEN CAST(NULL AS DATE) ELSE DATE '1999-01-01' END AS issue_date, CASE WHEN product_id % 19 = 0 THEN ' ' ELSE '9' END AS revision, (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_products""",
    "b_decision_requests": """
SELECT product_id * 10 + 2 AS request_id, product_id, CASE WHEN product_id % 6 = 0 THEN MIN(sds_id) ELSE MAX(CASE WHEN document_status = 'CURRENT' THEN sds_id END) END AS sds_id,
 CASE WHEN product_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision_status, CAST(NULL AS STRING) AS notes,
 CONCAT('new/', CAST(product_id AS STRING), CASE product_id % 5 WHEN 0 THEN '.MSG' WHEN 1 THEN '.txt' WHEN 2 THEN '.jpeg' ELSE '.pdf' END) AS evidence_relative_path,
 CASE WHEN product_id % 14 = 0 THEN ' ' ELSE 'scan' END AS original_filename, (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_sds_documents GROUP BY product_id""",
    "b_invalidation_requests": """
SELECT product_id * 10 + 3 AS request_id, product_id, CASE WHEN product_id % 3 = 0 THEN current_id ELSE archived_id END AS sds_id,
 CASE WHEN product_id % 8 = 0 THEN 'INVALIDATED' WHEN product_id % 3 = 0 THEN 'CURRENT' ELSE 'ARCHIVED' END AS expected_status,
 CASE WHEN product_id % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE current_id END AS expected_current_sds_id,
 CASE WHEN product_id % 3 <> 0 THEN 'ARCHIVED_ONLY' WHEN product_id % 2 = 0 THEN 'RESTORE_ARCHIVED' ELSE 'NO_CURRENT' END AS mode,
 CASE WHEN product_id % 3 = 0 AND product_id % 2 = 0 THEN archived_id END AS restored_sds_id, CASE WHEN product_id % 31 = 0 THEN ' ' ELSE ' wrong card ' END AS reason_text, (SELECT MAX(o_orderdate) FROM orders) AS at
FROM (SELECT product_id, MIN(CASE WHEN document_status = 'CURRENT' THEN sds_id END) AS current_id, MIN(CASE WHEN document_status = 'ARCHIVED' THEN sds_id END) AS archived_id FROM b_sds_documents GROUP BY product_id) t""",
    "b_administrative_requests": """
SELECT product_id * 10 + 4 AS request_id, CASE WHEN product_id % 7 = 0 THEN -product_id - 1 ELSE product_id END AS product_id, CASE WHEN product_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'new use' END AS use_description,
 'new limit' AS use_restriction, 'W' AS waste_type, CAST(product_id AS STRING) AS waste_code, (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_products WHERE usage_status <> 'INACTIVE'""",
    "b_location_requests": """
SELECT location_id * 10 + 5 AS request_id, CASE WHEN location_id % 9 = 0 THEN -location_id - 1 ELSE location_id END AS location_id, CASE location_id % 4 WHEN 0 THEN 'INACTIVE' WHEN 1 THEN 'CLOSED' ELSE 'ACTIVE' END AS new_status,
 (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_usage_locations""",
    "b_observation_requests": """
SELECT CONCAT('q', review_item_id) AS request_id, CASE WHEN product_id % 13 = 0 THEN CONCAT(review_item_id, '?') ELSE review_item_id END AS review_item_id,
 CAST(CASE WHEN location_id % 11 = 0 THEN -1 ELSE baseline_max_quantity + 1 END AS DECIMAL(18,6)) AS observed_quantity FROM b_physical_review_items""",
    "b_delete_requests": "SELECT product_id * 10 + 6 AS request_id, CASE WHEN product_id % 12 = 0 THEN -product_id - 1 ELSE product_id END AS product_id FROM b_products",
    "b_code_requests": """
SELECT product_id * 10 + 7 AS request_id, CASE WHEN product_id % 12 = 0 THEN -product_id - 1 ELSE product_id END AS product_id, CASE WHEN product_id % 8 = 0 THEN ' ' ELSE CONCAT(' C', CAST(product_id AS STRING)) END AS code,
 (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_products""",
    "b_correction_requests": """
SELECT p.product_id * 10 + 8 AS request_id, CASE WHEN p.product_id % 13 = 0 THEN -p.product_id - 1 ELSE p.product_id END AS product_id, CASE WHEN p.product_id % 3 = 0 THEN p.product_name ELSE CONCAT(p.product_name, ' II') END AS product_name,
 CASE WHEN p.product_id % 7 = 0 THEN 'X' ELSE p.manufacturer_product_code END AS code, CASE p.product_id % 4 WHEN 0 THEN m.manufacturer_name WHEN 1 THEN 'Newcomer' WHEN 2 THEN 'Twice' ELSE m.manufacturer_name END AS manufacturer_name,
 (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_products p JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id""",
    "b_manufacturers_twice": "SELECT manufacturer_id, manufacturer_name FROM b_manufacturers UNION ALL SELECT 900, 'Twice' FROM region WHERE r_regionkey < 2",
    "b_new_locations": """
SELECT location_id * 10 + 9 AS request_id, location_id + 50000 AS location_id, location_name, CASE location_id % 5 WHEN 0 THEN ' no good' WHEN 1 THEN CONCAT(' n-', CAST(location_id AS STRING)) WHEN 2 THEN 'same' WHEN 3 THEN location_code ELSE 'N_2' END AS location_code FROM b_usage_locations""",
    "b_legacy_codes": """
SELECT location_id * 10 + 1 AS request_id, CASE WHEN location_id % 6 = 0 THEN -location_id - 1 ELSE location_id END AS location_id, CASE WHEN location_id % 4 = 0 THEN '?' ELSE CONCAT('old', CAST(location_id % 50 AS STRING)) END AS location_code FROM b_usage_locations""",
    "b_units_some": "SELECT unit_id, code, name, category, CASE WHEN unit_id = 'F' THEN 'ACTIVE' ELSE 'INACTIVE' END AS status FROM b_units",
    "b_quantity_requests": """
SELECT CONCAT(CAST(product_id AS STRING), '-', CAST(location_id AS STRING)) AS request_id, product_id, CASE WHEN product_id % 5 = 0 THEN location_id ELSE -location_id - 1 END AS location_id,
 CAST(CASE WHEN product_id % 10 = 0 THEN -1 ELSE peak_quantity_value + 1 END AS DECIMAL(18,6)) AS peak_quantity_value, peak_quantity_unit_id, monthly_consumption_value,
 CASE WHEN location_id % 7 = 0 THEN CAST(NULL AS STRING) ELSE monthly_consumption_unit_id END AS monthly_consumption_unit_id, (SELECT MAX(o_orderdate) FROM orders) AS at FROM b_product_usage_locations""",
    "b_assign_requests": """
SELECT product_id AS request_id, product_id, location_id, CAST(5 AS DECIMAL(18,6)) AS peak_quantity_value, CASE WHEN product_id % 9 = 0 THEN 'O' ELSE 'F' END AS peak_quantity_unit_id, CAST(NULL AS DECIMAL(18,6)) AS monthly_consumption_value,
 CAST(NULL AS STRING) AS monthly_consumption_unit_id, (SELECT MAX(o_orderdate) FROM orders) AS at FROM (SELECT product_id, product_id % 120 AS location_id FROM b_products) t""",
    "b_many_revisions": """
SELECT o_orderkey * 10 + 1 AS request_id, o_orderkey % 89 AS seq, CASE WHEN o_custkey % 29 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS product_id,
 1000000000 + CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS sds_id, CONCAT('new-', CAST(o_orderkey AS STRING), '.pdf') AS original_filename,
 CASE WHEN o_orderkey % 15 = 1 THEN ' ' ELSE CONCAT('new/', CAST(o_orderkey AS STRING), '.pdf') END AS relative_path, CAST(o_orderdate AS DATE) AS issue_date, CAST(o_orderkey % 7 AS STRING) AS revision, o_orderdate AS at FROM orders""",
    "b_many_decisions": """
SELECT o.o_orderkey * 10 + 2 AS request_id, o.o_orderkey % 89 AS seq, o.o_custkey AS product_id, CASE WHEN o.o_orderkey % 9 = 0 THEN o.o_orderkey ELSE c.sds_id END AS sds_id,
 CASE WHEN o.o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision_status, CAST(NULL AS STRING) AS notes, CONCAT('new/', CAST(o.o_orderkey AS STRING), '.pdf') AS evidence_relative_path,
 CASE WHEN o.o_orderkey % 14 = 0 THEN ' ' ELSE 'scan' END AS original_filename, o.o_orderdate AS at FROM orders o LEFT JOIN b_sds_documents c ON c.product_id = o.o_custkey AND c.document_status = 'CURRENT'""",
    "b_many_withdrawals": """
SELECT sds_id * 10 + 3 AS request_id, rn AS seq, product_id, CASE rn % 4 WHEN 2 THEN cur WHEN 3 THEN before ELSE sds_id END AS sds_id, CASE WHEN rn % 4 IN (2, 3) THEN 'CURRENT' ELSE 'ARCHIVED' END AS expected_status,
 CASE rn % 4 WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 3 THEN before ELSE cur END AS expected_current_sds_id, CASE rn % 4 WHEN 2 THEN 'RESTORE_ARCHIVED' WHEN 3 THEN 'NO_CURRENT' ELSE 'ARCHIVED_ONLY' END AS mode,
 CASE WHEN rn % 4 = 2 THEN sds_id END AS restored_sds_id, CASE WHEN sds_id % 31 = 0 THEN ' ' ELSE ' wrong card ' END AS reason_text, registered_at AS at
FROM (SELECT d.*, c.cur, LAG(d.sds_id) OVER (PARTITION BY d.product_id ORDER BY d.sds_id) AS before, ROW_NUMBER() OVER (PARTITION BY d.product_id ORDER BY d.sds_id) AS rn FROM b_sds_documents d
 LEFT JOIN (SELECT product_id, sds_id AS cur FROM b_sds_documents WHERE document_status = 'CURRENT') c ON c.product_id = d.product_id) t""",
    "b_many_administrative": """
SELECT o_orderkey * 10 + 4 AS request_id, o_orderkey % 89 AS seq, CASE WHEN o_orderkey % 23 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS product_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS use_description,
 o_orderstatus AS use_restriction, 'W' AS waste_type, CAST(o_orderkey AS STRING) AS waste_code, o_orderdate AS at FROM orders""",
    "b_many_corrections": """
SELECT o_orderkey * 10 + 8 AS request_id, o_orderkey % 89 AS seq, o_custkey AS product_id, CASE WHEN o_orderkey % 3 = 0 THEN p.product_name ELSE CONCAT(p.product_name, ' II') END AS product_name,
 CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 7 = 0 THEN 'X' ELSE p.manufacturer_product_code END AS code,
 CASE o_orderkey % 5 WHEN 1 THEN 'Newcomer' WHEN 2 THEN 'Twice' ELSE m.manufacturer_name END AS manufacturer_name, o_orderdate AS at
FROM orders JOIN b_products p ON p.product_id = o_custkey JOIN b_manufacturers m ON m.manufacturer_id = p.manufacturer_id""",
    "b_many_both": """
SELECT c.*, r.sds_id, r.original_filename, r.relative_path, r.issue_date, r.revision FROM b_many_corrections c JOIN b_many_revisions r ON r.request_id = c.request_id - 7""",
    "b_many_quantities": """
SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING)) AS request_id, l_orderkey % 89 AS seq, o_custkey AS product_id, CAST(o_custkey % 90 + l_linenumber % 2 AS BIGINT) AS location_id,
 CAST(CASE WHEN l_linenumber = 4 THEN -1 ELSE l_orderkey % 50 END AS DECIMAL(18,6)) AS peak_quantity_value, CASE WHEN l_orderkey % 9 = 0 THEN 'O' ELSE 'F' END AS peak_quantity_unit_id, CAST(NULL AS DECIMAL(18,6)) AS monthly_consumption_value,
 CAST(NULL AS STRING) AS monthly_consumption_unit_id, o_orderdate AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "b_layout_orders": """
SELECT o_orderkey AS source_id, o_orderkey % 16 AS v, CAST(o_orderkey % 7 AS STRING) AS k, c_name AS name, c_mktsegment AS seg, CAST(o_custkey AS STRING) AS cust, CONCAT(LPAD(CAST(DAY(o_orderdate) AS STRING), 2, '0'), '.', LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0'), '.', CAST(YEAR(o_orderdate) AS STRING)) AS dotted, CONCAT(CAST(YEAR(o_orderdate) AS STRING), '-', LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0'), '-', LPAD(CAST(DAY(o_orderdate) AS STRING), 2, '0')) AS day
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b_layout_pages": """
SELECT source_id, 1 AS page_no, CASE
 WHEN v = 5 THEN CONCAT('Safety data sheet', CHR(10), 'Revision: ', dotted, 'Version ', k, CHR(10), 'SECTION 1: I', CHR(10), '1.1 X')
 WHEN v = 6 THEN CONCAT('SEKCJA 1: I', CHR(10), '- 1.3 Szczegóły', CHR(10), '- Producent/Dostawcy:', CHR(10), CHR(10), seg, '     Tel', CHR(10), 'SEKCJA 2: Z')
 WHEN v = 14 THEN CONCAT('SEKCJA 1: I', CHR(10), '1.1 Identyfikator produktu', CHR(10), 'Nazwa handlowa:', CHR(10), name, CHR(10), 'SEKCJA 2: Z')
 ELSE CONCAT(
  CASE v WHEN 0 THEN CONCAT('karta charakterystyki', CHR(10), 'KC Numer: ', cust, CHR(10), 'V1.', k) WHEN 1 THEN CONCAT('Edycja    Data wydania    Data aktualizacji', CHR(10), '00', k, '    01.02.2003    ', dotted)
   WHEN 8 THEN CONCAT('karta charakterystyki', CHR(10), 'Data aktualizacji: ', day, CHR(10), 'Wydanie ', k) WHEN 9 THEN CONCAT('Data sporządzenia/aktualizacji: 01.02.2003 r. (1) ', dotted, ' r. (2)')
   WHEN 10 THEN CONCAT('karta charakterystyki', CHR(10), 'Data opracowania:', CHR(10), dotted, CHR(10), 'Data aktualizacji: -', CHR(10), 'Wersja 1.0') ELSE 'x' END,
  CHR(10), 'SEKCJA 1: I', CHR(10), '1.1 Identyfikator', CHR(10),
  CASE v WHEN 7 THEN CONCAT('- Nazwa handlowa: ', name, CHR(10), '- Numer artykułu: 12-', cust) WHEN 13 THEN CONCAT('Numery identyfikacyjne produktu', CHR(10), 'A-1 B-', cust, CHR(10), 'opis') ELSE '' END,
  CHR(10), '1.3 Dane dotyczące dostawcy karty charakterystyki', CHR(10),
  CASE v WHEN 2 THEN CONCAT('Producent', CHR(10), 'Nazwa lub nazwa handlowa   ', seg, CHR(10), '                           GmbH', CHR(10), 'Droga') WHEN 3 THEN CONCAT('Dostawca      Dystrybutor', CHR(10), seg, '      Inny')
   WHEN 11 THEN CONCAT('Dostawca:', CHR(10), seg, ' Sp. z o. o.') WHEN 12 THEN CONCAT('- Identyfikacja dystrybutora:', CHR(10), seg, ' GmbH', CHR(10), 'Droga', CHR(10), CHR(10), 'Inny', CHR(10), 'Dom') WHEN 15 THEN CONCAT('Adres: ', seg, ', ul. Długa 5') ELSE '' END,
  CHR(10), 'SEKCJA 2: Z', CHR(10), CASE v WHEN 4 THEN CONCAT('Data sporządzenia: 01.01.2001 Aktualizacja: ', dotted, ' Wersja: ', k, '.0 (zastępuje 1.0) Strona 1/9') ELSE 'koniec' END) END AS text FROM b_layout_orders""",
    "b_decisions": """
SELECT e.evidence_id * 10 AS decision_id, e.evidence_id, CASE WHEN e.evidence_id % 47 = 2 THEN 'DROP' WHEN m.id IS NULL THEN 'CREATE' ELSE 'LINK' END AS manufacturer_action, CASE WHEN e.evidence_id % 43 = 2 THEN 'Other' ELSE e.maker END AS manufacturer_name,
 CASE WHEN e.evidence_id % 53 = 2 THEN -1 ELSE m.id END AS manufacturer_id, CASE e.evidence_id % 17 WHEN 2 THEN 'Old name' WHEN 4 THEN m.name END AS seen_name, e.evidence_id % 19 <> 2 AS link_confirmed,
 CASE WHEN e.evidence_id % 59 = 2 THEN 'LINK' WHEN MIN(g.product_id) IS NULL THEN 'CREATE' ELSE 'LINK' END AS product_action, CASE WHEN e.evidence_id % 61 = 2 THEN 'Other' ELSE e.product_name END AS product_name, e.product_code, MIN(g.product_id) AS product_id, e.evidence_id % 4 <> 1 AS null_code_confirmed,
 CASE WHEN e.evidence_id % 23 = 2 THEN ' ' ELSE 'someone' END AS approved_by, e.evidence_id % 29 <> 2 AS manufacturer_confirmed, TRUE AS product_confirmed, TRUE AS pdf_confirmed, e.evidence_id % 31 <> 2 AS manual_confirmed, e.evidence_id % 37 <> 2 AS safety_confirmed,
 CASE WHEN e.evidence_id % 5 = 2 THEN 'use' WHEN e.evidence_id % 13 = 2 THEN ' ' END AS use_description, CASE WHEN e.evidence_id % 5 = 2 AND e.evidence_id % 7 <> 2 THEN 'limit' END AS use_restriction, e.evidence_id % 11 = 2 AS has_safety,
 CASE WHEN e.evidence_id % 41 = 2 THEN 'a/b.pdf' ELSE 'a.PDF' END AS original_filename, e.evidence_id % 71 <> 2 AS is_pdf, CASE WHEN e.evidence_id % 67 = 2 THEN 'y' ELSE 'x' END AS pdf_sha256, 'a.PDF' AS source_filename, 'x' AS source_sha256
FROM (SELECT evidence_id, REPLACE(manufacturer, ' AG', '') AS maker, CASE WHEN name_state = 'FOUND' THEN name END AS product_name, CASE WHEN code_state = 'FOUND' THEN code END AS product_code FROM b_evidence) e
LEFT JOIN (SELECT manufacturer_name AS name, MIN(manufacturer_id) AS id FROM b_makers GROUP BY manufacturer_name) m ON m.name = e.maker
LEFT JOIN b_goods g ON g.product_name = e.product_name AND g.manufacturer_id = m.id AND (e.product_code IS NULL OR g.manufacturer_product_code = e.product_code)
GROUP BY e.evidence_id, e.maker, e.product_name, e.product_code, m.id, m.name""",
    "b_drafts": """
SELECT o_orderkey AS source_id, CASE o_orderkey % 12 WHEN 1 THEN REPLACE(good, '"schema_version": "0.1"', '"schema_version": "9"') WHEN 2 THEN REPLACE(good, '"page_count": 2', '"page_count": "2"') WHEN 3 THEN REPLACE(good, '"state": "FOUND", "evidence": [{"page": 1, "source_text": "n"}]', '"state": "MAYBE", "evidence": []')
  WHEN 4 THEN REPLACE(good, '{"page": 1, "source_text": "n"}', '{"page": 0, "source_text": " "}') WHEN 5 THEN REPLACE(good, '1995-01-31', '1995-02-31') WHEN 6 THEN REPLACE(good, '"role": "MANUFACTURER"', '"role": "FRIEND"') WHEN 7 THEN REPLACE(good, '"from": 2, "to": 2', '"from": 2, "to": 9')
  WHEN 8 THEN REPLACE(good, '"document_key": "DOC-002"', '"document_key": "DOC-001"') WHEN 9 THEN REPLACE(good, '"review_status": "PENDING_REVIEW"', '"review_status": "APPROVED"') WHEN 10 THEN '{"documents": []}' WHEN 11 THEN CONCAT('[', good, ']') ELSE good END AS body
FROM (SELECT o_orderkey, CONCAT('{"schema": "SDS-JSON-001", "schema_version": "0.1", "source": {"original_filename": "', c_name, '", "file_sha256": "', MD5(c_name), MD5(c_name), '", "page_count": 2, "language": "pl", "readability_status": "READABLE"}, "documents": [', doc, ', ',
  REPLACE(REPLACE(doc, 'DOC-001', 'DOC-002'), '"from": 1, "to": 1', '"from": 2, "to": 2'), '], "extraction_report": {"logical_sds_count": 2, "warnings": [], "errors": []}}') AS good
 FROM (SELECT o_orderkey, c_name, CONCAT('{"document_key": "DOC-001", "page_range": {"from": 1, "to": 1}, "review_status": "PENDING_REVIEW", "product": {"product_name": {"value": "', c_name, '", "state": "FOUND", "evidence": [{"page": 1, "source_text": "n"}]}, ',
   '"manufacturer_product_code": {"value": null, "state": "NOT_FOUND", "evidence": []}}, "document_metadata": {"issue_date": {"value": "1995-01-31", "state": "FOUND", "evidence": [{"page": 1, "source_text": "d"}]}, "revision": {"value": "1", "state": "FOUND", "evidence": [{"page": 1, "source_text": "r"}]}}, ',
   '"parties": [{"role": "MANUFACTURER", "name": {"value": "Alfa", "state": "FOUND", "evidence": [{"page": 1, "source_text": "p"}]}}], "safety_profile": {}, "components": [], "validation": {"status": "REQUIRES_HUMAN_REVIEW", "issues": []}}') AS doc
  FROM orders JOIN customer ON o_custkey = c_custkey) t) u""",
    "b_safety_pages": """
SELECT o_orderkey AS source_id, 1 AS page_no, CONCAT('SEKCJA 1: X', CHR(10), 'H999', CHR(10), 'SEKCJA 2: ZAGROŻENIA', CHR(10), 'Definicja produktu: Mieszanina ', CAST(o_custkey AS STRING), CHR(10), 'Klasyfikacja CLP: ', o_orderpriority, CHR(10),
 CASE WHEN o_orderkey % 3 = 0 THEN 'Produkt nie został sklasyfikowany' ELSE CONCAT('Hasło ostrzegawcze: Uwaga', CHR(10), 'H225 H', CAST(300 + o_orderkey % 100 AS STRING), ' H225') END) AS text FROM orders
UNION ALL
SELECT o_orderkey, 2, CONCAT('SEKCJA 3: SKŁAD', CHR(10), 'Identyfikatory', CHR(10), 'Part ', CAST(o_custkey AS STRING), CHR(10), 'REACH #: 01-', CAST(o_orderkey AS STRING), CHR(10), 'WE: 200-', CAST(o_orderkey % 100 AS STRING), '-1', CHR(10),
 'CAS: ', CAST(100 + o_orderkey % 900 AS STRING), '-00-0', CHR(10), 'Flam. Liq. 2, H225', CHR(10), CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('WE: 300-', CAST(o_orderkey % 100 AS STRING), '-2', CHR(10), 'CAS: 7-11-9', CHR(10), '<10', CHR(10)) ELSE '' END, 'SEKCJA 4: Y', CHR(10), 'H111') FROM orders""",
    "b_draft_pages": """
SELECT o_orderkey AS source_id, 1 AS page_no, CONCAT(' ', CHR(10), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CONCAT('  Klej ', CAST(o_custkey AS STRING), ' ', CHR(10)) END, CASE WHEN o_orderkey % 4 = 0 THEN 'SAFETY DATA SHEET' ELSE 'KARTA CHARAKTERYSTYKI' END, CHR(10),
 'Data wydania/Data aktualizacji : ', CAST(1 + o_orderkey % 31 AS STRING), ', ', CASE o_orderkey % 5 WHEN 0 THEN 'may' WHEN 1 THEN 'luty' WHEN 2 THEN 'Kwietnia' ELSE 'grudnia' END, ', 2020', CHR(10), CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CONCAT('WERSJA : 2.', CAST(o_orderkey % 6 AS STRING), CHR(10)) END,
 'SEKCJA 1: A', CHR(10), 'Nazwa', CHR(32), 'i kod', CHR(10), CASE WHEN o_orderkey % 8 = 0 THEN 'A' ELSE CONCAT('AB-', CAST(o_custkey AS STRING)) END, CHR(10),
 CASE o_orderkey % 3 WHEN 0 THEN 'Paint or similar material. For industrial use only.' WHEN 1 THEN 'Farba lub inna podobna substancja.' ELSE '-' END) AS text FROM orders
UNION ALL
SELECT o_orderkey, 2, CONCAT('SEKCJA 2: B', CHR(10), 'Jedynie do stosowania przemysłowego.', CHR(10), 'SEKCJA 3: SKŁAD', CHR(10), 'Nazwa produktu/', CHR(10), 'składnika', CHR(10), 'stara nazwa', CHR(10), 'czynniki M i ATE', CHR(10), 'Alfa ', CAST(o_custkey AS STRING), CHR(10),
 CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('Nie sklasyfikowany.', CHR(10), CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CONCAT('Beta', CHR(10)) END) ELSE '' END, 'CAS: 10-', CAST(o_orderkey % 90 AS STRING), '-1', CHR(10), '10 - 20', CHR(10), 'Acute Tox. 3', CHR(10),
 CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('Gamma', CHR(10), 'Delta', CHR(10), 'Epsilon', CHR(10), 'Zeta', CHR(10)) ELSE '' END, 'CAS: 20-1-1', CHR(10), '≥5.5', CHR(10), 'H301', CHR(10), 'REACH #: 01-9', CHR(10), 'Omega', CHR(10), 'CAS: 30-1-1', CHR(10), 'H302 H302', CHR(10), 'SEKCJA 4: X') FROM orders""",
    "b_proofs": """
SELECT o_orderkey AS source_id, 'product_name' AS field, CASE WHEN o_orderkey % 50 = 0 THEN 3 ELSE 1 END AS page_no,
 CASE WHEN o_orderkey % 40 = 1 THEN '' WHEN o_orderkey % 30 = 2 THEN 'Nazwa produktu: other' ELSE CONCAT('1.1 Identyfikatory', CHR(10), ' Nazwa produktu: ', c_name) END AS source_text FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b_parties": """
SELECT o_orderkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'MANUFACTURER' WHEN 1 THEN 'SUPPLIER' WHEN 2 THEN 'OWNER' ELSE 'MANUFACTURER' END AS role, o_orderpriority AS name FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'MANUFACTURER' ELSE 'SUPPLIER' END, LOWER(o_orderpriority) FROM orders""",
    "b_bound_sources": "SELECT json_file, CASE WHEN position % 97 = 0 THEN 'notes.txt' ELSE json_name END AS file_name, json_sha256 AS sha256 FROM b_batch_items",
    "b_bound_manifest": "SELECT json_file, source_file, sha256_expected AS sha256 FROM b_batch_items WHERE position % 9 <> 0 UNION ALL SELECT json_file, source_file, sha256_expected FROM b_batch_items WHERE position % 83 = 0",
    "b_bound_stored": "SELECT source_file AS file_name, COALESCE(sha256, '') AS sha256, position % 11 <> 0 AS is_pdf FROM b_batch_items WHERE position % 7 <> 0",
    "b_bound_fallback": "SELECT json_file, CASE WHEN position % 6 = 0 THEN 'a/b.pdf' ELSE 'given.PDF' END AS file_name, CASE WHEN position % 4 = 0 THEN json_sha256 ELSE sha256 END AS sha256, TRUE AS is_pdf FROM b_batch_items WHERE position % 2 = 0",
    "b_frozen": """
SELECT evidence_id * 10 AS decision_id, evidence_id, evidence_id % 11 <> 0 AS approved, CONCAT('j', CAST(CASE WHEN evidence_id % 13 = 0 THEN 0 ELSE evidence_id END AS STRING)) AS json_sha256, CONCAT('p', CAST(CASE WHEN evidence_id % 17 = 0 THEN 0 ELSE evidence_id END AS STRING)) AS pdf_sha256,
 CASE WHEN name_state = 'FOUND' THEN name END AS product_name, CASE WHEN code_state = 'FOUND' THEN code END AS product_code, CAST(CASE WHEN issue_date_state = 'FOUND' AND evidence_id % 29 <> 0 THEN issue_date END AS DATE) AS issue_date,
 CASE WHEN evidence_id % 19 = 1 THEN '?' ELSE revision END AS revision, CASE WHEN manufacturers = 1 AND manufacturer_state = 'FOUND' THEN CASE WHEN evidence_id % 8 = 0 THEN 'Unknown maker' WHEN evidence_id % 8 = 1 THEN 'Works' ELSE SUBSTRING(manufacturer, 1, LENGTH(manufacturer) - 3) END END AS canonical,
 CASE WHEN evidence_id % 3 = 0 THEN 'NATION_7' ELSE 'NATION_1' END AS existing_manufacturer FROM b_evidence""",
    "b_pages": """
SELECT o_orderkey AS source_id, 1 AS page_no, CONCAT('KARTA CHARAKTERYSTYKI', CHR(10),
 CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE CONCAT('Data aktualizacji: ',
  LPAD(CAST(DAY(o_orderdate) AS STRING), 2, '0'), '.', LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0'), '.',
  CAST(YEAR(o_orderdate) AS STRING), CHR(10)) END,
 'Wersja: ', CAST(o_orderkey % 9 AS STRING), '.0', CHR(10),
 'SEKCJA 1: IDENTYFIKACJA', CHR(10), '1.1 Identyfikatory', CHR(10),
 'Nazwa produktu: ', c_name, CHR(10),
 'Kod produktu: ', CASE WHEN o_orderkey % 5 = 3 THEN 'K�' ELSE 'K' END, CAST(o_custkey AS STRING), CHR(10),
 '1.3 Strony', CHR(10), 'EU Only Representative: ', n_name, CHR(10),
 'SEKCJA 2: ZAGROŻENIA', CHR(10), 'H', CAST(200 + o_orderkey % 150 AS STRING), ' H300 H300') AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT o_orderkey, 2, CONCAT(
 CASE WHEN o_orderkey % 5 = 4 THEN CONCAT('SEKCJA 1: IDENTYFIKACJA', CHR(10), '1.1 Identyfikatory', CHR(10),
  'Nazwa produktu: ', c_name, ' B', CHR(10)) ELSE '' END,
 'SEKCJA 3: SKŁAD', CHR(10), 'CAS: ', CAST(100 + o_orderkey % 900 AS STRING), '-00-0', CHR(10),
 'Wersja: ', CASE WHEN o_orderkey % 5 = 2 THEN '77.7' ELSE CONCAT(CAST(o_orderkey % 9 AS STRING), '.0') END)
FROM orders JOIN customer ON o_custkey = c_custkey""",
}

# bound tables whose rows are long texts, or read by work that costs far more than reading them
TEXTS = {"b_layout_pages", "b_layout_orders", "b_drafts", "b_draft_pages", "b_safety_pages", "b_pages"}

_NAME = re.compile(r"\b(b_[a-z_]+)\b")


def _needed(sql: str, extra: dict[str, str]) -> list[str]:
    known = {**BINDINGS, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the bindings it names, for an engine that already has the raw tables."""
    extra = extra or {}
    known = {**BINDINGS, **extra}
    parts = [f"{name} AS ({known[name].strip()})" for name in _needed(sql, extra)]
    body = sql.strip()
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str, extra: dict[str, str] | None = None) -> DataFrame:
    extra = extra or {}
    known = {**BINDINGS, **extra}
    bound = [n for n in _needed(name, extra) if n != name]
    text = " ".join(known[n] for n in [*bound, name])
    # rows that become texts are dealt while they are still narrow
    dealt = f"/*+ REPARTITION({spread.partitions(spark)}, o_orderkey) */ " if name in TEXTS else ""
    scans = [f"{t} AS (SELECT {dealt if t == 'orders' else ''}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in RAW if re.search(rf"\b{t}\b", text)]
    parts = scans + [f"{n} AS ({known[n].strip()})" for n in bound]
    return spark.sql("WITH " + ", ".join(parts) + " " + known[name].strip())


class Registry:
    """The registry tables, each bound on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, extra: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.extra = spark, sf_dir, extra or {}
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        if table not in self._seen:
            name = {"unit_of_measure": "b_units"}.get(table, f"b_{table}")
            self._seen[table] = bind(self.spark, self.sf_dir, name, self.extra)
        return self._seen[table]
