"""Review items resolved by decisions, and written batches checked, on rows that the bindings do not hold."""

from __future__ import annotations

import datetime as dt

from chemledger.operators import corrections

ITEM = "position long, manifest_id string, status string, logical_sds_count int, json_file string, source_file string, sha256_expected string, sha256 string, json_name string, json_sha256 string, product_name string, product_code string, issue_date date, revision string, manufacturer string"
DECISION = "manifest_id string, observed string, action string, product_id string, preserve_name string, preserve_code string, old_manufacturer_id long, new_manufacturer_id long, product_name string, product_code string"


def resolved(spark, at, name="Klej", code=None, sha="f" * 64, revision="2", maker="Old", unread=False, **decision):
    item = spark.createDataFrame([(1, "P1", "COMPLETE", 1, "P1_DOC-001.json", "a.pdf", sha, sha, "a.pdf", sha, name, code, at, revision, maker)], ITEM)
    said = {"manifest_id": "P1", "observed": "Old", "action": corrections.CORRECT, "product_id": "k", "preserve_name": "Klej", "preserve_code": None, "old_manufacturer_id": 2, "new_manufacturer_id": 1, "product_name": "Klej", "product_code": None} | decision
    decisions = spark.createDataFrame([tuple(said.values())], DECISION)
    products = spark.createDataFrame([("k", "Klej", None, 2)], "product_id string, product_name string, manufacturer_product_code string, manufacturer_id long")
    docs = [("s1", "k", "CURRENT", dt.date(2020, 1, 1), "1", None if unread else "a" * 64), ("s0", "k", "ARCHIVED", dt.date(2019, 1, 1), "0", "b" * 64)]
    documents = spark.createDataFrame(docs, "sds_id string, product_id string, document_status string, issue_date date, revision string, sha256 string")
    (row,) = corrections.resolve_reviews(item, decisions, products, documents, "New", 1).collect()
    return f"{row.classification}/{row.reason}"


def test_resolutions(spark):
    new, old, now = dt.date(2021, 1, 1), dt.date(2018, 1, 1), dt.date(2020, 1, 1)
    assert resolved(spark, new) == "READY_IDENTITY_CORRECTION_AND_ADD_REVISION/NEW_SDS_AFTER_CORRECTION"
    assert resolved(spark, old) == "REVIEW_SOURCE_CONFLICT/INCOMING_NOT_NEWER_THAN_CURRENT_SDS"
    assert resolved(spark, now, sha="a" * 64, revision="1") == "READY_IDENTITY_CORRECTION_ONLY/EXACT_EXISTING_SDS_CORRECT_MANUFACTURER"
    assert resolved(spark, now, revision="1") == "REVIEW_SOURCE_CONFLICT/SDS_METADATA_SOURCE_CONFLICT"
    assert resolved(spark, new, sha="b" * 64) == "REVIEW_SOURCE_CONFLICT/PDF_METADATA_CONFLICT"
    assert resolved(spark, new, unread=True) == "BLOCKED_DATA/REGISTERED_PDF_UNAVAILABLE:s1"
    assert resolved(spark, new, preserve_name="Farba") == "REVIEW_IDENTITY/APPROVED_PRODUCT_SNAPSHOT_MISMATCH"
    assert resolved(spark, new, code="K-1") == "REVIEW_IDENTITY/APPROVED_PRODUCT_SNAPSHOT_MISMATCH"
    assert resolved(spark, new, maker="Else") == "BLOCKED_DATA/DECISION_SOURCE_MISMATCH"
    assert resolved(spark, new, action=corrections.CREATE) == "READY_CREATE/APPROVED_DISTINCT_PRODUCT"
    assert resolved(spark, new, action=corrections.CREATE, product_name="Farba") == "BLOCKED_DATA/PRODUCT_DECISION_SOURCE_MISMATCH"
    assert resolved(spark, new, action=corrections.RESOLVE) == "REVIEW_IDENTITY/SIMILAR_OR_CODE_CONFLICT_PRODUCT"


def test_verification(spark):
    report = spark.createDataFrame([("P1", "READY_CREATE", "COMMITTED", "a", "s1", "A", "x"), ("P2", "READY_CREATE", "COMMITTED", "b", "s2", "B", "x"), ("P3", "READY_CREATE", "COMMITTED", "z", "s9", "Z", "x"), ("P4", "REVIEW_IDENTITY", "NOT_ATTEMPTED", None, None, "A", None)],
                                   "manifest_id string, classification string, action string, product_id string, sds_id string, product_name string, sha256 string")
    products = spark.createDataFrame([("a", "A", 1, None, None), ("b", "B2", 2, "u", None), ("c", "B", 1, None, None), ("d", "B", 1, None, None)], "product_id string, product_name string, manufacturer_id long, use_description string, use_restriction string")
    documents = spark.createDataFrame([("s1", "a", "CURRENT", "1.pdf"), ("s2", "c", "ARCHIVED", "2.pdf")], "sds_id string, product_id string, document_status string, relative_path string")
    history = spark.createDataFrame([("a",), ("b",), ("b",)], "product_id string")
    s2 = spark.createDataFrame([("s2",), ("s2",), (None,)], "sds_id string")
    stored = spark.createDataFrame([("1.pdf", "x")], "relative_path string, sha256 string")
    out = corrections.verify_batch(report, products, documents, history, s2, s2, s2, stored, 1)
    assert {r.manifest_id: list(r.issues) for r in out.collect()} == {
        "P1": [], "P3": ["PRODUCT_MISSING", "HISTORY_NOT_ONE", "DOCUMENT_MISSING"],
        "P2": ["NAME_DIFFERS", "MANUFACTURER_DIFFERS", "USE_ALREADY_SET", "NAME_NOT_UNIQUE", "HISTORY_NOT_ONE", "DOCUMENT_OF_ANOTHER_PRODUCT", "DOCUMENT_NOT_CURRENT", "FILE_DIFFERS", "PROFILE_PRESENT", "COMPONENTS_PRESENT", "DECISION_PRESENT"]}
    counts = {(r.classification, r.action): (r["items"], r.checked, r.failed) for r in corrections.batch_verified(report, out).collect()}
    assert counts == {("READY_CREATE", "COMMITTED"): (3, 3, 2), ("REVIEW_IDENTITY", "NOT_ATTEMPTED"): (1, 0, 0)}
