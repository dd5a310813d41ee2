"""Batches that name one entity several times, against the same requests carried out one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chemledger.operators import registration, transitions

T0 = dt.datetime(2024, 1, 5)
PRODUCT = "product_id string, product_name string, manufacturer_product_code string, manufacturer_id string, use_description string, use_restriction string, usage_status string, waste_type string, waste_code string"
DOCUMENT = "sds_id string, product_id string, original_filename string, relative_path string, issue_date date, revision string, document_status string, registered_at timestamp_ntz, file_status string"
AUDIT = "invalidation_id string, product_id string, invalidated_sds_id string, invalidated_from_status string, restored_sds_id string, reason string, invalidated_at timestamp_ntz"
DECISION = "decision_id string, product_id string, sds_id string, decision_status string, notes string, registered_at timestamp_ntz, record_status string, evidence_id string"


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(p, f"name {p}", None if p == "p3" else "c", "m", "u", "r", "ACTIVE", None, None) for p in ("p1", "p2", "p3")], PRODUCT)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(f"{p}-{k}", p, "f", "f", dt.date(2023, 1, 1), "1", "CURRENT" if k == 0 else "ARCHIVED", T0, "AVAILABLE") for p in ("p1", "p2", "p3") for k in range(4)]
    return spark.createDataFrame(rows, DOCUMENT)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_last_revision_is_current(spark, products, documents):
    requests = spark.createDataFrame(
        [("r1", 3, "p1", "n1", "", "a/x.pdf", dt.date(2024, 1, 1), "2", T0), ("r2", 1, "p1", "n2", "y.pdf", "a/y.pdf", dt.date(2024, 1, 1), "3", T0), ("r3", 2, "p1", "n2", "z.pdf", "a/z.pdf", dt.date(2024, 1, 1), "4", T0),
         ("r4", 0, "p2", "n3", "w.pdf", " ", dt.date(2024, 1, 1), "4", T0)],
        "request_id string, seq int, product_id string, sds_id string, original_filename string, relative_path string, issue_date date, revision string, at timestamp_ntz")
    out = transitions.register_revisions(products, documents, requests)
    got = out.tables["sds_documents"]
    assert rows_of(got.where("product_id = 'p1'"), "sds_id", "document_status") == [("n1", "CURRENT"), ("n2", "ARCHIVED"), ("p1-0", "ARCHIVED"), ("p1-1", "ARCHIVED"), ("p1-2", "ARCHIVED"), ("p1-3", "ARCHIVED")]
    assert got.count() == 14 and out.tables["products"].count() == 3 and out.history.count() == 2
    assert rows_of(out.rejected, "request_id", "reason") == [("r3", "SDS_ID_TAKEN"), ("r4", "SOURCE_PATH_REQUIRED")]


def one_by_one(documents: dict, status: dict, done: set, requests: list[dict]) -> dict:
    """Withdrawals carried out in turn on dictionaries: the reason of each request or None."""
    why = {}
    for r in sorted(requests, key=lambda r: (r["seq"], r["request_id"])):
        mine = {s: d for s, d in documents.items() if d["product"] == r["product_id"]}
        current = min((s for s, d in mine.items() if d["status"] == "CURRENT"), default=None)
        fits = r["expected_status"] in ("CURRENT", "ARCHIVED") and (r["mode"] == "ARCHIVED_ONLY") == (r["expected_status"] == "ARCHIVED") and (r["mode"] == "RESTORE_ARCHIVED") == (r["restored_sds_id"] is not None) and r["restored_sds_id"] != r["sds_id"]
        target, back = mine.get(r["sds_id"]), mine.get(r["restored_sds_id"])
        reason = ("REASON_REQUIRED" if not r["reason_text"].strip() else "MODE_DOES_NOT_FIT" if not fits else "STALE_PRODUCT" if r["product_id"] not in status else "STALE_DOCUMENT" if target is None or target["status"] != r["expected_status"]
                  else "STALE_CURRENT" if current != r["expected_current_sds_id"] else "ALREADY_INVALIDATED" if r["sds_id"] in done else "STALE_RESTORED" if r["mode"] == "RESTORE_ARCHIVED" and (back is None or back["status"] != "ARCHIVED") else None)
        why[r["request_id"]] = reason
        if reason is None:
            target["status"] = "INVALIDATED"
            if back:
                back["status"] = "CURRENT"
            if r["expected_status"] == "CURRENT":
                status[r["product_id"]] = "PENDING_APPROVAL"
    return why


def test_withdrawals_in_order(spark, products, documents):
    rng = random.Random(3)
    state = {r["sds_id"]: {"product": r["product_id"], "status": r["document_status"]} for r in documents.collect()}
    requests = []
    for k in range(300):
        p = rng.choice(["p1", "p2", "p3", "p9"])
        mode = rng.choice(["ARCHIVED_ONLY", "NO_CURRENT", "RESTORE_ARCHIVED", "RESTORE_ARCHIVED"])
        requests.append({
            "request_id": f"q{k}", "seq": rng.randrange(40), "product_id": p, "sds_id": f"{rng.choice([p, p, p, 'p1'])}-{rng.randrange(4)}", "expected_status": "ARCHIVED" if mode == "ARCHIVED_ONLY" else rng.choice(["CURRENT"] * 5 + ["INVALIDATED"]),
            "expected_current_sds_id": rng.choice([None, f"{p}-{rng.randrange(4)}", f"{p}-0"]), "mode": mode, "restored_sds_id": f"{p}-{rng.randrange(4)}" if mode == "RESTORE_ARCHIVED" else None, "reason_text": rng.choice(["x"] * 9 + [" "]), "at": T0})
    schema = "request_id string, seq int, product_id string, sds_id string, expected_status string, expected_current_sds_id string, mode string, restored_sds_id string, reason_text string, at timestamp_ntz"
    decisions = spark.createDataFrame([], DECISION)
    out = transitions.invalidate(products, documents, decisions, spark.createDataFrame([("a", "p2", "p2-3", "ARCHIVED", None, "x", T0)], AUDIT), spark.createDataFrame(requests, schema))
    status = {p: "ACTIVE" for p in ("p1", "p2", "p3")}
    why = one_by_one(state, status, {"p2-3"}, requests)
    assert len({w for w in why.values()}) >= 7 and sum(w is None for w in why.values()) >= 6
    assert dict(rows_of(out.rejected, "request_id", "reason")) == {k: w for k, w in why.items() if w}
    assert dict(rows_of(out.tables["sds_documents"], "sds_id", "document_status")) == {s: d["status"] for s, d in state.items()}
    assert dict(rows_of(out.tables["products"], "product_id", "usage_status")) == status
    assert out.tables["sds_invalidation"].count() == 1 + sum(w is None for w in why.values())
    assert out.history.count() == sum(s == "PENDING_APPROVAL" for s in status.values())


def test_corrections_follow_each_other(spark, products):
    makers = spark.createDataFrame([("m", "M"), ("t1", "T"), ("t2", "T")], "manufacturer_id string, manufacturer_name string")
    requests = spark.createDataFrame(
        [("1", "p1", "A", "c", "M", T0), ("2", "p1", "A", "c", "M", T0), ("3", "p1", "B", None, "New", T0), ("4", "p1", "B", "d", "M", T0), ("5", "p1", "B", None, "T", T0), ("6", "p1", "C", None, "New", T0), ("7", "p3", "Z", "q", "M", T0)],
        "request_id string, product_id string, product_name string, code string, manufacturer_name string, at timestamp_ntz")
    out = registration.correct_identities(products, makers, requests)
    assert rows_of(out.rejected, "request_id", "reason") == [("2", "NO_CHANGE"), ("4", "CODE_COMPLETION_IS_SEPARATE"), ("5", "MANUFACTURER_AMBIGUOUS"), ("7", "CODE_COMPLETION_IS_SEPARATE")]
    assert rows_of(out.history, "change_id", "old_product_name", "new_product_name", "old_manufacturer_product_code") == [("1", "name p1", "A", "c"), ("3", "A", "B", "c"), ("6", "B", "C", None)]
    row = out.tables["products"].where("product_id = 'p1'").first()
    assert (row["product_name"], row["manufacturer_product_code"]) == ("C", None) and out.tables["manufacturers"].count() == 4


def test_many_requests_for_one_entity(spark, products):
    """One product with thousands of requests: the last one stays, and no row is doubled."""
    requests = spark.range(5_000).select(F.col("id").cast("string").alias("request_id"), F.col("id").alias("seq"), F.lit("p1").alias("product_id"), F.col("id").cast("string").alias("use_description"), F.lit("r").alias("use_restriction"),
                                         F.lit("w").alias("waste_type"), F.lit("c").alias("waste_code"), F.lit(T0).alias("at"))
    out = transitions.update_administrative(products, requests)
    assert rows_of(out.tables["products"], "product_id", "use_description") == [("p1", "4999"), ("p2", "u"), ("p3", "u")]
    assert out.history.count() == 5_000


def test_correction_and_revision_together(spark, products, documents):
    makers = spark.createDataFrame([("m", "M")], "manufacturer_id string, manufacturer_name string")
    rows = [("1", "p1", "A", "c", "M", T0, "n1", "f", "a/f.pdf", dt.date(2024, 1, 1), "1"), ("2", "p1", "B", "c", "M", T0, "n2", "f", " ", dt.date(2024, 1, 1), "1"), ("3", "p2", "name p2", "c", "M", T0, "n3", "f", "a/f.pdf", dt.date(2024, 1, 1), "1"),
            ("4", "p1", "D", "c", "M", T0, "n1", "f", "a/f.pdf", dt.date(2024, 1, 1), "1")]
    out = registration.correct_and_register(products, makers, documents, spark.createDataFrame(rows, "request_id string, product_id string, product_name string, code string, manufacturer_name string, at timestamp_ntz, sds_id string, original_filename string, relative_path string, issue_date date, revision string"))
    assert rows_of(out.rejected, "request_id", "reason") == [("2", "SOURCE_PATH_REQUIRED"), ("3", "NO_CHANGE"), ("4", "SDS_ID_TAKEN")]
    assert rows_of(out.tables["products"], "product_id", "product_name", "usage_status") == [("p1", "A", "PENDING_APPROVAL"), ("p2", "name p2", "ACTIVE"), ("p3", "name p3", "ACTIVE")]
    assert rows_of(out.tables["sds_documents"].where("document_status = 'CURRENT'"), "sds_id") == [("n1",), ("p2-0",), ("p3-0",)] and out.history.count() == 1 and out.tables["product_identity_changes"].count() == 1
