"""Joins, windows and counts of the registry that must not gather in one task, be dealt twice or take memory by how well rows shrink."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chemledger.operators import audits, layouts, registration, transitions
from chemledger.plans import ordered, spread


def physical(df):
    """The plan before it is adapted."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Tables too large to be sent to all, as far as Spark can tell."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_units_do_not_gather_requests(spark, no_broadcast):
    requests = spark.createDataFrame([("a", 1, 1, 7, 1, "F", None, None, "x"), ("b", 2, 1, 7, 2, "O", None, None, "x"), ("c", 3, 1, 7, 3, "F", 1, "F", "x"), ("d", 4, 2, None, 3, "F", None, None, "x")],
                                     "request_id string, seq int, product_id int, location_id int, peak_quantity_value int, peak_quantity_unit_id string, monthly_consumption_value int, monthly_consumption_unit_id string, at string")
    locations = spark.createDataFrame([(7, "ACTIVE")], "location_id int, status string")
    units = spark.createDataFrame([("F", "ACTIVE"), ("O", "INACTIVE")], "unit_id string, status string")
    held = requests.drop("request_id", "seq", "at").where("product_id = 2")
    out = registration.set_quantities(held, locations, units, requests, True)
    assert {r["request_id"]: r["reason"] for r in out.rejected.collect()} == {"b": "UNIT_INACTIVE", "c": "ALREADY_ASSIGNED", "d": "LOCATION_NOT_FOUND"}
    for c in ("peak_quantity_unit_id", "monthly_consumption_unit_id"):
        assert f"hashpartitioning({c}" not in physical(out.rejected)


def test_corrections_are_dealt_once(spark, no_broadcast):
    products = spark.createDataFrame([(1, "p", "c", 5), (2, "q", None, 5)], "product_id int, product_name string, manufacturer_product_code string, manufacturer_id int")
    makers = spark.createDataFrame([(5, "Works"), (6, "Twice"), (7, "Twice")], "manufacturer_id int, manufacturer_name string")
    rows = [("a", 1, 1, "p2", "c", "Works"), ("b", 2, 1, "p2", "c", "Works"), ("c", 3, 1, "p", "c", "Twice"), ("d", 4, 1, "p3", "c", None), ("e", 1, 2, "q", "x", "New"), ("f", 1, 3, "z", "x", "New")]
    requests = spark.createDataFrame([(*r, "now") for r in rows], "request_id string, seq int, product_id int, product_name string, code string, manufacturer_name string, at string")
    out = registration.correct_identities(products, makers, requests)
    assert {r["request_id"]: r["reason"] for r in out.rejected.collect()} == {"b": "NO_CHANGE", "c": "MANUFACTURER_AMBIGUOUS", "e": "CODE_COMPLETION_IS_SEPARATE", "f": "PRODUCT_NOT_FOUND"}
    plan = physical(out.rejected)
    assert "hashpartitioning(wanted_maker" not in plan and "REPARTITION_BY_NUM" in plan


def test_withdrawals_that_restore_nothing_are_spread(spark, no_broadcast):
    products = spark.createDataFrame([(1, "ACTIVE")], "product_id int, usage_status string")
    documents = spark.createDataFrame([(10, 1, "CURRENT"), (11, 1, "ARCHIVED"), (12, 1, "ARCHIVED")], "sds_id int, product_id int, document_status string")
    decisions = spark.createDataFrame([], "decision_id int, sds_id int, record_status string")
    audit = spark.createDataFrame([], "invalidation_id int, product_id int, invalidated_sds_id int, invalidated_from_status string, restored_sds_id int, reason string, invalidated_at string")
    requests = spark.createDataFrame([(1, 1, 1, 10, "CURRENT", 10, "RESTORE_ARCHIVED", 11, "x", "t"), (2, 2, 1, 11, "CURRENT", 11, "NO_CURRENT", None, "x", "t"), (3, 3, 1, 12, "ARCHIVED", None, "ARCHIVED_ONLY", None, " ", "t")],
                                     "request_id int, seq int, product_id int, sds_id int, expected_status string, expected_current_sds_id int, mode string, restored_sds_id int, reason_text string, at string")
    out = transitions.invalidate(products, documents, decisions, audit, requests)
    assert {r["request_id"]: r["reason"] for r in out.rejected.collect()} == {3: "REASON_REQUIRED"}
    assert {r["sds_id"]: r["document_status"] for r in out.tables["sds_documents"].collect()} == {10: "INVALIDATED", 11: "INVALIDATED", 12: "ARCHIVED"}
    assert "hashpartitioning(restored_sds_id" not in physical(out.rejected)


def test_references_read_each_table_once(spark):
    places = spark.range(77).selectExpr("if(id = 5, null, id % 7) as product_id", "id % 3 as location_id", "if(id = 9, 'X', 'F') as peak_quantity_unit_id", "cast(null as string) as monthly_consumption_unit_id")
    tables = {"product_usage_locations": places, "products": spark.range(6).selectExpr("id as product_id", "1 as manufacturer_id"), "usage_locations": spark.range(1, 3).selectExpr("id as location_id"),
              "unit_of_measure": spark.createDataFrame([("F",), (None,)], "unit_id string"), "sds_documents": spark.createDataFrame([(1, 1), (2, 9)], "sds_id int, product_id int"),
              "bhp_decisions": spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, None, 1)], "sds_id int, product_id int, evidence_id int")}
    out = audits.reference_violations(tables)
    assert logical(out).count("Range (0, 77") == 1
    got = {(r["table_name"], r["rule"]): r["violations"] for r in out.collect()}
    assert got == {("product_usage_locations", "product_id -> products"): 11, ("product_usage_locations", "location_id -> usage_locations"): 26, ("product_usage_locations", "peak_quantity_unit_id -> unit_of_measure"): 1,
                   ("product_usage_locations", "monthly_consumption_unit_id -> unit_of_measure"): 0, ("sds_documents", "product_id -> products"): 1, ("bhp_decisions", "sds_id, product_id -> sds_documents"): 1}


def test_next_values_deal_rows_once(spark, no_broadcast):
    rows = spark.range(60).selectExpr("if(id % 5 = 0, null, id % 5) as k", "id % 2 as j", "if(id % 7 = 0, null, timestamp_seconds(id * 700000)) as at", "cast(id as string) as h")
    own = Window.partitionBy("k", "j").orderBy("at", "h")
    out = ordered.lead_values(rows, ["k", "j"], "at", ["h"], "at", "next")
    assert out.columns == ["k", "j", "at", "h", "next"]
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.withColumn("next", F.lead("at").over(own)).collect()))
    numbers = ordered.row_numbers(rows, ["k", "j"], "at", ["h"], "n")
    assert sorted(map(str, numbers.collect())) == sorted(map(str, rows.withColumn("n", F.row_number().over(own).cast("long")).collect()))
    assert physical(out).count("Exchange hashpartitioning") == 4 and "min_by" not in logical(out)


def test_observations_are_reduced_before_they_are_looked_up(spark, no_broadcast):
    reviews = spark.createDataFrame([(1, "DRAFT"), (2, "FINAL")], "review_id int, status string")
    items = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 2, 0), ("d", 3, 0)], "review_item_id string, review_id int, observed_quantity int")
    requests = spark.range(8).selectExpr("id as request_id", "id as seq", "substring('abcdabab', int(id) + 1, 1) as review_item_id", "if(id = 6, null, if(id = 7, -1, int(id) + 1)) as observed_quantity")
    out = transitions.record_observed(reviews, items, requests)
    assert {r["review_item_id"]: r["observed_quantity"] for r in out.tables["physical_review_items"].collect()} == {"a": None, "b": 6, "c": 0, "d": 0}
    assert {r["request_id"]: r["reason"] for r in out.rejected.collect()} == {2: "REVIEW_IS_FINAL", 3: "ITEM_NOT_FOUND", 7: "NEGATIVE_QUANTITY"}
    above = logical(out.tables["physical_review_items"]).split("Range (0, 8")[0]
    assert above.rindex("Aggregate") > above.rindex("Join")


def test_pages_are_read_once_for_their_documents(spark):
    read = layouts.read_pages(spark.createDataFrame([(1, 1, "SEKCJA 1: I")], "source_id int, page_no int, text string")).persist()
    assert read.documents.storageLevel.useMemory and read.results.storageLevel.useMemory
    read.unpersist()
    assert not read.documents.storageLevel.useMemory


def test_texts_are_dealt_over_fewer_tasks_than_shuffles_have(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert spread.TURNS * spark.sparkContext.defaultParallelism <= spread.partitions(spark) < 2000
        assert spread.sorted_partitions(spark) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
