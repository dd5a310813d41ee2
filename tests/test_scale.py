"""What keeps the queries over texts and decisions from growing faster than their rows."""

from pyspark.sql import functions as F

from chemledger.fixtures import bindings
from chemledger.operators import approvals, evidence, extraction, gates, layouts
from chemledger.plans import spread

GOOD = '{"schema": "SDS-JSON-001", "schema_version": "0.1", "documents": [{"document_key": "DOC-001"}, 7]}'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drafts_are_dealt_while_narrow(spark, tmp_path):
    spark.range(10).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'1995-01-31' as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(10).selectExpr("id as c_custkey", "'x' as c_name", "'y' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "documents.parquet"))  # a word of the drafts that names a table, too
    for name in ("b_drafts", "b_layout_pages"):
        assert "RepartitionByExpression" in plan(bindings.bind(spark, str(tmp_path), name))
    assert spread.partitions(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_texts_are_read_once(spark):
    """A plain explode of what was read infers a filter below it that reads everything once more."""
    drafts = spark.createDataFrame([(1, GOOD), (2, "[]"), (3, None)], "source_id int, body string")
    pages = spark.createDataFrame([(1, 1, "a\nCAS: 1-1-1"), (2, 1, None)], "source_id int, page_no int, text string")
    for df in (gates.validated_documents(drafts), layouts.page_results(layouts.page_parts(pages)), extraction.page_lines(pages), evidence.components(pages)):
        below = plan(df).split("Generate", 1)[1]
        assert "Filter" not in below
    assert plan(gates.validated_documents(drafts)).count("parseJson") == 1
    got = [(r["source_id"], r["document_no"], r["document_key"]) for r in gates.validated_documents(drafts).sort("source_id", "document_no").collect()]
    assert got == [(1, 1, "DOC-001"), (1, 2, "INVALID-2"), (2, 0, "INVALID-ENVELOPE"), (3, 0, "INVALID-ENVELOPE")]
    assert [r["source_id"] for r in extraction.page_lines(pages).collect()] == [1, 1]
    assert [r["source_id"] for r in evidence.components(pages).collect()] == [1]


def test_patterns_are_compiled_for_lines_with_their_first_word(spark):
    pages = spark.createDataFrame([(1, 1, "SEKCJA 1: I\n1.1 I\nNAZWA   produktu: a\nKod: b")], "source_id int, page_no int, text string")
    hits = extraction.rule_hits(extraction.context_lines(extraction.labelled_lines(pages)), extraction.rule_table(spark))
    assert "needle" in plan(hits)
    assert [(r["alias_id"], r["value"]) for r in hits.collect()] == [("A-001", "a")]


def test_approvals_carry_hashes_of_snapshots(spark):
    makers = spark.createDataFrame([(k, f"Works {k}") for k in range(50)], "manufacturer_id int, manufacturer_name string")
    goods = spark.createDataFrame([(k, "p", 1, "c") for k in range(3)], "product_id int, product_name string, manufacturer_id int, manufacturer_product_code string")
    columns = "decision_id int, evidence_id int, manufacturer_action string, manufacturer_name string, manufacturer_id int, seen_name string, link_confirmed boolean, product_action string, product_name string, product_code string, product_id int, null_code_confirmed boolean, approved_by string, manufacturer_confirmed boolean, product_confirmed boolean, pdf_confirmed boolean, manual_confirmed boolean, safety_confirmed boolean, use_description string, use_restriction string, has_safety boolean, original_filename string, is_pdf boolean, pdf_sha256 string, source_filename string, source_sha256 string"
    rest = (None, True, "me", True, True, True, True, True, None, None, False, "a.pdf", True, "x", "a.pdf", "x")
    decisions = spark.createDataFrame([(n, n, "CREATE", "Works", None, None, True, "CREATE", "p", None, *rest) for n in range(4)] + [(9, 9, "LINK", "Works 1", 1, None, True, "LINK", "p", None, 2, *rest[1:])], columns)
    plans = decisions.select("evidence_id", F.lit("p").alias("product_name"), F.lit(None).cast("string").alias("product_code"), F.col("manufacturer_name").alias("canonical"), F.lit("CREATE_CANDIDATE").alias("manufacturer_status"), F.lit("").alias("blockers"))
    lazy = approvals.approvals(decisions, plans, makers, goods)
    got = lazy.localCheckpoint()
    rows = {r["decision_id"]: r for r in got.collect()}
    assert {r["verdict"] for r in rows.values()} == {"APPROVED"}
    assert [x["id"] for x in rows[0]["makers"]] == list(range(50)) and rows[0]["goods"] == []
    # exact first, then similar ones
    assert [x["id"] for x in rows[9]["makers"]][:2] == [1, 0] and [x["id"] for x in rows[9]["goods"]] == [0, 1, 2]
    drift = lambda old, m, g: {r["decision_id"]: r["drift"] for r in approvals.stale_approvals(old, decisions, m, g).collect()}
    renamed = makers.withColumn("manufacturer_name", F.when(F.col("manufacturer_id") == 7, "Other").otherwise(F.col("manufacturer_name")))
    assert set(drift(got, renamed, goods).values()) == {"STALE"}
    # with or without the hashes
    for old in (got, got.drop("makers_hash", "goods_hash")):
        assert drift(old, makers, goods.where("product_id < 2")) == {0: "CURRENT", 1: "CURRENT", 2: "CURRENT", 3: "CURRENT", 9: "STALE"}
    assert "makers_hash" in lazy.columns and "goods_hash" in lazy.columns
