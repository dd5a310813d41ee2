"""What keeps plans and lists of approvals small."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from chemledger import catalog
from chemledger.operators import approvals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_many_steps_are_leaves(spark):
    reg = SimpleNamespace(_seen={}, makers=spark.range(3).withColumnRenamed("id", "manufacturer_id").join(spark.range(3).withColumnRenamed("id", "other"), F.expr("other = manufacturer_id")))
    makers = catalog.kept(reg, "makers")
    assert catalog.kept(reg, "makers") is makers and "Join" in plan(reg.makers) and "Join" not in plan(makers)
    assert sorted(r["manufacturer_id"] for r in makers.collect()) == [0, 1, 2]


def test_snapshots_are_shown_once_for_each_list(spark):
    makers = spark.createDataFrame([(k, f"Works {k}") for k in range(3)], "manufacturer_id int, manufacturer_name string")
    goods = spark.createDataFrame([(7, "q", 1, None)], "product_id int, product_name string, manufacturer_id int, manufacturer_product_code string")
    confirmed = {c: F.lit(True) for c in ("link_confirmed", "null_code_confirmed", "manufacturer_confirmed", "product_confirmed", "pdf_confirmed", "manual_confirmed", "safety_confirmed", "is_pdf")}
    texts = {"manufacturer_action": "CREATE", "product_action": "CREATE", "product_name": "p", "approved_by": "me", "original_filename": "a.pdf", "pdf_sha256": "x", "source_filename": "a.pdf", "source_sha256": "x"}
    nulls = {c: F.lit(None).cast("string") for c in ("seen_name", "product_code", "use_description", "use_restriction")} | {c: F.lit(None).cast("int") for c in ("manufacturer_id", "product_id")}
    rows = spark.createDataFrame([(1, "Works"), (2, "Nobody"), (3, " ")], "decision_id int, manufacturer_name string")
    decisions = rows.withColumns({"evidence_id": F.col("decision_id"), "has_safety": F.lit(False)} | confirmed | nulls | {c: F.lit(v) for c, v in texts.items()})
    plans = decisions.select("evidence_id", "product_name", "product_code", F.col("manufacturer_name").alias("canonical"), F.lit("HUMAN_REVIEW").alias("manufacturer_status"), F.lit("").alias("blockers"))
    shown = lambda c, beside: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["id"], x[beside])), "; ")
    lists = approvals.approvals(decisions, plans, makers, goods, shown)
    got = {r["decision_id"]: (r["verdict"], r["makers"], r["goods"]) for r in lists.collect()}
    assert got == {1: ("APPROVED", "0=Works 0; 1=Works 1; 2=Works 2", ""), 2: ("APPROVED", "", ""), 3: ("MANUFACTURER_REQUIRES_HUMAN_REVIEW", None, None)}
    # above the join of decisions and lists nothing walks a list of makers
    above, below = plan(lists.select("makers")).split("Join", 1)
    assert "transform(makers" not in above and "lambdafunction(concat_ws" in below
