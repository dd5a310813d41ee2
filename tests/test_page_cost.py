"""What reading pages costs: values are worked out once, and only where a page can hold them."""

from pyspark.sql import functions as F

from chemledger.operators import extraction, gates, layouts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headings_alone_do_not_call_for_the_card_header():
    assert not any(w in "sekcja 1: identyfikacja" for w in layouts.NEEDED[layouts.card_header])


def test_quotes_and_suffixes_are_read_once(spark):
    """A plain explode infers a filter that reads every quote, or every page, once more."""
    pages = spark.createDataFrame([(1, 1, "karta charakterystyki\nKC Numer: 7\nV1.2\nSEKCJA 1: I\n1.1 Identyfikator\nNazwa produktu: P   -7\n P-7"), (2, 1, None)], "source_id int, page_no int, text string")
    read = layouts.read_pages(pages)
    fields = layouts.document_fields(read)
    rows = {(r["source_id"], r["field"]): (r["state"], r["value"]) for r in fields.collect()}
    assert rows[1, "product_name"] == ("FOUND", "P-7") and rows[1, "revision"] == ("FOUND", "V1.2") and rows[2, "revision"] == ("NOT_FOUND", None)
    every = fields.select("source_id", "document_key", "page_from", "page_to", "field", "ordinal", "role", "state", "value", "proofs").localCheckpoint()
    kept = layouts.Read(read.parts.localCheckpoint(), read.documents, read.results.localCheckpoint())
    issues = gates.proof_issues(every.withColumn("value", F.when(F.col("state") == "FOUND", "other")), kept)
    assert sorted((r["field"], r["issue"]) for r in issues.collect()) == [("product_name", "VALUE_NOT_SUPPORTED"), ("revision", "CARD_REVISION_EVIDENCE_MISMATCH")]
    assert plan(issues).count("PAGE_OUTSIDE_SDS") == 1
    shown = plan(layouts.compacted(every.withColumn("document_no", F.lit(1)), kept.parts, kept.documents))
    assert shown.count("-[A-Za-z0-9]") - shown.count("(?=-[A-Za-z0-9]") == 2  # before and after lines are trimmed


def test_a_value_is_worked_out_once(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, [])], "id int, x array<string>").withColumn("y", layouts.let(F.col("x"), lambda x: F.concat_ws("-", x, F.size(x).cast("string"))))
    assert [r["y"] for r in rows.sort("id").collect()] == ["a-2", "0"]


def test_patterns_of_the_catalogue_are_literals_and_others_are_read(spark):
    """A pattern that is a column is compiled for each row."""
    pages = spark.createDataFrame([(1, 1, "SEKCJA 1: I\n1.1 I\nNazwa produktu: a\nSynonim: b")], "source_id int, page_no int, text string")
    rules = extraction.rule_table(spark)
    other = rules.where("alias_id = 'A-001'").withColumns({"alias_id": F.lit("X-1"), "label": F.lit("Synonim"), "pattern": F.lit(r"(?iU)(?<!\w)\QSynonim\E\s*:\s*(.*)")})
    hits = extraction.rule_hits(extraction.context_lines(extraction.labelled_lines(pages)), rules.unionByName(other))
    assert sorted((r["alias_id"], r["value"]) for r in hits.collect()) == [("A-001", "a"), ("X-1", "b")]
    assert all(extraction.pattern_of(r) in plan(hits) for r in extraction.RULES if r.contexts == ("1.1",))
