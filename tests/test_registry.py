"""Registry operators on small tables, with the numbers of the survey's fixtures."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chemledger.functions import text
from chemledger.operators import audits, batch, dashboard, extraction, facts, history, identity, paths, registry_reads, reviews, supervisory, transitions
from chemledger.plans.ordered import lead_values, row_numbers

T0 = dt.datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def reg(spark):
    """Six products: none, approved (an archived document too), rejected, undecided, archived only, and one of another manufacturer."""
    make = spark.createDataFrame
    products = [("none", "No SDS", "a", "ACTIVE"), ("ok", "Approved", "a", "ACTIVE"), ("no", "Rejected", "a", "REJECTED"), ("open", "No decision", "a", "PENDING_APPROVAL"), ("old", "Archived only", "a", "INACTIVE"), ("other", "Other", "b", "ACTIVE")]
    docs = [("a-ok", "ok", "ARCHIVED"), ("b-ok", "ok", "CURRENT"), ("s-no", "no", "CURRENT"), ("s-open", "open", "CURRENT"), ("s-other", "other", "CURRENT"), ("s-old", "old", "ARCHIVED")]
    decisions = [("d1", "ok", "a-ok", "REJECTED", "CURRENT"), ("d2", "ok", "b-ok", "REJECTED", "SUPERSEDED"), ("d3", "ok", "b-ok", "APPROVED", "CURRENT"), ("d4", "no", "s-no", "REJECTED", "CURRENT"), ("d5", "old", "s-old", "APPROVED", "CURRENT")]
    listing = [("sds", f"{s}.pdf", 1) for s, _, _ in docs if s != "s-no"] + [("evidence", f"{d[0]}.pdf", 1) for d in decisions if d[0] != "d3"] + [("evidence", "s-no.pdf", 1)]
    return SimpleNamespace(
        manufacturers=make([("a", "A"), ("b", "B")], "manufacturer_id string, manufacturer_name string"),
        products=make([(i, n, None, m, u, None, None, None, None) for i, n, m, u in products], "product_id string, product_name string, manufacturer_product_code string, manufacturer_id string, usage_status string, use_description string, use_restriction string, waste_type string, waste_code string"),
        sds_documents=make([(s, p, f"{s}.pdf", f"{s}.pdf", dt.date(2023, 1, 1), "1", st, T0, "AVAILABLE") for s, p, st in docs], "sds_id string, product_id string, original_filename string, relative_path string, issue_date date, revision string, document_status string, registered_at timestamp_ntz, file_status string"),
        bhp_decisions=make([(d, p, s, st, None, T0, r, d) for d, p, s, st, r in decisions], "decision_id string, product_id string, sds_id string, decision_status string, notes string, registered_at timestamp_ntz, record_status string, evidence_id string"),
        decision_evidence=make([(d[0], None, f"{d[0]}.pdf", "DOCUMENT", "PDF", "AVAILABLE") for d in decisions], "evidence_id string, original_filename string, relative_path string, evidence_type string, file_format string, file_status string"),
        usage_locations=make([("l1", "L-1", "one", "ACTIVE"), ("l2", None, "two", "ACTIVE"), ("l3", "L-3", "three", "INACTIVE")], "location_id string, location_code string, location_name string, status string"),
        unit_of_measure=make([("u1", "l", "litre", "VOLUME", "ACTIVE"), ("u2", "kg", "kilogram", "MASS", "INACTIVE")], "unit_id string, code string, name string, category string, status string"),
        product_usage_locations=make([("ok", "l1", 0, "u1", 0, "u1"), ("ok", "l2", 2, "u1", None, None), ("no", "l1", 3, "u1", None, None), ("open", "l3", 4, "u2", None, None)], "product_id string, location_id string, peak_quantity_value int, peak_quantity_unit_id string, monthly_consumption_value int, monthly_consumption_unit_id string")
        .withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("peak_quantity_value", "monthly_consumption_value")}),
        file_listing=make(listing, "root string, relative_path string, length long"),
        sds_invalidation=make([], "invalidation_id string, product_id string, invalidated_sds_id string, invalidated_from_status string, restored_sds_id string, reason string, invalidated_at timestamp_ntz"),
        safety_profiles=make([("b-ok",)], "sds_id string"),
        physical_reviews=make([("r1", dt.date(2024, 1, 1), "FINAL", T0, T0), ("r2", dt.date(2024, 2, 1), "FINAL", T0, T0)], "review_id string, review_date date, status string, created_at timestamp_ntz, finalized_at timestamp_ntz"),
        physical_review_items=make([("i1", "r1", "ok", "l1", 5, "u1", 4), ("i2", "r2", "ok", "l1", 5, "u1", None)], "review_item_id string, review_id string, product_id string, location_id string, baseline_max_quantity int, baseline_unit_id string, observed_quantity int")
        .withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("baseline_max_quantity", "observed_quantity")}))


A_ONLY = facts.Filters(dt.date(2024, 1, 1), dt.date(2024, 12, 31), manufacturer_id="a")


def test_dashboard_numbers(reg):
    rows = facts.dashboard_facts(reg, A_ONLY)
    assert dashboard.kpi_row(reg, rows, A_ONLY).first().asDict() == {"products_total": 5, "current_sds_count": 3, "bhp_approved_count": 1, "attention_products_count": 5, "active_locations_count": 2}
    reasons = {r["reason"]: r["affected_products"] for r in dashboard.attention_by_reason(rows).collect()}
    assert reasons == {"NO_CURRENT_SDS": 2, "NO_BHP_DECISION": 1, "NO_ACTIVE_LOCATION": 2, "MISSING_SOURCE_FILE": 2}
    trend = dashboard.sds_trend(reg.sds_documents, rows.select("product_id"), A_ONLY).collect()
    assert [(r["new_sds_count"], r["updated_sds_count"]) for r in trend] == [(4, 1)]
    earlier = facts.Filters(dt.date(2020, 1, 1), dt.date(2020, 12, 31), manufacturer_id="a")
    assert dashboard.sds_trend(reg.sds_documents, rows.select("product_id"), earlier).count() == 0


def test_filters_are_validated():
    with pytest.raises(ValueError):
        facts.Filters(dt.date(2024, 2, 1), dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        facts.Filters(dt.date(2024, 1, 1), dt.date(2024, 2, 1), bhp_status=facts.NOT_APPLICABLE)


def test_documents_and_evidence_have_roots_of_their_own(reg):
    states = {r["product_id"]: r for r in facts.dashboard_facts(reg).collect()}
    assert states["no"]["current_sds_availability"] == "MISSING"  # listed as evidence only
    assert states["ok"]["current_evidence_availability"] == "MISSING"
    absent = facts.with_file_states(facts.product_facts(reg), reg.file_listing, sds_root=False)
    assert {r["current_sds_availability"] for r in absent.where("current_sds_id is not null").collect()} == {"CHECK_FAILED"}
    rows = {r["product_id"]: r for r in supervisory.supervisory_rows(reg).dropDuplicates(["product_id"]).collect()}
    assert not rows["no"]["current_sds_file_available"] and rows["ok"]["current_sds_file_available"]


def test_paths(spark):
    cases = [("a/b.pdf", True, False), ("a/../b.pdf", True, True), ("../b.pdf", False, True), ("/b.pdf", False, True), ("C:\\b.pdf", True, True), ("", False, True), (None, False, True), ("a\0b.pdf", True, True), ("a/b.txt", True, True)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "product_id long, p string")
    listing = spark.createDataFrame([("b.pdf", 1), ("a/b.pdf", 1), ("C:\\b.pdf", 1), ("a\0b.pdf", 1), ("a/b.txt", 1)], "relative_path string, length long")
    present = {r["product_id"]: r["there"] for r in paths.with_file_present(df, listing, "p", "there").collect()}
    refused = {r["product_id"]: r["bad"] for r in df.select("product_id", paths.evidence_path_rejected(F.col("p")).alias("bad")).collect()}
    for k, (_, there, bad) in enumerate(cases):
        assert (present[k], refused[k]) == (there, bad), cases[k]


def test_ambiguity_is_reported_and_refused(reg):
    twice = reg.sds_documents.unionByName(reg.sds_documents.where("sds_id = 's-no'").withColumn("sds_id", F.lit("s-no2")))
    bad = SimpleNamespace(**{**vars(reg), "sds_documents": twice})
    assert [r["product_id"] for r in supervisory.ambiguous_products(bad).collect()] == ["no"]
    assert facts.require_single_facts(facts.product_facts(reg)).count() == 6
    for strict in (facts.require_single_facts(facts.product_facts(bad)), supervisory.require_unambiguous(supervisory.supervisory_rows(bad), bad)):
        with pytest.raises(Exception, match="more than one"):
            strict.collect()


def test_latest_review_is_ranked_before_it_is_read(reg):
    row = reviews.latest_final_items(reg).first()
    assert (row["review_id"], row["observed_quantity"], row["difference"]) == ("r2", None, None)


@pytest.mark.parametrize(("change", "wanted"), [
    ({}, []), ({"usage_status": "PENDING_APPROVAL"}, ["BRAK DECYZJI BHP"]), ({"usage_status": "REJECTED"}, ["PRODUKT ODRZUCONY"]), ({"current_sds_id": None}, ["BRAK CURRENT SDS"]),
    ({"current_sds_file_available": False}, ["BRAK PLIKU SDS"]), ({"usage_location_name": None}, ["BRAK MIEJSCA STOSOWANIA"]), ({"current_bhp_evidence_available": False}, ["BRAK PLIKU DOWODU BHP"]),
    ({"usage_status": "PENDING_APPROVAL", "current_sds_id": None, "usage_location_name": None, "current_sds_file_available": False}, ["BRAK DECYZJI BHP", "BRAK CURRENT SDS", "BRAK MIEJSCA STOSOWANIA"]),
])
def test_action_reasons(spark, change, wanted):
    row = {"usage_status": "ACTIVE", "current_sds_id": "s", "current_sds_file_available": True, "usage_location_name": "x", "current_bhp_decision_id": "d", "current_bhp_evidence_available": True} | change
    df = spark.createDataFrame([tuple(row.values())], "usage_status string, current_sds_id string, current_sds_file_available boolean, usage_location_name string, current_bhp_decision_id string, current_bhp_evidence_available boolean")
    assert df.select(supervisory.action_reasons().alias("r")).first()["r"] == wanted


def test_quantities(spark, reg):
    rows = spark.createDataFrame([("p", "1.5", "u1"), ("p", "2", "u1"), ("q", "1", "u1"), ("q", "1", "u2")], "product_id string, v string, peak_quantity_unit_id string").withColumn("peak_quantity_value", F.col("v").cast("decimal(18,6)"))
    got = {r["product_id"]: (r["peak_total"] and float(r["peak_total"]), r["total_status"]) for r in registry_reads.quantity_totals(rows).collect()}
    assert got == {"p": (3.5, "OK"), "q": (None, "MIXED_UNITS")}
    with pytest.raises(Exception, match="different units"):
        registry_reads.quantity_totals(rows, strict=True).collect()


def test_ordered_groups_over_many_buckets(spark):
    """Nulls stay null, one key spans many months, and nothing runs before the result is asked for."""
    rows = [("k" if i % 7 else "m", i, dt.datetime(2020 + i // 30, 1 + i % 12, 1 + i % 28), None if i % 4 == 0 else i) for i in range(200)] + [("k", 999, None, 5)]
    df = spark.createDataFrame(rows, "key string, id int, at timestamp_ntz, value int")
    order = {key: sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or T0, r[1])) for key in "km"}
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    numbered, led = row_numbers(df, ["key"], "at", ["id"], "n"), lead_values(df, ["key"], "at", ["id"], "value", "next")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    n, nxt = {r["id"]: r["n"] for r in numbered.collect()}, {r["id"]: r["next"] for r in led.collect()}
    for group in order.values():
        for k, r in enumerate(group):
            assert n[r[1]] == k + 1
            assert nxt[r[1]] == (group[k + 1][3] if k + 1 < len(group) else None)


def test_history(spark):
    rows = spark.createDataFrame([("h1", "p", "ACTIVE", T0), ("h2", "p", "REJECTED", T0), ("h3", "p", "ACTIVE", dt.datetime(2024, 3, 1))], "history_id string, product_id string, usage_status string, changed_at timestamp_ntz")
    got = {r["history_id"]: (r["valid_to"], r["is_latest"]) for r in history.validity_intervals(rows, ["product_id"]).collect()}
    assert got == {"h1": (T0, False), "h2": (dt.datetime(2024, 3, 1), False), "h3": (None, True)}
    assert history.latest_states(rows, ["product_id"]).first()["history_id"] == "h3"


def test_invalidation(spark, reg):
    ask = lambda *r: spark.createDataFrame([(*r, dt.datetime(2024, 6, 1))], "request_id string, product_id string, sds_id string, expected_status string, expected_current_sds_id string, mode string, restored_sds_id string, reason_text string, at timestamp_ntz")
    run = lambda r: transitions.invalidate(reg.products, reg.sds_documents, reg.bhp_decisions, reg.sds_invalidation, r)
    out = run(ask("q", "ok", "b-ok", "CURRENT", "b-ok", "RESTORE_ARCHIVED", "a-ok", " wrong "))
    status = {r["sds_id"]: r["document_status"] for r in out.tables["sds_documents"].collect()}
    assert (status["b-ok"], status["a-ok"], out.rejected.count()) == ("INVALIDATED", "CURRENT", 0)
    assert {r["decision_id"]: r["record_status"] for r in out.tables["bhp_decisions"].where("product_id = 'ok'").collect()} == {"d1": "SUPERSEDED", "d2": "SUPERSEDED", "d3": "SUPERSEDED"}
    assert out.tables["products"].where("product_id = 'ok'").first()["usage_status"] == "PENDING_APPROVAL" and out.history.count() == 1
    assert out.tables["sds_invalidation"].first()["reason"] == "wrong"
    assert run(ask("q", "open", "s-open", "CURRENT", "s-open", "NO_CURRENT", None, "x")).history.count() == 0  # it waited already
    for request, reason in ((("q", "ok", "b-ok", "CURRENT", None, "NO_CURRENT", None, "x"), "STALE_CURRENT"), (("q", "ok", "s-no", "CURRENT", "b-ok", "NO_CURRENT", None, "x"), "STALE_DOCUMENT"), (("q", "ok", "a-ok", "ARCHIVED", "b-ok", "NO_CURRENT", None, "x"), "MODE_DOES_NOT_FIT"),
                            (("q", "ok", "b-ok", "CURRENT", "b-ok", "RESTORE_ARCHIVED", "s-old", "x"), "STALE_RESTORED"), (("q", "ok", "b-ok", "CURRENT", "b-ok", "NO_CURRENT", None, " "), "REASON_REQUIRED"), (("q", "zz", "b-ok", "CURRENT", "b-ok", "NO_CURRENT", None, "x"), "STALE_PRODUCT")):
        assert [r["reason"] for r in run(ask(*request)).rejected.collect()] == [reason]


def test_review_lifecycle(reg):
    day, at = F.to_date(F.lit("2024-05-01")), F.lit(T0).cast("timestamp_ntz")
    out = transitions.create_review(reg.physical_reviews, reg.physical_review_items, reviews.review_population(reg), "r3", day, at)
    assert out.tables["physical_review_items"].where("review_id = 'r3'").count() == 3 and out.rejected.count() == 0
    again = transitions.create_review(out.tables["physical_reviews"], out.tables["physical_review_items"], reviews.review_population(reg), "r4", day, at)
    assert [r["reason"] for r in again.rejected.collect()] == ["DRAFT_EXISTS"] and again.tables["physical_reviews"].count() == 3
    none = transitions.create_review(reg.physical_reviews, reg.physical_review_items, reviews.review_population(reg).limit(0), "r4", day, at)
    assert [r["reason"] for r in none.rejected.collect()] == ["EMPTY_POPULATION"]
    final = transitions.finalize_review(out.tables["physical_reviews"], "r3", at)
    assert final.where("status = 'DRAFT'").count() == 0
    kept, items = transitions.discard_draft(out.tables["physical_reviews"], out.tables["physical_review_items"], "r3")
    assert kept.count() == 2 and items.count() == 2


def test_batch_of_six(spark):
    """Existing, new, new, newer revision, unclear identity, duplicate."""
    sha = lambda c: c * 64
    rows = [("1", sha("a"), "Known", "K", dt.date(2020, 1, 1), "1"), ("2", sha("b"), "Fresh", None, dt.date(2021, 1, 1), "1"), ("3", sha("c"), "Other fresh", "X", dt.date(2021, 1, 1), "1"),
            ("4", sha("d"), "Known", "K", dt.date(2022, 1, 1), "2"), ("5", sha("e"), "Known", "Z", dt.date(2022, 1, 1), "2"), ("6", sha("b"), "Fresh", None, dt.date(2021, 1, 1), "1")]
    items = spark.createDataFrame([(k, m, "COMPLETE", 1, f"{m}_DOC-001.json", f"{m}.pdf", h, h, f"{m}.pdf", h, n, c, d, r, "Maker") for k, (m, h, n, c, d, r) in enumerate(rows)],
                                  "position int, manifest_id string, status string, logical_sds_count int, json_file string, source_file string, sha256_expected string, sha256 string, json_name string, json_sha256 string, product_name string, product_code string, issue_date date, revision string, manufacturer string")
    products = spark.createDataFrame([("p", "Known", "K", "m")], "product_id string, product_name string, manufacturer_product_code string, manufacturer_id string")
    documents = spark.createDataFrame([("p", "CURRENT", dt.date(2020, 1, 1), "1", sha("a"))], "product_id string, document_status string, issue_date date, revision string, sha256 string")
    got = {r["manifest_id"]: r["classification"] for r in batch.classify(items, products, documents, "Maker", "m").collect()}
    assert [got[k] for k in "123456"] == ["SKIP_EXACT_EXISTING", "READY_CREATE", "READY_CREATE", "READY_ADD_REVISION", "REVIEW_IDENTITY", "SKIP_DUPLICATE_SOURCE"]
    other = items.withColumn("revision", F.when(F.col("manifest_id") == "6", "9").otherwise(F.col("revision")))
    reasons = {r["manifest_id"]: r["reason"] for r in batch.classify(other, products, documents, "Maker", "m").collect()}
    assert reasons["2"] == "CONTRADICTORY_DUPLICATE_SOURCE:6" and reasons["6"] == "CONTRADICTORY_DUPLICATE_SOURCE"
    twice = items.withColumn("manifest_id", F.when(F.col("manifest_id") == "6", "5").otherwise(F.col("manifest_id")))
    assert {r["reason"] for r in batch.classify(twice, products, documents, "Maker", "m").collect()} == {"DUPLICATE_MANIFEST_ID"}


@pytest.mark.parametrize(("count", "status"), [(0, "CREATE_CANDIDATE"), (1, "LINK_CANDIDATE"), (2, "HUMAN_REVIEW")])
def test_cardinality(spark, count, status):
    assert spark.range(1).select(identity.cardinality(F.lit(count)).alias("s")).first()["s"] == status


def test_similar_manufacturers_against_brute_force(spark):
    names = ["Acme Ltd", "ACME Polska", "The acme", "Ac", "Zinc Co", "Zi", "50% Off", "x50%"]
    makers = spark.createDataFrame(list(enumerate(names)), "manufacturer_id int, manufacturer_name string")
    asked = ["Acme Ltd", "Zi", "Ac x", "50% y", "nothing", " lead"]
    got = {(r["name"], r["manufacturer_name"]) for r in identity.similar_manufacturers(spark.createDataFrame([(a,) for a in asked], "name string"), makers).collect()}
    assert got == {(a, m) for a in asked for m in names if m != a and a.split(" ", 1)[0].lower() in m.lower()}


def test_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("d")).first()["d"]
    day = dt.date(2021, 5, 7)
    assert one(text.month_name_date(F.lit("7 maja 2021"))) == day and one(text.month_name_date(F.lit("7 PAŹDZIERNIKA 2021"))) == dt.date(2021, 10, 7)
    assert one(text.month_name_date(F.lit("31 lutego 2021"))) is None and one(text.dotted_date(F.lit("31.02.2023"))) is None
    assert one(text.ambiguous_slash_date(F.lit("7/5/2021"), F.lit(None).cast("string"))) == day
    assert one(text.ambiguous_slash_date(F.lit("5/7/2021"), F.lit("1/31/2020"))) == day
    assert one(text.ambiguous_slash_date(F.lit("5/17/2021"), F.lit(None).cast("string"))) == dt.date(2021, 5, 17)
    assert one(text.version_token(F.lit("01.0/PL"))) == "01.0/PL" and one(text.version_token(F.lit("v1"))) is None
    assert one(text.hazard_codes(F.lit("H225 H300 H225 H360F H412"))) == ["H225", "H300", "H412"]
    assert one(text.location_code(F.lit(" ab-1 "))) == "AB-1" and one(text.location_code(F.lit("-x"))) is None


def test_state_lattices_differ(spark):
    """Over pages an unreadable result beats a found one; over alternatives it does not."""
    rows = [("p", 1, "FOUND", "x", "A"), ("p", 2, "UNREADABLE", None, "A"), ("q", 1, "FOUND", "x", "A"), ("q", 2, "FOUND", "y", "A"), ("r", 1, "FOUND", "x", "A"), ("r", 2, "AMBIGUOUS", None, "A")]
    df = spark.createDataFrame(rows, "k string, n int, state string, value string, alias_id string")
    pages = {r["k"]: (r["state"], r["value"]) for r in extraction._combined(df, ["k"], "n", found_first=False).collect()}
    ways = {r["k"]: (r["state"], r["value"]) for r in extraction._combined(df, ["k"], "n", found_first=True).collect()}
    assert pages == {"p": ("UNREADABLE", None), "q": ("AMBIGUOUS", None), "r": ("AMBIGUOUS", None)}
    assert ways == {"p": ("FOUND", "x"), "q": ("AMBIGUOUS", None), "r": ("AMBIGUOUS", None)}


def test_extraction_of_a_two_page_sheet(spark):
    pages = [(1, 1, "Aktualizacja: 2021/05/07\nSEKCJA 11: X\n1.1 no\nSEKCJA 1: Y\n1.1 Id\nNAZWA  WYROBU : Klej\n1.2 Use\n1.3 Firm\nMfg. in U.S.A and exported by:\n ACME Inc.\nSEKCJA 2: Z\nNazwa wyrobu: not this"), (1, 2, "SECTION 1: again\nno subsection\nWersja: 2.0")]
    got = {(r["document_key"], r["field"]): (r["state"], r["value"]) for r in extraction.field_states(spark.createDataFrame(pages, "source_id int, page_no int, text string"), extraction.rule_table(spark)).collect()}
    assert {k[0] for k in got} == {"DOC-001"}
    assert got["DOC-001", "product_name"] == ("FOUND", "Klej") and got["DOC-001", "issue_date"] == ("FOUND", "2021-05-07")
    assert got["DOC-001", "MANUFACTURER_EXPORTER"] == ("FOUND", "ACME Inc.") and got["DOC-001", "revision"] == ("FOUND", "2.0")


def test_audits(reg):
    tables = {"products": reg.products, "sds_documents": reg.sds_documents.unionByName(reg.sds_documents.where("sds_id = 'b-ok'")), "usage_locations": reg.usage_locations.withColumn("location_code", F.lit("bad code"))}
    got = {(r["table_name"], r["rule"]): r["violations"] for r in audits.key_violations(tables).unionByName(audits.reference_violations(tables)).unionByName(audits.row_violations(tables)).collect()}
    assert got["sds_documents", "primary key sds_id"] == 2 and got["sds_documents", "unique product_id"] == 2
    assert got["sds_documents", "product_id -> products"] == 0 and got["usage_locations", "check location_code_format"] == 3


def test_plans_have_no_python_and_no_nested_loops(reg):
    for df in (facts.dashboard_facts(reg), supervisory.supervisory_rows(reg), reviews.latest_final_items(reg), identity.similar_manufacturers(reg.manufacturers.select(F.col("manufacturer_name").alias("name")), reg.manufacturers)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Join Cross" not in plan
