"""Classification of a batch of manifest items against the registry, all items in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemledger.functions.text import plain_file_name
from chemledger.operators.identity import candidate_products

CLASSES = ("READY_CREATE", "READY_ADD_REVISION", "SKIP_EXACT_EXISTING", "SKIP_DUPLICATE_SOURCE", "REVIEW_IDENTITY", "BLOCKED_SOURCE", "BLOCKED_DATA", "EXCLUDED_NON_SDS")
IDENTITY = ("product_name", "product_code", "issue_date", "revision", "manufacturer")


def first_wins(items: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The first item of each content hash holds it. Later ones of the same identity are its duplicates; of another identity, both are contradictory, and the
    holder names the last of them.

    ``items``: position, manifest_id, sha256, eligible, and the identity columns. Items that are not eligible hold nothing. Adds ``holder`` (null where not
    eligible) and ``duplicate``: null, DUPLICATE, CONTRADICTORY or CONTRADICTED, with ``against``. Two aggregates by hash and their joins, in place of a window,
    so a hash that many items share is combined before it moves.
    """
    own = F.struct(*[F.col(c) for c in identity])
    eligible = items.where("eligible")
    first = eligible.groupBy("sha256").agg(F.min_by(F.struct("position", F.col("manifest_id").alias("id"), own.alias("identity")), "position").alias("first"))
    rows = items.join(first, "sha256", "left").withColumn("first", F.when(F.col("eligible"), F.col("first")))
    later = F.col("position") > F.col("first.position")
    differs = later & ~own.eqNullSafe(F.col("first.identity"))
    last = rows.where(differs).groupBy("sha256").agg(F.max_by("manifest_id", "position").alias("last"))
    rows = rows.join(last, "sha256", "left")
    kind = F.when(differs, "CONTRADICTORY").when(later, "DUPLICATE").when(F.col("eligible") & F.col("last").isNotNull(), "CONTRADICTED")
    against = F.when(kind == "CONTRADICTED", F.col("last")).when(kind == "DUPLICATE", F.col("first.id"))
    return rows.withColumns({"duplicate": kind, "against": against, "holder": F.col("first.id")}).drop("first", "last")


def entry_problem() -> F.Column:
    """What is wrong with a manifest entry and its files, first failing test first."""
    bad = ((F.col("logical_sds_count") != 1) | ~F.col("status").isin("COMPLETE", "NEEDS_REVIEW") | ~plain_file_name(F.col("json_file"))
           | (F.col("json_file") != F.concat(F.col("manifest_id").cast("string"), F.lit("_DOC-001.json"))) | ~plain_file_name(F.col("source_file")) | (F.length("sha256_expected") != 64))
    return (F.when(F.coalesce(bad, F.lit(True)), "BLOCKED_DATA/INVALID_MANIFEST_ENTRY")
            .when(F.col("json_name").isNull(), "BLOCKED_SOURCE/JSON_UNAVAILABLE")
            .when(~F.col("json_name").eqNullSafe(F.col("source_file")) | ~F.col("json_sha256").eqNullSafe(F.col("sha256_expected")), "BLOCKED_SOURCE/MANIFEST_JSON_SOURCE_MISMATCH")
            .when(F.col("sha256").isNull() | (F.col("sha256") != F.col("sha256_expected")), "BLOCKED_SOURCE/PDF_SHA_MISMATCH")
            .when(F.coalesce((F.col("product_name") == "") | F.col("product_name").isNull() | F.col("issue_date").isNull() | F.col("revision").isNull(), F.lit(True)), "BLOCKED_DATA/STAGE1_HEADER_INVALID_OR_UNPROVEN"))


def classify(items: DataFrame, products: DataFrame, documents: DataFrame, manufacturer: str, selected_id: object) -> DataFrame:
    """``manifest_id``, ``classification`` and ``reason`` of every item; the first rule that applies wins.

    ``items``: position, manifest_id, status, logical_sds_count, json_file, source_file, sha256_expected, sha256 (of the file, null if absent), json_name and
    json_sha256 (what the evidence says of its source, null if there is none), and the identity columns. ``products``: product_id, product_name,
    manufacturer_product_code, manufacturer_id. ``documents``: product_id, document_status, issue_date, revision, sha256.
    """
    rows = items.withColumn("problem", entry_problem())
    rows = first_wins(rows.withColumn("eligible", F.col("problem").isNull()))
    mine = rows.where("eligible and duplicate is null").where(F.col("manufacturer") == manufacturer)
    wanted = mine.select(F.col("product_name").alias("name"), F.lit(selected_id).alias("selected_id")).distinct()
    candidates = candidate_products(wanted, products).groupBy(F.col("name").alias("product_name")).agg(F.count(F.lit(1)).alias("candidates"))
    exact = (products.where(F.col("manufacturer_id") == F.lit(selected_id)).groupBy("product_name", F.col("manufacturer_product_code").alias("code"))
             .agg(F.count(F.lit(1)).alias("exact"), F.min("product_id").alias("product_id")).withColumnRenamed("product_name", "exact_name"))
    rows = rows.join(candidates, "product_name", "left").join(exact, (F.col("product_name") == F.col("exact_name")) & F.col("product_code").eqNullSafe(F.col("code")), "left").drop("exact_name", "code")
    current = documents.groupBy("product_id").agg(F.count_if(F.col("document_status") == "CURRENT").alias("current"), F.max(F.when(F.col("document_status") == "CURRENT", F.col("issue_date"))).alias("current_date"))
    same = documents.groupBy("product_id", F.col("issue_date").alias("s_date"), F.col("revision").alias("s_revision")).agg(F.min("sha256").alias("sha_low"), F.max("sha256").alias("sha_high"))
    rows = rows.join(current, "product_id", "left").join(same.withColumnRenamed("product_id", "s_product"), (F.col("product_id") == F.col("s_product")) & (F.col("issue_date") == F.col("s_date")) & F.col("revision").eqNullSafe(F.col("s_revision")), "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    verdict = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("duplicate") == "DUPLICATE", F.concat(F.lit("SKIP_DUPLICATE_SOURCE/DUPLICATE_OF:"), F.col("against").cast("string")))
        .when(F.col("duplicate") == "CONTRADICTORY", "BLOCKED_DATA/CONTRADICTORY_DUPLICATE_SOURCE")
        .when(F.col("duplicate") == "CONTRADICTED", F.concat(F.lit("BLOCKED_DATA/CONTRADICTORY_DUPLICATE_SOURCE:"), F.col("against").cast("string")))
        .when(~F.col("manufacturer").eqNullSafe(F.lit(manufacturer)), "REVIEW_IDENTITY/MANUFACTURER_CANONICAL_NOT_APPROVED")
        .when(none("exact") > 1, "REVIEW_IDENTITY/MULTIPLE_EXACT_PRODUCTS")
        .when((none("exact") == 0) & (none("candidates") > 0), "REVIEW_IDENTITY/SIMILAR_OR_CODE_CONFLICT_PRODUCT")
        .when(none("exact") == 0, "READY_CREATE/EXACT_PRODUCT_ABSENT")
        .when(none("current") > 1, "BLOCKED_DATA/MULTIPLE_CURRENT_SDS")
        .when((F.col("sha_low") != F.col("sha256")) | (F.col("sha_high") != F.col("sha256")), "BLOCKED_DATA/SDS_METADATA_SOURCE_CONFLICT")
        .when(F.col("sha_low").isNotNull(), "SKIP_EXACT_EXISTING/EXACT_PRODUCT_SDS_PDF")
        .when(none("current") == 0, "REVIEW_IDENTITY/NO_CURRENT_SDS_FOR_EXISTING_PRODUCT")
        .when(F.col("current_date").isNull() | (F.col("issue_date") <= F.col("current_date")), "REVIEW_IDENTITY/REVISION_NOT_NEWER")
        .otherwise("READY_ADD_REVISION/NEWER_ISSUE_DATE"))
    # a repeated manifest id anywhere blocks the whole batch; one row, so it may be joined to all
    repeated = items.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max(F.col("n") > 1), F.lit(False)).alias("repeated"))
    out = rows.withColumn("verdict", verdict).crossJoin(F.broadcast(repeated)).withColumn("verdict", F.when(F.col("repeated"), "BLOCKED_DATA/DUPLICATE_MANIFEST_ID").otherwise(F.col("verdict")))
    at = F.instr("verdict", "/")
    return out.select("manifest_id", F.substring("verdict", F.lit(1), at - 1).alias("classification"), F.substring("verdict", at + 1, F.length("verdict")).alias("reason"))


def class_counts(classified: DataFrame) -> DataFrame:
    """Every class with its number of items, zero where there are none."""
    counts = classified.groupBy("classification").agg(F.count(F.lit(1)).alias("items"))
    every = classified.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    return every.join(counts, "classification", "left").select("classification", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


def batch_gate(classified: DataFrame) -> DataFrame:
    """One row: whether the batch may be written at all. A single blocked item stops every write."""
    blocked = F.col("classification").startswith("BLOCKED")
    ready = F.col("classification").isin("READY_CREATE", "READY_ADD_REVISION")
    return classified.agg(F.count_if(blocked).alias("blocked"), F.count_if(ready).alias("ready"), F.when(F.count_if(blocked) > 0, "STOPPED").otherwise("OPEN").alias("gate"))


def source_binding(sources: DataFrame, manifest: DataFrame, stored: DataFrame, fallback: DataFrame) -> DataFrame:
    """``json_file`` and the outcome of finding the PDF that an evidence file speaks of.

    INVALID_SOURCE: no plain PDF name or no hash. PDF_MISMATCH: several manifest entries, another name or hash than the manifest's, or a file that is no PDF of that hash.
    AUTO_BOUND: the stored file fits. MANUAL_BOUND: none is stored, and the file given by hand fits. FALLBACK_REQUIRED: none of these.

    ``sources``: json_file, file_name, sha256. ``manifest``: json_file, source_file, sha256. ``stored``: file_name, sha256, is_pdf. ``fallback``: json_file, file_name, sha256, is_pdf.
    """
    entries = manifest.groupBy("json_file").agg(F.count(F.lit(1)).alias("entries"), F.min("source_file").alias("m_name"), F.min("sha256").alias("m_sha"))
    files = stored.select("file_name", F.struct("sha256", "is_pdf").alias("held"))
    given = fallback.select("json_file", F.struct("file_name", "sha256", "is_pdf").alias("given"))
    rows = sources.join(entries, "json_file", "left").join(files, "file_name", "left").join(given, "json_file", "left")
    hashed = lambda c: F.coalesce(c.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    pdf = lambda c: F.coalesce(F.lower(c).endswith(".pdf"), F.lit(False))
    valid = plain_file_name(F.col("json_file")) & plain_file_name(F.col("file_name")) & pdf(F.col("file_name")) & hashed(F.col("sha256"))
    differs = ~F.col("m_name").eqNullSafe(F.col("file_name")) | ~hashed(F.col("m_sha")) | ~F.lower("m_sha").eqNullSafe(F.lower("sha256"))
    fits = lambda f: F.col(f"{f}.is_pdf") & (F.lower(f"{f}.sha256") == F.lower("sha256"))
    listed = F.col("entries").isNotNull()
    status = (F.when(~valid, "INVALID_SOURCE").when(listed & ((F.col("entries") > 1) | differs), "PDF_MISMATCH").when(listed & F.col("held").isNotNull(), F.when(fits("held"), "AUTO_BOUND").otherwise("PDF_MISMATCH"))
              .when(F.col("given").isNull(), "FALLBACK_REQUIRED").when(plain_file_name(F.col("given.file_name")) & pdf(F.col("given.file_name")) & fits("given"), "MANUAL_BOUND").otherwise("PDF_MISMATCH"))
    return rows.select("json_file", status.alias("status"))


def frozen_check(decisions: DataFrame, plans: DataFrame, manufacturers: DataFrame, candidates: DataFrame, products: DataFrame) -> DataFrame:
    """``decision_id`` and the first reason why a frozen decision no longer fits, or READY.

    ``decisions``: decision_id, evidence_id, approved, json_sha256, pdf_sha256, product_name, product_code, issue_date, revision, canonical, existing_manufacturer.
    ``plans``: evidence_id, json_sha256, pdf_sha256 (of the files as they are) and the identity plan. ``candidates``: name, manufacturer_id, as manufacturer_candidates gives them.
    """
    fresh = plans.select("evidence_id", F.struct("json_sha256", "pdf_sha256", "product_name", "product_code", "issue_date", "revision", "canonical", "blockers").alias("now"))
    makers = manufacturers.groupBy(F.col("manufacturer_name").alias("existing_manufacturer")).agg(F.count(F.lit(1)).alias("makers"), F.min("manufacturer_id").alias("selected_id"))
    offered = candidates.select(F.col("name").alias("canonical"), F.col("manufacturer_id").alias("selected_id"), F.lit(True).alias("offered")).distinct()
    own = products.groupBy("product_name", F.col("manufacturer_id").alias("selected_id"))
    any_code = own.agg(F.lit(True).alias("any_code"))
    this_code = products.groupBy("product_name", F.col("manufacturer_id").alias("selected_id"), F.col("manufacturer_product_code").alias("product_code")).agg(F.lit(True).alias("this_code"))
    rows = decisions.join(fresh, "evidence_id", "left").join(makers, "existing_manufacturer", "left").join(offered, ["canonical", "selected_id"], "left")
    rows = rows.join(any_code, ["product_name", "selected_id"], "left").join(this_code, ["product_name", "selected_id", "product_code"], "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"now.{c}"))
    identity = same("product_name") & same("product_code") & same("issue_date") & same("revision") & same("canonical")
    taken = F.coalesce(F.when(F.col("product_code").isNull(), F.col("any_code")).otherwise(F.col("this_code")), F.lit(False))
    reason = (F.when(~F.coalesce("approved", F.lit(False)), "BATCH_DECISION_NOT_APPROVED").when(~same("json_sha256"), "SOURCE_CHANGED").when(~same("pdf_sha256"), "PDF_MISMATCH")
              .when(~identity | F.col("now.blockers").contains("EXTRACTION_VALIDATION_BLOCKED"), "BATCH_DECISION_MISMATCH").when(F.coalesce("makers", F.lit(0)) != 1, "MANUFACTURER_NOT_UNIQUE")
              .when(F.col("offered").isNull(), "LINK_TARGET_NOT_APPROVED").when(taken, "STALE_RESOLUTION").otherwise("READY"))
    return rows.select("decision_id", reason.alias("verdict"))
