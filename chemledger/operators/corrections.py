"""Review items resolved by approved decisions, and the check of a batch after it was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.operators import batch

CORRECT, CREATE, RESOLVE = "CORRECT_EXISTING_PRODUCT", "CREATE_DISTINCT_PRODUCT", "RESOLVE_EXACT"
OF_IDENTITY = ("MULTIPLE_CURRENT_SDS", "SDS_METADATA_SOURCE_CONFLICT")
OF_ONE_PRODUCT = (*OF_IDENTITY, "EXACT_PRODUCT_SDS_PDF", "NO_CURRENT_SDS_FOR_EXISTING_PRODUCT", "REVISION_NOT_NEWER", "NEWER_ISSUE_DATE")


def resolve_reviews(items: DataFrame, decisions: DataFrame, products: DataFrame, documents: DataFrame, canonical: str, target_id: object) -> DataFrame:
    """``manifest_id``, ``action``, ``classification`` and ``reason`` of every item that a decision names; the first rule that applies wins.

    ``items``, ``products``: as in ``batch.classify``. ``decisions``: one row for each manifest_id, with observed (the manufacturer it approves, null for
    ``canonical``), action, product_id, preserve_name, preserve_code, old_manufacturer_id, new_manufacturer_id, and product_name and product_code of a
    distinct product. ``documents``: sds_id, product_id, document_status, issue_date, revision, sha256 of the stored file, null where it cannot be read.

    Items blocked by their source or skipped as duplicates stay so. A correction holds only for the product as it was approved; the item then either is
    one of its documents, or a newer one. A distinct product may be created where no product of the manufacturer has its name. All else is classified as
    in any batch, but that a product with a file that cannot be read blocks its items; files of products of similar name are not looked at. Items without
    decision and decisions without item have no row.
    """
    said = decisions.select("manifest_id", "observed", "action", *[F.col(c).alias(f"d_{c}") for c in ("product_id", "preserve_name", "preserve_code", "old_manufacturer_id", "new_manufacturer_id", "product_name", "product_code")])
    rows = items.join(said, "manifest_id").withColumn("approved", F.col("manufacturer").eqNullSafe(F.coalesce("observed", F.lit(canonical))))
    own = rows.withColumn("manufacturer", F.when(F.col("approved"), F.lit(canonical)).otherwise("")).select(*items.columns)
    base = batch.classify(own, products, documents, canonical, target_id)
    rows = rows.join(base, "manifest_id")

    named = products.select(F.col("product_id").alias("d_product_id"), F.col("product_name").alias("p_name"), F.col("manufacturer_product_code").alias("p_code"), F.col("manufacturer_id").alias("p_maker"))
    current = F.col("document_status") == "CURRENT"
    state = documents.groupBy(F.col("product_id").alias("d_product_id")).agg(
        F.min(F.when(F.col("sha256").isNull(), F.col("sds_id"))).alias("unread"), F.count_if(current).alias("current"), F.max(F.when(current, F.col("issue_date"))).alias("current_date"))
    same = documents.groupBy(F.col("product_id").alias("d_product_id"), "issue_date", "revision").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"))
    files = documents.where("sha256 is not null").select(F.col("product_id").alias("d_product_id"), "sha256", F.lit(True).alias("has_file")).distinct()
    target = products.where(F.col("manufacturer_id") == F.lit(target_id))
    taken = target.select("product_name", F.lit(True).alias("taken")).distinct()
    shut = target.join(documents.where("sha256 is null").select("product_id", "sds_id"), "product_id").groupBy(F.col("product_name").alias("u_name"), F.col("manufacturer_product_code").alias("u_code")).agg(F.min("sds_id").alias("shut"))
    rows = rows.join(named, "d_product_id", "left").join(state, "d_product_id", "left").join(same, ["d_product_id", "issue_date", "revision"], "left").join(files, ["d_product_id", "sha256"], "left").join(taken, "product_name", "left")
    rows = rows.join(shut, (F.col("product_name") == F.col("u_name")) & F.col("product_code").eqNullSafe(F.col("u_code")), "left")

    c = F.col
    none = lambda x: F.coalesce(x, F.lit(0))
    kept = c("p_name").isNotNull() & c("p_name").eqNullSafe(c("d_preserve_name")) & c("p_code").eqNullSafe(c("d_preserve_code")) & c("p_maker").eqNullSafe(c("d_old_manufacturer_id"))
    fits = kept & c("d_new_manufacturer_id").eqNullSafe(F.lit(target_id)) & c("product_code").isNull()
    unavailable = lambda sds: F.concat(F.lit("BLOCKED_DATA/REGISTERED_PDF_UNAVAILABLE:"), sds.cast("string"))
    correction = (
        F.when(~fits, "REVIEW_IDENTITY/APPROVED_PRODUCT_SNAPSHOT_MISMATCH")
        .when(c("unread").isNotNull(), unavailable(c("unread")))
        .when(none(c("current")) != 1, "REVIEW_SOURCE_CONFLICT/CURRENT_SDS_NOT_UNIQUE")
        .when((c("low") != c("sha256")) | (c("high") != c("sha256")), "REVIEW_SOURCE_CONFLICT/SDS_METADATA_SOURCE_CONFLICT")
        .when(c("low").isNotNull(), "READY_IDENTITY_CORRECTION_ONLY/EXACT_EXISTING_SDS_CORRECT_MANUFACTURER")
        .when(c("has_file"), "REVIEW_SOURCE_CONFLICT/PDF_METADATA_CONFLICT")
        .when(c("current_date").isNull() | (c("issue_date") <= c("current_date")), "REVIEW_SOURCE_CONFLICT/INCOMING_NOT_NEWER_THAN_CURRENT_SDS")
        .otherwise("READY_IDENTITY_CORRECTION_AND_ADD_REVISION/NEW_SDS_AFTER_CORRECTION"))
    stays = c("classification").startswith("BLOCKED") & ~c("reason").isin(*OF_IDENTITY) | c("classification").startswith("SKIP_DUPLICATE")
    as_said = c("product_name").eqNullSafe(c("d_product_name")) & c("product_code").eqNullSafe(c("d_product_code"))
    found = F.when(c("shut").isNotNull() & c("reason").isin(*OF_ONE_PRODUCT), unavailable(c("shut"))).otherwise(F.concat_ws("/", "classification", "reason"))
    verdict = (
        F.when(stays, found)
        .when(~c("approved"), "BLOCKED_DATA/DECISION_SOURCE_MISMATCH")
        .when(c("action") == CORRECT, correction)
        .when((c("action") == CREATE) & ~as_said, "BLOCKED_DATA/PRODUCT_DECISION_SOURCE_MISMATCH")
        .when((c("action") == CREATE) & (c("classification") == "REVIEW_IDENTITY") & c("taken").isNull(), "READY_CREATE/APPROVED_DISTINCT_PRODUCT")
        .otherwise(found))
    at = F.instr("verdict", "/")
    return rows.withColumn("verdict", verdict).select("manifest_id", "action", F.substring("verdict", F.lit(1), at - 1).alias("classification"), F.substring("verdict", at + 1, F.length("verdict")).alias("reason"))


def _has(keys: DataFrame, key: str, name: str) -> DataFrame:
    return keys.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(name)).distinct()


def verify_batch(report: DataFrame, products: DataFrame, documents: DataFrame, history: DataFrame, profiles: DataFrame, components: DataFrame, decisions: DataFrame, stored: DataFrame, manufacturer_id: object) -> DataFrame:
    """``manifest_id`` and ``issues`` (an array, empty where all is well) of every COMMITTED row of a batch's report, against the registry as it now stands.

    ``report``: manifest_id, action, product_id, sds_id, product_name, sha256. ``stored``: relative_path, sha256 of the files. A row must have its product,
    of its name, of no other row, of this manufacturer and without use; its document, of that product, of no other row, current, with the file's content;
    one history entry; and no profile, component or decision yet.
    """
    rows = report.where("action = 'COMMITTED'")
    twice = lambda k: rows.groupBy(k).agg((F.count(F.lit(1)) > 1).alias(f"{k}_twice"))
    own = products.select("product_id", F.col("product_name").alias("p_name"), F.col("manufacturer_id").alias("p_maker"), (F.col("use_description").isNotNull() | F.col("use_restriction").isNotNull()).alias("used"))
    names = products.groupBy("product_name").agg(F.count(F.lit(1)).alias("names"))
    card = documents.select("sds_id", F.col("product_id").alias("s_product"), "document_status", "relative_path").join(stored.select("relative_path", F.col("sha256").alias("s_sha")), "relative_path", "left")
    entries = history.groupBy("product_id").agg(F.count(F.lit(1)).alias("entries"))
    rows = rows.join(own, "product_id", "left").join(names, "product_name", "left").join(card, "sds_id", "left").join(entries, "product_id", "left").join(twice("product_id"), "product_id", "left").join(twice("sds_id"), "sds_id", "left")
    for table, name in ((profiles, "profiled"), (components, "composed"), (decisions, "decided")):
        rows = rows.join(_has(table, "sds_id", name), "sds_id", "left")
    c = F.col
    no_product, no_card = c("p_maker").isNull() & c("p_name").isNull(), c("document_status").isNull()
    checks: list[tuple[str, Column]] = [
        ("PRODUCT_MISSING", no_product), ("NAME_DIFFERS", ~no_product & ~c("p_name").eqNullSafe(c("product_name"))), ("MANUFACTURER_DIFFERS", ~no_product & ~c("p_maker").eqNullSafe(F.lit(manufacturer_id))),
        ("USE_ALREADY_SET", c("used")), ("NAME_NOT_UNIQUE", c("names") > 1), ("PRODUCT_COMMITTED_TWICE", c("product_id_twice")), ("HISTORY_NOT_ONE", F.coalesce("entries", F.lit(0)) != 1),
        ("DOCUMENT_MISSING", no_card), ("DOCUMENT_OF_ANOTHER_PRODUCT", ~no_card & ~c("s_product").eqNullSafe(c("product_id"))), ("DOCUMENT_NOT_CURRENT", c("document_status") != "CURRENT"),
        ("FILE_DIFFERS", ~no_card & ~c("s_sha").eqNullSafe(c("sha256"))), ("DOCUMENT_COMMITTED_TWICE", c("sds_id_twice")), ("PROFILE_PRESENT", c("profiled")), ("COMPONENTS_PRESENT", c("composed")), ("DECISION_PRESENT", c("decided")),
    ]
    return rows.select("manifest_id", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks])).alias("issues"))


def batch_verified(report: DataFrame, verified: DataFrame) -> DataFrame:
    """How many items of the report stand in each class and action, how many of these were checked, and how many failed a check."""
    faults = verified.select("manifest_id", F.lit(1).alias("checked"), (F.size("issues") > 0).cast("int").alias("failed"))
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ("checked", "failed")]
    return report.join(faults, "manifest_id", "left").groupBy("classification", "action").agg(F.count(F.lit(1)).alias("items"), *sums)
