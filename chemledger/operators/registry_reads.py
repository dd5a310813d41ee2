"""Registry lists, histories and lookups for all products at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemledger.functions import labels
from chemledger.operators.facts import current_documents, listed
from chemledger.operators.paths import EVIDENCE_SUFFIXES, suffix
from chemledger.plans.lookup import with_unit
from chemledger.operators.supervisory import current_state


def product_list(reg) -> DataFrame:
    return reg.products.join(reg.manufacturers, "manufacturer_id").select(
        "product_id", "product_name", "manufacturer_product_code", "manufacturer_id", "manufacturer_name",
        "usage_status", "use_description", "use_restriction", "waste_type", "waste_code").orderBy("product_id")


def search(products: DataFrame, text: str) -> DataFrame:
    """Substring over name, manufacturer and code; an absent code counts as empty text."""
    haystack = labels.folded(F.concat_ws(" ", "product_name", "manufacturer_name",
                                         F.coalesce("manufacturer_product_code", F.lit(""))))
    return products.where(F.contains(haystack, F.lit(text.strip().casefold())))


def sorted_registry(products: DataFrame, by: str) -> DataFrame:
    """Case-insensitive order; the product id keeps the order of equal names stable."""
    return products.orderBy(F.lower(F.coalesce(F.col(by), F.lit(""))), "product_id")


def sds_history(reg) -> DataFrame:
    audit = reg.sds_invalidation.select(
        F.col("invalidated_sds_id").alias("sds_id"), "invalidated_at", F.col("reason").alias("invalidation_reason"),
        "invalidated_from_status", "restored_sds_id")
    documents = reg.sds_documents.select("sds_id", "product_id", "original_filename", "relative_path", "issue_date",
                                         "revision", "document_status", "registered_at")
    return documents.join(audit, "sds_id", "left")


def ordered_sds_history(history: DataFrame) -> DataFrame:
    return history.orderBy("product_id", F.desc("registered_at"), "sds_id")


def restored_names(history: DataFrame) -> DataFrame:
    """File name of the document restored beside an invalidated one, inside the same product."""
    invalidated = history.where(F.col("document_status") == "INVALIDATED").select(
        "product_id", "sds_id", "invalidated_from_status", "invalidation_reason", "restored_sds_id")
    names = history.select("product_id", F.col("sds_id").alias("restored_sds_id"),
                           F.col("original_filename").alias("restored_filename"))
    with_restore = invalidated.where(F.col("restored_sds_id").isNotNull()).join(
        names, ["product_id", "restored_sds_id"], "left")
    without = invalidated.where(F.col("restored_sds_id").isNull()).withColumn(
        "restored_filename", F.lit(None).cast("string"))
    return with_restore.unionByName(without).withColumn(
        "restored_label", F.when(F.col("restored_filename").isNull() | (F.col("restored_filename") == ""), "Brak")
        .otherwise(F.col("restored_filename")))


def withdrawn_products(history: DataFrame) -> DataFrame:
    """Products without CURRENT document whose current one was invalidated and not replaced."""
    withdrawn = ((F.col("document_status") == "INVALIDATED") & F.col("invalidated_at").isNotNull()
                 & (F.col("invalidated_from_status") == "CURRENT") & F.col("restored_sds_id").isNull())
    flags = history.groupBy("product_id").agg(
        F.bool_or(F.col("document_status") == "CURRENT").alias("_current"),
        F.bool_or(F.coalesce(withdrawn, F.lit(False))).alias("_withdrawn"))
    return flags.where(~F.col("_current") & F.col("_withdrawn")).select("product_id")


def registry_labels(reg) -> DataFrame:
    withdrawn = withdrawn_products(sds_history(reg)).withColumn("_withdrawn", F.lit(True))
    rows = current_state(reg).join(withdrawn, "product_id", "left").withColumn(
        "_withdrawn", F.coalesce("_withdrawn", F.lit(False)) & F.col("current_sds_id").isNull())
    return rows.select(
        "product_id", labels.or_dash(F.col("manufacturer_product_code")).alias("code_label"),
        F.when(F.col("_withdrawn"), labels.WITHDRAWN_STATUS).otherwise(
            labels.words(F.col("usage_status"), labels.STATUS_WORDS, F.col("usage_status"))).alias("status_label"),
        labels.document_state(F.col("current_sds_id"), F.col("current_sds_file_available"), F.col("_withdrawn"))
        .alias("sds_label"),
        labels.or_dash(F.when(F.col("current_sds_id").isNotNull(), F.col("current_sds_revision"))).alias("revision_label"),
        F.when(F.col("current_bhp_decision_status").isNull(), "Brak decyzji").otherwise(
            labels.words(F.col("current_bhp_decision_status"), labels.DECISION_WORDS,
                         F.col("current_bhp_decision_status"))).alias("bhp_label"))


def decision_products(reg) -> DataFrame:
    """Products with a CURRENT document, flagged where profile or use data are still missing."""
    profile = reg.safety_profiles.select("sds_id").withColumn("_profile", F.lit(True))
    document = current_documents(reg.sds_documents).select(
        "product_id", "sds_id", F.col("original_filename").alias("sds_filename"), F.col("issue_date").alias("sds_issue_date"),
        F.col("revision").alias("sds_revision")).join(profile, "sds_id", "left")
    return (reg.products.join(reg.manufacturers, "manufacturer_id").join(document, "product_id").select(
        "product_id", "product_name", "manufacturer_product_code", "manufacturer_name", "usage_status", "sds_id",
        "sds_filename", "sds_issue_date", "sds_revision", F.col("_profile").isNull().alias("safety_enrichment_pending"),
        (F.col("use_description").isNull() | F.col("use_restriction").isNull()).alias("administrative_data_pending"))
        .orderBy("product_name", "product_id"))


def decision_history(reg) -> DataFrame:
    evidence = reg.decision_evidence.select(
        "evidence_id", F.col("relative_path").alias("evidence_relative_path"),
        F.col("original_filename").alias("evidence_original_filename"))
    return (reg.bhp_decisions.join(evidence, "evidence_id")
            .select("sds_id", "decision_id", "decision_status", "record_status", "registered_at", "notes",
                    "evidence_relative_path", "evidence_original_filename"))


def superseded_decisions(history: DataFrame) -> DataFrame:
    return history.where(F.col("record_status") == "SUPERSEDED").orderBy("sds_id", F.desc("registered_at"), "decision_id")


def current_decisions_of_current_documents(reg) -> DataFrame:
    live = current_documents(reg.sds_documents).select("sds_id")
    return decision_history(reg).where(F.col("record_status") == "CURRENT").join(live, "sds_id", "left_semi")


def product_details(reg) -> DataFrame:
    documents = reg.sds_documents.groupBy("product_id").agg(F.count(F.lit(1)).alias("sds_count"))
    decisions = reg.bhp_decisions.groupBy("product_id").agg(F.count(F.lit(1)).alias("bhp_decision_count"))
    rows = product_list(reg).join(documents, "product_id", "left").join(decisions, "product_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("sds_count", "bhp_decision_count")})


def product_assignments(reg) -> DataFrame:
    """Assignments of every product to locations of any status, with unit codes."""
    places = reg.usage_locations.select("location_id", "location_name", "location_code", F.col("status").alias("location_status"))
    rows = with_unit(reg.product_usage_locations.join(places, "location_id"), reg.unit_of_measure, "peak_quantity_unit_id", "peak_quantity_unit", "inner")
    return (with_unit(rows, reg.unit_of_measure, "monthly_consumption_unit_id", "monthly_consumption_unit")
            .select("product_id", "location_id", "location_name", "location_code", "location_status", "peak_quantity_value", "peak_quantity_unit_id",
                    "peak_quantity_unit", "monthly_consumption_value", "monthly_consumption_unit_id", "monthly_consumption_unit"))


def ordered_assignments(rows: DataFrame) -> DataFrame:
    return rows.orderBy("product_id", "location_id")


def quantity_totals(product_usage_locations: DataFrame, strict: bool = False) -> DataFrame:
    """Sum of peak quantities per product when all units agree; mixed units give no total."""
    rows = product_usage_locations.groupBy("product_id").agg(
        F.sum("peak_quantity_value").alias("_sum"),
        (F.min("peak_quantity_unit_id") != F.max("peak_quantity_unit_id")).alias("_mixed"))
    failure = F.raise_error(F.lit("quantities in different units cannot be added")).cast("decimal(28,6)")
    total = F.when(F.col("_mixed"), failure if strict else F.lit(None).cast("decimal(28,6)")).otherwise(F.col("_sum"))
    return rows.select("product_id", total.alias("peak_total"),
                       F.when(F.col("_mixed"), "MIXED_UNITS").otherwise("OK").alias("total_status"))


def quantity_totals_of_products(reg) -> DataFrame:
    """Every product; one without assignments has total zero."""
    totals = quantity_totals(reg.product_usage_locations)
    return reg.products.select("product_id").join(totals, "product_id", "left").select(
        "product_id", F.when(F.col("total_status").isNull(), F.lit(0).cast("decimal(28,6)")).otherwise(
            F.col("peak_total")).alias("peak_total"), F.coalesce("total_status", F.lit("OK")).alias("total_status"))


def first_evidence_names(decision_evidence: DataFrame) -> DataFrame:
    """Name registered first for each path; a null name counts if it is the first."""
    first = decision_evidence.groupBy("relative_path").agg(F.min_by(F.struct("original_filename"), "evidence_id").alias("_first"))
    return first.select("relative_path", F.col("_first.original_filename").alias("registered_name"))


def stored_evidence(listing: DataFrame) -> DataFrame:
    """Files of the evidence root with an accepted suffix and at least one byte."""
    return listed(listing, "evidence").where(suffix(F.col("relative_path")).isin(*EVIDENCE_SUFFIXES) & (F.col("length") > 0))


def evidence_options(listing: DataFrame, names: DataFrame) -> DataFrame:
    """Stored evidence files with the registered name, or the file name where that is absent or blank;
    imported files that nobody registered are left out."""
    joined = stored_evidence(listing).join(names.withColumn("_known", F.lit(True)), "relative_path", "left")
    kept = joined.where(~F.startswith(F.col("relative_path"), F.lit("imported/")) | F.coalesce("_known", F.lit(False)))
    name = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    return kept.select("relative_path", F.when(F.col("registered_name").isNull() | (F.col("registered_name") == ""), name)
                       .otherwise(F.col("registered_name")).alias("original_filename"))


def locations_without_code(usage_locations: DataFrame) -> DataFrame:
    return usage_locations.agg(F.count_if(F.col("location_code").isNull()).alias("locations_without_code"))


def current_document_probe(sds_documents: DataFrame) -> DataFrame:
    """The CURRENT file of each product, or AMBIGUOUS where there are several."""
    rows = current_documents(sds_documents).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("original_filename").alias("original_filename"),
        F.min("relative_path").alias("relative_path"))
    single = F.col("_n") == 1
    return rows.select("product_id", F.when(single, F.col("original_filename")).alias("original_filename"),
                       F.when(single, F.col("relative_path")).alias("relative_path"),
                       F.when(single, "OK").otherwise("AMBIGUOUS").alias("current_status"))


def existing_products(reg, wanted: DataFrame) -> DataFrame:
    return wanted.join(reg.products.select("product_id"), "product_id", "left_semi")


def active_units(unit_of_measure: DataFrame) -> DataFrame:
    return unit_of_measure.where(F.col("status") == "ACTIVE").orderBy("code")


def usage_location_list(usage_locations: DataFrame) -> DataFrame:
    return usage_locations.orderBy("location_id")
