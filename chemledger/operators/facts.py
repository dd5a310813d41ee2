"""One row per product: current document, current decision, evidence, active locations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.operators.paths import with_availability

NOT_APPLICABLE = "NOT_APPLICABLE_NO_CURRENT_SDS"


@dataclass(frozen=True)
class Filters:
    trend_from: dt.date
    trend_to: dt.date
    manufacturer_id: object | None = None
    sds_status: str | None = None  # CURRENT_PRESENT or CURRENT_MISSING
    bhp_status: str | None = None
    location_id: object | None = None
    include_no_active_location: bool = False

    def __post_init__(self) -> None:
        if self.trend_from > self.trend_to:
            raise ValueError("the trend must not end before it starts")
        if self.bhp_status == NOT_APPLICABLE:
            raise ValueError(f"{NOT_APPLICABLE} cannot be chosen as a filter")

    @property
    def narrows_products(self) -> bool:
        return self.include_no_active_location or any(
            v is not None for v in (self.manufacturer_id, self.sds_status, self.bhp_status, self.location_id))


EVERYTHING = Filters(dt.date(1900, 1, 1), dt.date(2999, 12, 31))


def current_documents(sds_documents: DataFrame) -> DataFrame:
    return sds_documents.where(F.col("document_status") == "CURRENT")


def current_decisions(bhp_decisions: DataFrame) -> DataFrame:
    return bhp_decisions.where(F.col("record_status") == "CURRENT")


def active_assignments(reg) -> DataFrame:
    """Assignments to ACTIVE locations. The location side is one row per key, so a hot location only
    skews the assignment side, which the adaptive skew join splits."""
    active = reg.usage_locations.where(F.col("status") == "ACTIVE").select("location_id", "location_name")
    return reg.product_usage_locations.join(active, "location_id", "inner")


def active_location_counts(reg) -> DataFrame:
    return active_assignments(reg).groupBy("product_id").agg(F.countDistinct("location_id").alias("active_location_count"))


def latest_registrations(sds_documents: DataFrame) -> DataFrame:
    return sds_documents.groupBy("product_id").agg(F.max("registered_at").alias("latest_sds_registered_at"))


def bhp_category(sds_id: Column, decision_id: Column, decision_status: Column) -> Column:
    return F.when(sds_id.isNull(), NOT_APPLICABLE).when(decision_id.isNull(), "NO_DECISION").otherwise(decision_status)


def product_facts(reg) -> DataFrame:
    """CURRENT is tested on the right side of each left join, so products without one stay.

    Decisions meet their documents before the documents meet the products: no join key is ever null."""
    sds = current_documents(reg.sds_documents).select(
        "product_id", F.col("sds_id").alias("current_sds_id"),
        F.col("original_filename").alias("current_sds_original_filename"),
        F.col("relative_path").alias("current_sds_relative_path"),
        F.col("registered_at").alias("current_sds_registered_at"),
        F.col("revision").alias("current_sds_revision"), F.col("issue_date").alias("current_sds_issue_date"))
    documents = sds.join(decision_with_evidence(reg), "current_sds_id", "left")
    products = reg.products.select("product_id", "product_name", "usage_status", "manufacturer_id")
    return (products.join(reg.manufacturers.select("manufacturer_id", "manufacturer_name"), "manufacturer_id")
            .join(documents, "product_id", "left")
            .join(active_location_counts(reg), "product_id", "left")
            .join(latest_registrations(reg.sds_documents), "product_id", "left")
            .withColumn("bhp_category", bhp_category(F.col("current_sds_id"), F.col("current_bhp_decision_id"),
                                                     F.col("_decision_status")))
            .withColumn("active_location_count", F.coalesce("active_location_count", F.lit(0)).cast("long"))
            .drop("_decision_status"))


def decision_with_evidence(reg) -> DataFrame:
    decision = current_decisions(reg.bhp_decisions).select(
        F.col("sds_id").alias("current_sds_id"), F.col("decision_id").alias("current_bhp_decision_id"),
        F.col("decision_status").alias("_decision_status"), F.col("evidence_id").alias("_evidence_id"))
    evidence = reg.decision_evidence.select(
        F.col("evidence_id").alias("_evidence_id"), F.col("evidence_id").alias("current_evidence_id"),
        F.col("original_filename").alias("current_evidence_original_filename"),
        F.col("relative_path").alias("current_evidence_relative_path"))
    return decision.join(evidence, "_evidence_id", "left").drop("_evidence_id")


def listed(listing: DataFrame, root: str) -> DataFrame:
    """The files of one root: ``sds`` or ``evidence``."""
    return listing.where(F.col("root") == root)


def with_file_states(facts: DataFrame, listing: DataFrame, sds_root: bool = True, evidence_root: bool = True) -> DataFrame:
    rows = with_availability(facts, listed(listing, "sds"), "current_sds_relative_path", F.col("current_sds_id").isNotNull(),
                             "current_sds_availability", "document", root_present=sds_root)
    return with_availability(rows, listed(listing, "evidence"), "current_evidence_relative_path",
                             F.col("current_bhp_decision_id").isNotNull(), "current_evidence_availability", "evidence",
                             root_present=evidence_root)


def scope(facts: DataFrame, reg, filters: Filters) -> DataFrame:
    rows = facts
    if filters.manufacturer_id is not None:
        rows = rows.where(F.col("manufacturer_id") == filters.manufacturer_id)
    if filters.sds_status == "CURRENT_PRESENT":
        rows = rows.where(F.col("current_sds_id").isNotNull())
    elif filters.sds_status == "CURRENT_MISSING":
        rows = rows.where(F.col("current_sds_id").isNull())
    if filters.bhp_status is not None:
        rows = rows.where(F.col("bhp_category") == filters.bhp_status)
    if filters.location_id is None:
        return rows.where(F.col("active_location_count") == 0) if filters.include_no_active_location else rows
    here = active_assignments(reg).where(F.col("location_id") == filters.location_id).select("product_id").distinct()
    if not filters.include_no_active_location:
        return rows.join(here, "product_id", "left_semi")
    marked = rows.join(here.withColumn("_here", F.lit(True)), "product_id", "left")
    return marked.where(F.col("_here") | (F.col("active_location_count") == 0)).drop("_here")


def attention_reasons() -> Column:
    """Reasons in fixed order; needs the file states."""
    missing = F.lit("MISSING")
    return F.array_compact(F.array(
        F.when(F.col("current_sds_id").isNull(), "NO_CURRENT_SDS"),
        F.when(F.col("bhp_category") == "NO_DECISION", "NO_BHP_DECISION"),
        F.when(F.col("usage_status").isin("ACTIVE", "PENDING_APPROVAL") & (F.col("active_location_count") == 0),
               "NO_ACTIVE_LOCATION"),
        F.when(F.col("current_sds_availability").eqNullSafe(missing)
               | F.col("current_evidence_availability").eqNullSafe(missing), "MISSING_SOURCE_FILE")))


def dashboard_facts(reg, filters: Filters = EVERYTHING) -> DataFrame:
    scoped = scope(product_facts(reg), reg, filters)
    return with_file_states(scoped, reg.file_listing).withColumn("attention_reasons", attention_reasons())


def ordered_facts(facts: DataFrame) -> DataFrame:
    return facts.orderBy("product_name", "product_id")


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Products that appear more than once, which means an ambiguous current document or decision."""
    return facts.groupBy("product_id").agg(F.count(F.lit(1)).alias("fact_rows")).where(F.col("fact_rows") > 1)


def require_single_facts(facts: DataFrame) -> DataFrame:
    """The facts, with a failure inside the plan if a product has more than one row."""
    extra = duplicate_facts(facts).select("product_id", F.raise_error(F.lit("more than one fact row for a product")).cast("boolean").alias("_twice"))
    return facts.join(extra, "product_id", "left").where(F.coalesce("_twice", F.lit(True))).drop("_twice")
