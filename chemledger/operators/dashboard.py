"""Dashboard aggregates over the scoped product facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.operators.facts import EVERYTHING, Filters, product_facts, scope
from chemledger.plans.ordered import row_numbers

# The four attention reasons in display order.
ATTENTION_REASONS = ("NO_CURRENT_SDS", "NO_BHP_DECISION", "NO_ACTIVE_LOCATION", "MISSING_SOURCE_FILE")


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def active_location_count(reg, filters: Filters = EVERYTHING, scoped: DataFrame | None = None) -> DataFrame:
    """Every ACTIVE location when nothing narrows the products, else those the scoped products use."""
    locations = reg.usage_locations.where(F.col("status") == "ACTIVE")
    if filters.location_id is not None:
        locations = locations.where(F.col("location_id") == filters.location_id)
    if filters.narrows_products:
        used = reg.product_usage_locations.join(scoped.select("product_id"), "product_id", "left_semi")
        locations = locations.join(used.select("location_id").distinct(), "location_id", "left_semi")
    return locations.agg(F.countDistinct("location_id").alias("active_locations_count"))


def kpi(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("products_total"),
        _n(F.col("current_sds_id").isNotNull()).alias("current_sds_count"),
        _n(F.col("bhp_category") == "APPROVED").alias("bhp_approved_count"),
        _n(F.size("attention_reasons") > 0).alias("attention_products_count"))


def kpi_row(reg, facts: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """Both sides are single-row aggregates, so the cross product is one row. The location count needs the scoped ids only, which come without the file states."""
    ids = scope(product_facts(reg), reg, filters).select("product_id") if filters.narrows_products else facts
    return kpi(facts).crossJoin(active_location_count(reg, filters, ids))


def bhp_distribution(facts: DataFrame) -> DataFrame:
    return facts.agg(_n(F.col("bhp_category") == "APPROVED").alias("approved"),
                     _n(F.col("bhp_category") == "REJECTED").alias("rejected"),
                     _n(F.col("bhp_category") == "NO_DECISION").alias("no_decision"))


def bhp_distribution_series(facts: DataFrame) -> DataFrame:
    return bhp_distribution(facts).unpivot([], ["approved", "rejected", "no_decision"], "series", "value")


def attention_products(facts: DataFrame) -> DataFrame:
    """Affected products in long form; a reason may hold any number of products."""
    return facts.select(F.explode("attention_reasons").alias("reason"), "product_id")


def attention_by_reason(facts: DataFrame) -> DataFrame:
    counts = facts.agg(*[_n(F.array_contains("attention_reasons", r)).alias(r) for r in ATTENTION_REASONS])
    return counts.unpivot([], list(ATTENTION_REASONS), "reason", "affected_products")


def manufacturer_summary(facts: DataFrame) -> DataFrame:
    return (facts.groupBy("manufacturer_name", "manufacturer_id").agg(
        F.count(F.lit(1)).alias("products_count"),
        _n(F.col("current_sds_id").isNotNull()).alias("current_sds_count"),
        _n(F.col("bhp_category") == "APPROVED").alias("bhp_approved_count"),
        _n(F.size("attention_reasons") > 0).alias("attention_products_count"),
        F.max("latest_sds_registered_at").alias("latest_sds_registered_at")))


def ordered_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("manufacturer_name", "manufacturer_id")


def manufacturers_by_products(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("manufacturer_name", "manufacturer_id").agg(F.count(F.lit(1)).alias("products_count"))
    return counts.orderBy(F.desc("products_count"), "manufacturer_name", "manufacturer_id")


def registration_sequence(sds_documents: DataFrame) -> DataFrame:
    """Number of each registration of a product, over all statuses and dates."""
    rows = sds_documents.select("product_id", "sds_id", "registered_at")
    return row_numbers(rows, ["product_id"], "registered_at", ["sds_id"], "sequence")


def sds_trend(sds_documents: DataFrame, scoped: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """New and updated registrations per month.

    Only the first registration of a product counts as new, so the ranking reduces to one minimum
    per product: every registration of the month minus the first ones that fall into it.
    """
    day = F.col("registered_at").cast("date")
    inside = (day >= F.lit(filters.trend_from)) & (day <= F.lit(filters.trend_to))
    # one row for each product and month, read once: how many registrations of the month lie inside, and the first of the month
    per = (sds_documents.groupBy("product_id", F.trunc(day, "month").alias("period_start"))
           .agg(F.count_if(inside).alias("_n"), F.min(F.struct("registered_at", "sds_id", inside.alias("inside"))).alias("_first"))
           .join(scoped.select("product_id"), "product_id", "left_semi"))
    first = per.groupBy("product_id").agg(F.min("_first").alias("_first"))
    new = first.where("_first.inside").select(F.trunc(F.col("_first.registered_at").cast("date"), "month").alias("period_start"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_new"))
    both = per.select("period_start", "_n", F.lit(0).alias("_new")).unionByName(new)
    months = both.groupBy("period_start").agg(F.sum("_new").cast("long").alias("new_sds_count"), F.sum("_n").alias("_all"))
    return months.where("_all > 0").select("period_start", "new_sds_count", (F.col("_all") - F.col("new_sds_count")).cast("long").alias("updated_sds_count"))


def trend_series(trend: DataFrame) -> DataFrame:
    return trend.unpivot(["period_start"], ["new_sds_count", "updated_sds_count"], "series", "value")


def filter_manufacturers(reg) -> DataFrame:
    return reg.manufacturers.select("manufacturer_id", "manufacturer_name").orderBy("manufacturer_name", "manufacturer_id")


def filter_locations(reg) -> DataFrame:
    return (reg.usage_locations.where(F.col("status") == "ACTIVE").select("location_id", "location_name")
            .orderBy("location_name", "location_id"))
