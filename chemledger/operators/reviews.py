"""Physical stock reviews: latest final items, totals, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.plans.lookup import with_unit


def _nulls_on_top(*columns: str) -> Column:
    """A struct whose maximum is the first row of ``c1 DESC NULLS FIRST, c2 DESC NULLS FIRST, ...``."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])


def latest_final_items(reg) -> DataFrame:
    """Latest FINAL item per (product, location), chosen before looking at the observed quantity.

    The choice is an aggregate, so it combines before the shuffle however many reviews a pair has.
    """
    final = reg.physical_reviews.where(F.col("status") == "FINAL").select("review_id", "review_date", "finalized_at")
    items = reg.physical_review_items.join(final, "review_id", "inner")
    kept = F.struct("review_id", "review_date", "observed_quantity", "baseline_max_quantity", "baseline_unit_id")
    latest = items.groupBy("product_id", "location_id").agg(
        F.max_by(kept, _nulls_on_top("review_date", "finalized_at", "review_id")).alias("_latest"))
    return latest.select("product_id", "location_id", "_latest.*").withColumn(
        "difference", F.col("observed_quantity") - F.col("baseline_max_quantity"))


def review_details(reg) -> DataFrame:
    names = reg.products.select("product_id", "product_name")
    places = reg.usage_locations.select("location_id", "location_code", "location_name")
    rows = reg.physical_review_items.join(names, "product_id").join(places, "location_id")
    return (with_unit(rows, reg.unit_of_measure, "baseline_unit_id", "unit_code", "inner")
            .withColumn("difference", F.col("observed_quantity") - F.col("baseline_max_quantity"))
            .select("review_id", "review_item_id", "product_id", "product_name", "location_id", "location_code",
                    "location_name", "baseline_max_quantity", "unit_code", "observed_quantity", "difference"))


def ordered_review_details(rows: DataFrame) -> DataFrame:
    return rows.orderBy("product_name", F.asc_nulls_last("location_code"), "review_item_id")


def review_totals(details: DataFrame) -> DataFrame:
    return details.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("items"), F.count("observed_quantity").alias("observed"),
        F.count_if(F.col("observed_quantity").isNull()).alias("unobserved"))


def review_list(physical_reviews: DataFrame) -> DataFrame:
    return physical_reviews.orderBy(F.desc_nulls_first("review_date"), F.desc_nulls_first("finalized_at"),
                                    F.desc_nulls_first("created_at"))


def review_population(reg) -> DataFrame:
    """Assignments to ACTIVE locations, the rows a new review takes its snapshot from."""
    active = reg.usage_locations.where(F.col("status") == "ACTIVE").select("location_id")
    return reg.product_usage_locations.join(active, "location_id", "left_semi").select(
        "product_id", "location_id", F.col("peak_quantity_value").alias("baseline_max_quantity"),
        F.col("peak_quantity_unit_id").alias("baseline_unit_id"))
