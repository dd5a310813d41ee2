"""Product by active location detail with the latest stock review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemledger.functions import labels
from chemledger.operators.facts import EVERYTHING, Filters, active_assignments, product_facts, scope
from chemledger.operators.reviews import latest_final_items
from chemledger.plans.lookup import with_unit


def located_assignments(reg) -> DataFrame:
    """Active assignments with unit codes and their latest FINAL review. Unit keys, of which there are few, are salted."""
    review = latest_final_items(reg).select(
        "product_id", "location_id", F.col("observed_quantity").alias("review_observed_quantity"),
        F.col("difference").alias("review_difference"), "baseline_unit_id")
    rows = active_assignments(reg).join(review, ["product_id", "location_id"], "left")
    for key, code in (("baseline_unit_id", "review_unit_code"), ("peak_quantity_unit_id", "peak_quantity_unit_code"), ("monthly_consumption_unit_id", "monthly_consumption_unit_code")):
        rows = with_unit(rows, reg.unit_of_measure, key, code)
    return rows.drop("baseline_unit_id")


def product_location_detail(reg, filters: Filters = EVERYTHING) -> DataFrame:
    """A product without active location keeps one row with null location."""
    scoped = scope(product_facts(reg), reg, filters)
    rows = scoped.join(located_assignments(reg), "product_id", "left")
    if filters.location_id is not None:
        chosen = F.col("location_id") == filters.location_id
        if filters.include_no_active_location:
            chosen = chosen | (F.col("location_id").isNull() & (F.col("active_location_count") == 0))
        rows = rows.where(chosen)
    return rows.select(
        "product_id", "product_name", "manufacturer_name", "location_id", "location_name", "peak_quantity_value",
        "peak_quantity_unit_code", "monthly_consumption_value", "monthly_consumption_unit_code", "usage_status",
        "current_sds_revision", "current_sds_issue_date", "bhp_category", "review_observed_quantity",
        "review_difference", "review_unit_code")


def ordered_detail(rows: DataFrame) -> DataFrame:
    return rows.orderBy("product_name", "product_id", F.asc_nulls_last("location_name"), F.asc_nulls_last("location_id"))


def detail_labels(rows: DataFrame) -> DataFrame:
    return rows.select(
        "product_id", "location_id",
        F.coalesce(F.when(F.col("location_name") != "", F.col("location_name")), F.lit("Brak")).alias("location_label"),
        labels.quantity(F.col("peak_quantity_value"), F.col("peak_quantity_unit_code")).alias("peak_label"),
        labels.quantity(F.col("review_observed_quantity"), F.col("review_unit_code")).alias("observed_label"),
        labels.difference(F.col("review_difference"), F.col("review_unit_code")).alias("difference_label"),
        labels.quantity(F.col("monthly_consumption_value"), F.col("monthly_consumption_unit_code")).alias("monthly_label"),
        labels.words(F.col("usage_status"), labels.STATUS_WORDS, F.col("usage_status")).alias("status_label"),
        labels.revision_detail(F.col("current_sds_revision"), F.col("current_sds_issue_date")).alias("sds_label"),
        labels.words(F.col("bhp_category"), labels.CATEGORY_WORDS, F.col("bhp_category")).alias("bhp_label"))
