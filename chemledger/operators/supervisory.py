"""Supervisory list: product by active location with the reasons that need action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.functions import labels
from chemledger.operators.facts import active_assignments, current_decisions, current_documents, listed
from chemledger.operators.paths import with_file_present
from chemledger.plans.lookup import with_unit

# The six action reasons in display order.
PENDING, REJECTED, NO_DOCUMENT, NO_FILE, NO_LOCATION, NO_EVIDENCE = (
    "BRAK DECYZJI BHP", "PRODUKT ODRZUCONY", "BRAK CURRENT SDS", "BRAK PLIKU SDS", "BRAK MIEJSCA STOSOWANIA",
    "BRAK PLIKU DOWODU BHP")
ALL, NONE = object(), None


def current_state(reg) -> DataFrame:
    """One row per product with its current document, decision and file flags."""
    evidence = reg.decision_evidence.select("evidence_id", F.col("relative_path").alias("_evidence_path"))
    decision = (current_decisions(reg.bhp_decisions).join(evidence, "evidence_id", "left").select(
        F.col("sds_id").alias("current_sds_id"), F.col("decision_id").alias("current_bhp_decision_id"),
        F.col("decision_status").alias("current_bhp_decision_status"),
        F.col("registered_at").alias("current_bhp_registered_at"), F.col("notes").alias("current_bhp_notes"),
        "_evidence_path"))
    decision = with_file_present(decision, listed(reg.file_listing, "evidence"), "_evidence_path", "current_bhp_evidence_available",
                                 "current_bhp_decision_id").drop("_evidence_path")
    document = current_documents(reg.sds_documents).select(
        "product_id", F.col("sds_id").alias("current_sds_id"), F.col("original_filename").alias("current_sds_filename"),
        F.col("issue_date").alias("current_sds_issue_date"), F.col("revision").alias("current_sds_revision"),
        F.col("relative_path").alias("_sds_path"))
    document = with_file_present(document, listed(reg.file_listing, "sds"), "_sds_path", "current_sds_file_available",
                                 "current_sds_id").drop("_sds_path")
    products = reg.products.select("product_id", "product_name", "manufacturer_product_code", "usage_status",
                                   "use_description", "use_restriction", "manufacturer_id")
    rows = (products.join(reg.manufacturers, "manufacturer_id").drop("manufacturer_id")
            .join(document.join(decision, "current_sds_id", "left"), "product_id", "left"))
    flags = ("current_sds_file_available", "current_bhp_evidence_available")
    return rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def located(reg) -> DataFrame:
    """Active assignments whose peak unit is known, with unit codes."""
    rows = with_unit(active_assignments(reg), reg.unit_of_measure, "peak_quantity_unit_id", "peak_quantity_unit", "inner")
    return (with_unit(rows, reg.unit_of_measure, "monthly_consumption_unit_id", "monthly_consumption_unit")
            .select("product_id", F.col("location_name").alias("usage_location_name"), "peak_quantity_value",
                    "peak_quantity_unit", "monthly_consumption_value", "monthly_consumption_unit"))


def action_reasons() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("usage_status") == "PENDING_APPROVAL", PENDING),
        F.when(F.col("usage_status") == "REJECTED", REJECTED),
        F.when(F.col("current_sds_id").isNull(), NO_DOCUMENT).when(~F.col("current_sds_file_available"), NO_FILE),
        F.when(F.col("usage_location_name").isNull(), NO_LOCATION),
        F.when(F.col("current_bhp_decision_id").isNotNull() & ~F.col("current_bhp_evidence_available"), NO_EVIDENCE)))


def ambiguous_products(reg) -> DataFrame:
    """Products whose CURRENT document, or the CURRENT decision on it, is not the only one."""
    documents = current_documents(reg.sds_documents).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("product_id")
    decisions = current_decisions(reg.bhp_decisions).groupBy("product_id", "sds_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("product_id")
    return documents.unionByName(decisions).distinct()


def supervisory_rows(reg) -> DataFrame:
    """One row for each product and active location. Where a product is ambiguous (see above) its rows multiply; ``require_unambiguous`` refuses them."""
    rows = current_state(reg).join(located(reg), "product_id", "left").withColumn("action_reasons", action_reasons())
    return rows.withColumn("requires_action", F.size("action_reasons") > 0)


def require_unambiguous(rows: DataFrame, reg) -> DataFrame:
    """The rows, with a failure inside the plan if a product is ambiguous."""
    bad = ambiguous_products(reg).select("product_id", F.raise_error(F.lit("more than one CURRENT document or decision")).cast("boolean").alias("_bad"))
    return rows.join(bad, "product_id", "left").where(F.coalesce("_bad", F.lit(True))).drop("_bad")


def ordered_rows(rows: DataFrame) -> DataFrame:
    def blank(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    return rows.orderBy("product_name", blank("manufacturer_product_code"), "product_id", blank("usage_location_name"))


@dataclass(frozen=True)
class Choice:
    """What the list shows: ``location`` and ``decision`` take ALL, NONE (no value) or a value."""

    search: str = ""
    only_action: bool = False
    status: str | None = None
    location: object = ALL
    decision: object = ALL


def filtered(rows: DataFrame, choice: Choice) -> DataFrame:
    """The search text is used as typed: it is not stripped here."""
    out = rows.where(F.contains(labels.folded(F.col("product_name")), F.lit(choice.search.casefold())))
    if choice.only_action:
        out = out.where("requires_action")
    if choice.status is not None:
        out = out.where(F.col("usage_status") == choice.status)
    for column, wanted in (("usage_location_name", choice.location), ("current_bhp_decision_status", choice.decision)):
        if wanted is NONE:
            out = out.where(F.col(column).isNull() | ((F.col(column) == "") if column == "usage_location_name" else F.lit(False)))
        elif wanted is not ALL:
            out = out.where(F.col(column) == wanted)
    return out


def table_labels(rows: DataFrame) -> DataFrame:
    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(labels.DASH))

    no_name = F.col("usage_location_name").isNull() | (F.col("usage_location_name") == "")
    return rows.select(
        "product_id", "product_name", "manufacturer_name", labels.or_dash(F.col("manufacturer_product_code")).alias("code_label"), "usage_status", "usage_location_name",
        F.when(no_name, "Brak").otherwise(F.col("usage_location_name")).alias("location_label"),
        F.coalesce(labels.plain_decimal(F.col("peak_quantity_value")), F.lit(labels.DASH)).alias("peak_label"), value("peak_quantity_unit").alias("peak_unit_label"),
        F.coalesce(labels.plain_decimal(F.col("monthly_consumption_value")), F.lit(labels.DASH)).alias("monthly_label"),
        value("monthly_consumption_unit").alias("monthly_unit_label"),
        F.when(F.col("current_sds_id").isNull(), NO_DOCUMENT).when(~F.col("current_sds_file_available"), NO_FILE)
        .otherwise("CURRENT").alias("sds_label"),
        labels.or_dash(F.col("current_sds_issue_date").cast("string")).alias("issue_date_label"),
        labels.or_dash(F.col("current_sds_revision")).alias("revision_label"),
        F.when(F.col("current_bhp_decision_id").isNull(), "BRAK DECYZJI").otherwise(
            F.col("current_bhp_decision_status")).alias("bhp_label"),
        labels.or_dash(F.col("current_bhp_notes")).alias("notes_label"),
        F.when(F.col("requires_action"), F.array_join("action_reasons", "; ")).otherwise("OK").alias("action_label"))
