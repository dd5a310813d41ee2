"""Append-only history tables read as validity intervals and latest states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemledger.plans.ordered import lead_values


def ordered_history(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return history.orderBy(*keys, "changed_at", "history_id")


def validity_intervals(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = lead_values(history, list(keys), "changed_at", ["history_id"], "changed_at", "valid_to")
    return rows.withColumnRenamed("changed_at", "valid_from").withColumn("is_latest", F.col("valid_to").isNull())


def latest_states(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last row per entity as an aggregate, so no entity's history is gathered in one task."""
    rest = [c for c in history.columns if c not in keys]
    latest = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("changed_at", "history_id")).alias("_row"))
    return latest.select(*keys, "_row.*")
