"""Row numbers and next values in ordered groups of any size, as one lazy plan.

Rows are dealt into (key, month) buckets. Each bucket is numbered for itself, and one small row for each bucket carries what the
buckets before it hold, or what the one after it begins with. No task holds more than one month of a key, nothing is counted while the
plan is built, and every size takes the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _with_bucket(df: DataFrame, keys: Sequence[str], time: str, aggregates: list[Column], over_buckets: dict[str, Column]) -> DataFrame:
    """Rows with ``_at``, their keys and bucket, and the bucket's row of ``aggregates`` and window columns joined back. A null time is a bucket too.

    ``_at`` is one value, in which nulls are equal, so that the join and a window over it deal the rows once; ``_placed`` takes it apart.
    """
    placed = df.withColumn("_at", F.struct(*keys, F.trunc(F.col(time).cast("date"), "month").alias("_bucket"))).drop(*keys)
    per = placed.groupBy("_at").agg(*aggregates).select("_at", *[c.alias(n) for n, c in over_buckets.items()])
    return placed.join(per, "_at")


def _placed(rows: DataFrame, like: DataFrame, out: str) -> DataFrame:
    """The columns of ``like``, then ``out``."""
    own = set(rows.columns)
    return rows.select(*[F.col(c) if c in own else F.col(f"_at.{c}") for c in like.columns], out)


def _inside(time: str, ties: Sequence[str]) -> WindowSpec:
    return Window.partitionBy("_at").orderBy(time, *ties)


def _buckets(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[F.col(f"_at.{c}") for c in keys]).orderBy("_at._bucket")


def row_numbers(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], out: str) -> DataFrame:
    """``row_number()`` per group in the order of ``time`` and ``ties``, which must be total within a group."""
    before = _buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_bucket(df, keys, time, [F.count(F.lit(1)).alias("_n")], {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    return _placed(rows.withColumn(out, (F.col("_before") + F.row_number().over(_inside(time, ties))).cast("long")), df, out)


def lead_values(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], value: str, out: str) -> DataFrame:
    """``lead(value)`` per group in the order of ``time`` and ``ties``; a next value that is null stays null."""
    # the time of the first row is the least one, without a look at the ties
    head = (F.struct(F.min(time).alias("v")) if value == time else F.min_by(F.struct(F.col(value).alias("v")), F.struct(time, *ties))).alias("_head")
    rows = _with_bucket(df, keys, time, [head], {"_next": F.lead("_head").over(_buckets(keys))})
    return _placed(rows.withColumn(out, F.coalesce(F.lead(F.struct(F.col(value).alias("v"))).over(_inside(time, ties)), F.col("_next"))["v"]), df, out)
