"""How far rows are dealt before work that costs far more than reading them."""

from __future__ import annotations

from pyspark.sql import SparkSession

TURNS = 4


def partitions(spark: SparkSession) -> int:
    """TURNS for each core, or that part of what shuffles have, if that is more.

    A table of few bytes is read as one or two partitions whatever its rows cost, and a shuffle sized by bytes joins partitions again; one of a given number stays. Not as
    many as shuffles have: a task opens a file for each partition of the next shuffle, so all against all cost more than the work of a small table.
    """
    return max(TURNS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // TURNS)


def sorted_partitions(spark: SparkSession) -> int:
    """As ``partitions``, but at least as many as shuffles have: for rows that are sorted, whose bytes say little of the memory that takes."""
    return max(partitions(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
