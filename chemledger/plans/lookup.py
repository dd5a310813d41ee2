"""Joins to small tables whose keys own large shares of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(rows: DataFrame, small: DataFrame, key: str, of: str, take: dict[str, str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Add columns of ``small`` (one row for each ``of``) to rows by ``key``; every key is dealt over ``salts`` values of ``spread``.

    Null keys match nothing and get join keys of their own, so that they do not meet in one task; where only they are many, one salt will do.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("string")
    wanted = F.when(F.col(key).isNull(), F.concat(F.lit("\u0000"), F.coalesce(F.col(spread).cast("string"), F.lit("")))).otherwise(F.concat_ws("\u0001", F.col(key).cast("string"), salt))
    held = small.where(F.col(of).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col(of).alias("_of"), *[F.col(c).alias(n) for c, n in take.items()])
    held = held.withColumn("_key", F.concat_ws("\u0001", F.col("_of").cast("string"), F.col("_salt").cast("string"))).drop("_of", "_salt")
    return rows.withColumn("_wanted", wanted).join(held, F.col("_wanted") == F.col("_key"), how).drop("_wanted", "_key")


def with_unit(rows: DataFrame, units: DataFrame, key: str, out: str, how: str = "left", spread: Sequence[str] | str = "product_id") -> DataFrame:
    """The code of the unit that ``key`` names."""
    return salted_lookup(rows, units, key, "unit_id", {"code": out}, spread if isinstance(spread, str) else spread[0], how)
