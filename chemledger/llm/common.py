"""Helpers shared by the training-data operators: table reading, shared folders and text hashing."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it by their own path. Once for each Spark context."""
    home = Path(__file__).resolve().parents[2]
    found = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()] if p}
    if home in found or (spark.sparkContext.master.startswith("local") and Path.cwd() == home):
        return
    name = f"chemledger-{spark.sparkContext.applicationId}.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = Path(tempfile.mkdtemp(prefix="sds-package-")) / name
    with zipfile.ZipFile(path, "w") as out:
        for module in (home / "chemledger").rglob("*.py"):
            out.write(module, module.relative_to(home))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read through Spark so that any path Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sds_texts(docs: DataFrame) -> DataFrame:
    """The ``documents`` rows as sheet texts: ``sds_id`` and ``text``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("sds_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one of our own where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sds-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to a fresh table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown in doublings."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _POWERS[base] = have = out
    return have[:n]
