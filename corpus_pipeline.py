"""Corpus pipeline over ``documents``: each stage calls one operator of ``chemledger.llm``.

Every stage works on all that the one before kept and returns the columns it was given, but for the last, which returns pieces. Null texts count as empty.
Extra columns pass through. An empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemledger.llm import common, decontaminate, neardup, pieces, quality, surrogates

SURROGATE_KEY = "sheet-surrogates-1"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.only_good(docs, quality.learnable(spark, sf_dir, "quality", 5, 0), key="doc_id")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.one_of_each(docs, key="doc_id")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; ``n_chars`` follows the new text."""
    rest = [c for c in docs.columns if c != "text"]
    sds = docs.select(F.col("doc_id").alias("sds_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    new = surrogates.surrogate_sds(sds, SURROGATE_KEY, keep="row")
    kinds = dict(docs.dtypes)
    column = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("text")}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("text").isNull(), column["n_chars"]).otherwise(F.length("text").cast(kinds["n_chars"]))
    return new.select(*[column[c].alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces."""
    out = pieces.encode_sds(common.sds_texts(docs), pieces.vocabulary())
    return out.select(F.col("sds_id").alias("doc_id"), "n_pieces", "exact", "pieces")


STAGES = [("quality classifier", good), ("near duplicates", distinct), ("decontamination", clean), ("personal data", private), ("pieces", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{k}")
    return docs
