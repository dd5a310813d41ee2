"""Files as DataFrames: listings, fingerprints, evidence, manifests, rule catalogues and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemledger import schemas
from chemledger.operators.paths import EVIDENCE_SUFFIXES, suffix

PDF_HEAD = "255044462D"  # the bytes "%PDF-" that a PDF begins with


def registry_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One registry table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files under a root with their paths below it; contents are not read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", rf"^(?:\w+:/{{1,3}})?.*?\Q{root.rstrip('/').split('://')[-1]}\E/", "")
    return files.withColumn("relative_path", below)


def list_pdfs(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of the PDF files under a root, sorted. Spark's reader leaves out files without a byte."""
    return _listed(spark, root, "*.pdf").select("relative_path", "length").orderBy("relative_path")


def list_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of decision evidence: accepted suffixes, not empty."""
    files = _listed(spark, root, "*").select("relative_path", "length")
    return files.where(suffix(F.col("relative_path")).isin(*EVIDENCE_SUFFIXES) & (F.col("length") > 0)).orderBy("relative_path")


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file under a root, and whether it begins as a PDF does."""
    files = _listed(spark, root, "*")
    return files.select("relative_path", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.unhex(F.lit(PDF_HEAD))).alias("is_pdf"))


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    kept = schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema
    return spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def evidence_files(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents, one row for each file; a file that is no JSON keeps a row with its text in ``_corrupt``."""
    from pyspark.sql import types as T

    return _json(spark, path, T.StructType(list(schemas.EVIDENCE.fields))).withColumn("file_name", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))


def manifest(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """The files of a manifest with their position, which is the processing order; with ``ids`` only those."""
    from pyspark.sql import types as T

    rows = _json(spark, path, T.StructType(list(schemas.MANIFEST.fields))).select("batch", F.posexplode("files").alias("position", "file")).select("batch", "position", "file.*")
    return rows if ids is None else rows.where(F.col("id").isin(ids))


def rule_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a catalogue with what is wrong with each: a repeated id, a status or a role that is missing."""
    from pyspark.sql import types as T

    rows = _json(spark, path, T.StructType(list(schemas.RULE_CATALOGUE.fields))).select("schema", "schema_version", F.explode("aliases").alias("rule")).select("schema_version", "rule.*")
    twice = rows.groupBy("alias_id").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("n") > 1, "DUPLICATE_ID").when(~F.coalesce(F.col("status").isin("ACTIVE", "APPROVED", "CANDIDATE", "REJECTED"), F.lit(False)), "STATUS").when(F.coalesce("role", F.lit("")) == "", "ROLE")
    return rows.join(twice, "alias_id").withColumn("problem", problem).drop("n")


def decisions(spark: SparkSession, path: str, required: DataFrame) -> DataFrame:
    """Decided manifest ids, one row each, with OK, DUPLICATE, UNEXPECTED or, for required ids that no decision names, MISSING."""
    rows = spark.read.option("multiLine", True).schema("decisions array<struct<decision:string,source_manifest_ids:array<string>>>").json(path)
    given = rows.select(F.explode("decisions").alias("d")).select("d.decision", F.explode("d.source_manifest_ids").alias("manifest_id"))
    per = given.groupBy("manifest_id").agg(F.min("decision").alias("decision"), F.count(F.lit(1)).alias("n"))
    both = per.join(required.select("manifest_id").distinct().withColumn("required", F.lit(True)), "manifest_id", "full")
    return both.select("manifest_id", "decision", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "DUPLICATE").when(F.col("required").isNull(), "UNEXPECTED").otherwise("OK").alias("status"))


def write_evidence(drafts: DataFrame, validation: DataFrame, folder: str) -> None:
    """Evidence drafts whose gates all pass, and the validation of all, as JSON; nothing is written over.

    ``drafts``: source_id and the evidence columns. ``validation``: source_id, status (PASS or FAIL for each gate).
    """
    failed = validation.where("status = 'FAIL'").select("source_id").distinct()
    validation.write.mode("errorifexists").json(f"{folder}/validation")
    drafts.join(failed, "source_id", "left_anti").write.mode("errorifexists").json(f"{folder}/evidence")
