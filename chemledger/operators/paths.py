"""Relative-path safety and file availability, decided from a listing instead of per-row file calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted decision-evidence suffixes.
EVIDENCE_SUFFIXES = (".msg", ".pdf", ".jpg", ".jpeg", ".png")

_ROOTED = r"^([A-Za-z]:|[/\\])"


def _posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def canonical_path(path: Column) -> Column:
    """Forward slashes, no repeated slash, no ``.`` parts."""
    text = F.regexp_replace(_posix(path), r"/+", "/")
    return F.regexp_replace(F.regexp_replace(text, r"(?<=^|/)(\./)+", ""), r"/\.?$", "")


def resolved(path: Column) -> Column:
    """The parts of a path with ``.`` and ``..`` resolved as text, or null where it leaves its root."""
    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def has_parent_step(path: Column) -> Column:
    return _posix(path).rlike(r"(^|/)\.\.(/|$)")


def document_path_rejected(path: Column) -> Column:
    """True for a path that can never name a file below the document root."""
    return (path.isNull() | (path == "") | F.contains(path, F.lit("\u0000")) | path.rlike(_ROOTED)
            | has_parent_step(path))


def evidence_path_rejected(path: Column) -> Column:
    parts = F.split(_posix(path), "/", -1)
    bad_part = F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains(":"))
    return path.isNull() | (path == "") | F.contains(path, F.lit("\u0000")) | path.rlike(_ROOTED) | bad_part | ~suffix(path).isin(*EVIDENCE_SUFFIXES)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is not an extension."""
    name = F.regexp_extract(_posix(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def _join_key(usable: Column, path: str, spread: str) -> Column:
    """Rows without a usable path get a key of their own, so that they do not pile up on one null key."""
    return F.when(usable, canonical_path(F.col(path))).otherwise(F.concat(F.lit("\u0000"), F.col(spread).cast("string")))


def listing_sizes(listing: DataFrame) -> DataFrame:
    return listing.groupBy(canonical_path(F.col("relative_path")).alias("_listed")).agg(F.max("length").alias("_size"))


def with_availability(rows: DataFrame, listing: DataFrame, path: str, present: Column, out: str, kind: str,
                      spread: str = "product_id", root_present: bool = True) -> DataFrame:
    """Add AVAILABLE / MISSING / CHECK_FAILED, or null where ``present`` is false. ``listing`` is that of the one root the paths are in; where the root itself
    is absent every check fails."""
    rejected = document_path_rejected(F.col(path)) if kind == "document" else evidence_path_rejected(F.col(path))
    unusable = F.col("_size") == 0 if kind == "evidence" else F.lit(False)
    sizes = listing_sizes(listing)
    usable = present & F.coalesce(~rejected, F.lit(False))
    joined = rows.withColumn("_wanted", _join_key(usable, path, spread)).join(
        sizes, F.col("_wanted") == F.col("_listed"), "left")
    status = (F.when(~present, F.lit(None).cast("string"))
              .when(rejected | F.lit(not root_present), "CHECK_FAILED")
              .when(F.col("_size").isNull(), "MISSING")
              .when(unusable, "CHECK_FAILED")
              .otherwise("AVAILABLE"))
    return joined.withColumn(out, status).drop("_wanted", "_listed", "_size")


def with_file_present(rows: DataFrame, listing: DataFrame, path: str, out: str, spread: str = "product_id") -> DataFrame:
    """Plain boolean used by the supervisory list: a path that leaves its root is not available, a ``..`` that stays inside is resolved, and backslashes are
    ordinary characters."""
    usable = F.coalesce((F.col(path) != "") & ~F.startswith(F.col(path), F.lit("/")) & (resolved(F.col(path)) != ""), F.lit(False))
    sizes = listing.select(resolved(F.col("relative_path")).alias("_listed")).distinct()
    spread_key = F.concat(F.lit("\u0000"), F.col(spread).cast("string"))
    joined = rows.withColumn("_wanted", F.when(usable, resolved(F.col(path))).otherwise(spread_key)).join(
        sizes, F.col("_wanted") == F.col("_listed"), "left")
    return joined.withColumn(out, F.col("_listed").isNotNull()).drop("_wanted", "_listed")
