"""Sharding of sheets over a hierarchical weighted hash tree (region, rack, shard)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    """One shard: its number, the region and rack that hold it, and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, base: int = 40, racks: int = 2, per_rack: int = 5) -> list[Shard]:
    """The tree for a shard count: the first ``base`` shards fill regions of ``racks`` x ``per_rack`` shards; every later shard opens a region of its own.

    Since a later shard changes no weight inside an older subtree, growing by one moves sheets only into the new region, that is, into the new shard.
    """
    tree = [Shard(i, f"g{i // (racks * per_rack)}", f"k{i // per_rack}") for i in range(min(shards, base))]
    return tree + [Shard(i, f"n{i}", f"n{i}") for i in range(base, shards)]


def _child(of: str, children: dict[str, list[tuple[str, float]]], key: str) -> Column:
    """The label of the winning child of the node that column ``of`` names.

    Each child draws an exponential time with its weight as the rate, seeded by the key and the child's path: the least wins, with odds in proportion
    to the weights. Equal draws go to the smaller label.
    """
    nodes = F.create_map(*[x for node, kids in children.items() for x in (F.lit(node), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in kids]))])
    unit = lambda kid: (F.shiftrightunsigned(F.xxhash64(F.col(key), kid["c"]), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    draws = F.transform(F.element_at(nodes, F.col(of)), lambda kid: F.struct((-F.log(unit(kid)) / kid["w"]).alias("d"), kid["c"].alias("c")))
    return F.array_min(draws)["c"]


def descend(sds: DataFrame, tree: list[Shard], key: str, to: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` columns by three weighted draws, each among the children of the winner above."""
    if not tree:
        raise ValueError("a tree needs at least one shard")
    if any(s.weight <= 0 for s in tree):
        raise ValueError("weights must be positive")
    kids: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for level in range(3):
            below = kids[level].setdefault(path[level], {})
            below[path[level + 1]] = below.get(path[level + 1], 0.0) + s.weight
    root, region, rack, leaf = f"{to}root", f"{to}region", f"{to}rack", f"{to}leaf"
    out = sds.withColumn(root, F.lit(""))
    for of, name, level in ((root, region, 0), (region, rack, 1), (rack, leaf, 2)):
        out = out.withColumn(name, _child(of, {node: sorted(below.items()) for node, below in kids[level].items()}, key))
    return out.withColumn(f"{to}shard", F.substring_index(leaf, "/", -1).cast("int")).drop(root, leaf)


def shard_sds(sds: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Put every sheet into a shard by its ``sds_id`` alone (law ``key``) and number the sheets of each shard.

    ``sds``: ``sds_id`` long, ``text`` string. Returns sds_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, region, rack, shard,
    slot (gapless from 0 in each shard) and grown_shard (under ``grown``, else null). Slots are dealt in ``slot_buckets`` hash buckets per shard, so
    no task ever holds a whole shard; the offset table has at most shards x slot_buckets rows, which is why it may be broadcast.

    Null text: size 16, crc 0. Null ``sds_id``: one defined shard for all. Equal rows stay separate rows with slots of their own. Other columns are
    ignored. No rows in, no rows out.
    """
    own = sds.select("sds_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = descend(own, tree, "sds_id")
    if grown:
        placed = descend(placed, grown, "sds_id", "grown_").drop("grown_region", "grown_rack")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("sds_id", F.lit("slot")), F.lit(slot_buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("sds_id", "text_crc32", "size")
    rows = placed.withColumn("at", F.row_number().over(inside))
    return rows.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "sds_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")


def op3_shard(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All ``documents`` over shards 0 to 39, and over one shard more."""
    sds = common.sds_texts(common.table(spark, sf_dir, "documents"))
    return shard_sds(sds, topology(shards), topology(shards + 1)).withColumnRenamed("sds_id", "doc_id")
