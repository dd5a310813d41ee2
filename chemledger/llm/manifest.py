"""Hash tree over sheets: leaves under a subroot a language, subroots under one root, with a proof for every sheet."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIELDS = ("sds_id", "relative_path", "language", "page_count", "text")
LEVELS = 9  # of the tree in one superblock, which has 512 nodes at most
BLOCK_KEYS = ["tree", "block"]
NODE = "tree long, left int, pos long, hash binary"
OUTER = "tree long, pos long, path binary, subroot binary, root binary"
LEFT, RIGHT, NONE = b"L", b"R", b"N"  # where a sibling stands; 32 bytes of digest follow


def leaf_of(values: list[Column]) -> Column:
    """The digest of a record: each value as ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``rows`` with ``slot``, their place from 0 in ascending order of ``by`` (nulls first), by a range partitioning whose places are written down."""
    order = [F.col(c).asc_nulls_first() for c in by]
    dealt = common.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("turn", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumns({"part": F.shiftright("turn", 33), "turn": F.col("turn").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition, in one task
    begins = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return dealt.join(F.broadcast(begins), "part").withColumn("slot", F.col("ahead") + F.col("turn")).drop("part", "turn", "ahead")


def _above(row: list[str]) -> list[str]:
    """The nodes over a row of nodes, as hex text: each pair, and a last lone one, hashed."""
    return [sha256("".join(row[i : i + 2]).encode()).hexdigest() for i in range(0, len(row), 2)]


def _sides(row: list[str]) -> list[bytes]:
    """For each node of a row its sibling and where that stands."""
    out = []
    for i in range(len(row)):
        other = i ^ 1
        out.append((LEFT if other < i else RIGHT) + bytes.fromhex(row[other]) if other < len(row) else NONE + bytes(32))
    return out


def _local(hashes: list[bytes], levels: int) -> tuple[list[bytes], str]:
    """The siblings of each node up to the top of its superblock, joined, and that top."""
    row, at = [h.hex() for h in hashes], list(range(len(hashes)))
    paths: list[list[bytes]] = [[] for _ in hashes]
    for _ in range(levels):
        sides = _sides(row)
        for path, i in zip(paths, at, strict=True):
            path.append(sides[i])
        row, at = _above(row), [i >> 1 for i in at]
    return [b"".join(p) for p in paths], row[0]


def _proof(path: bytes) -> str:
    return "".join(path[i + 1 : i + 33].hex() for i in range(0, len(path), 33) if path[i : i + 1] != NONE)


def _fold(digest: str, path: bytes) -> str:
    for i in range(0, len(path), 33):
        side, other = path[i : i + 1], path[i + 1 : i + 33].hex()
        digest = sha256((other + digest if side == LEFT else digest + other if side == RIGHT else digest).encode()).hexdigest()
    return digest


def reduced(nodes: DataFrame) -> DataFrame:
    """The node over each superblock of ``nodes`` (tree, left, pos, hash); ``left`` counts the levels still above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = [h.hex() for h in pdf.sort_values("pos")["hash"]]
        left = int(pdf["left"].iloc[0])
        levels = min(LEVELS, left)
        for _ in range(levels):
            row = _above(row)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "left": [left - levels], "pos": [int(pdf["pos"].iloc[0]) >> LEVELS], "hash": [bytes.fromhex(row[0])]})

    return nodes.select("tree", F.shiftright("pos", LEVELS).alias("block"), "left", "pos", "hash").groupBy(*BLOCK_KEYS).applyInPandas(run, NODE)


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The tiers of a forest: the nodes, and after each LEVELS levels the nodes over them, up to one node a tree."""
    tiers = [nodes]
    for _ in range(max(1, -(-depth // LEVELS))):
        tiers.append(common.written(reduced(tiers[-1].select("tree", "left", "pos", "hash")), "manifest-tier"))
    return tiers


def opened(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """What a proof needs beyond its own superblock, for each of ``nodes``: its siblings inside the superblock, then those of ``outer`` for the superblock."""

    def run(inner: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        if not len(inner):
            return pd.DataFrame({"tree": [], "pos": [], "path": [], "subroot": [], "root": []})
        inner = inner.sort_values("pos")
        paths, _ = _local(list(inner["hash"]), min(LEVELS, int(inner["left"].iloc[0])))
        top = over.iloc[0]
        return pd.DataFrame({"tree": inner["tree"], "pos": inner["pos"], "path": [p + top["path"] for p in paths], "subroot": [top["subroot"]] * len(inner), "root": [top["root"]] * len(inner)})

    return _met(nodes.select("tree", "left", "pos", "hash"), outer).applyInPandas(run, OUTER)


def _met(nodes: DataFrame, outer: DataFrame):
    """Nodes and the outer nodes they need, cogrouped by superblock."""
    inner = nodes.withColumn("block", F.shiftright("pos", LEVELS))
    return inner.groupBy(*BLOCK_KEYS).cogroup(outer.withColumnRenamed("pos", "block").groupBy(*BLOCK_KEYS))


def _depth(n: Column) -> Column:
    """Levels over n nodes: how often they halve until one is left."""
    return F.length(F.regexp_replace(F.bin(n - 1), "^0$", "")).cast("int")


def manifest(sds: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "sds_id", group: str = "language", received: dict[str, Column] | None = None) -> DataFrame:
    """A proof for every sheet: ``key``, ``group``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root`` and ``verified``, digests as hex text.

    ``sds``: sds_id, relative_path, language, page_count, text, of any types that cast to string. The digest of a sheet's ``fields`` is its leaf. Under each
    ``group`` leaves ascend by ``key`` (rows of one key by leaf) and every two nodes get one over them, level by level, a last lone one too, until one is left,
    the subroot. Subroots, ordered by group, get the root likewise. ``proof`` is the siblings on the way from leaf to root, 64 characters each.
    ``received`` gives fields as another party holds them: where the digest of such a record differs from the leaf, ``folded_root`` starts from it. It is
    always computed anew from the proof, and ``verified`` tells whether it is the root.

    Leaves of 512 places make a superblock. Superblocks are reduced to one node each, those again, until one a group is left. Then the siblings outside a
    superblock go down the same tiers, and leaves and outer nodes of a superblock are cogrouped: it is reduced, its proofs are joined and folded there.

    Nulls are values: a null group is a group, the first, and a null key comes first. Null fields differ from empty ones. Repeated rows are leaves of their
    own. Other columns are ignored. No rows in, no rows out.
    """
    kinds = dict(sds.dtypes)
    held = received or {}
    source = sds.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("group"), leaf_of([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        leaf_of([held.get(c, F.col(f"`{c}`")) for c in fields]).alias("received"))
    leaves = common.written(source.withColumn("received", F.expr("nullif(received, leaf)")), "manifest-leaves").withColumn("tie", F.monotonically_increasing_id())
    # equal rows may stand in any order among themselves, so a tie-break by place spreads them over partitions
    placed = common.written(ranked(leaves, ["group", "key", "leaf", "received", "tie"], "manifest-order").drop("tie"), "manifest-places")
    trees = common.written(ranked(placed.groupBy("group").agg(F.min("slot").alias("begin"), F.count(F.lit(1)).alias("n")), ["group"], "manifest-groups"), "manifest-trees")
    size = trees.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("trees")).first()
    own = trees.select(F.col("group").alias("of"), "begin", _depth(F.col("n")).alias("left"), F.col("slot").alias("tree"))
    nodes = placed.join(own, F.col("group").eqNullSafe(F.col("of"))).select("tree", "left", (F.col("slot") - F.col("begin")).alias("pos"), F.col("leaf").alias("hash"), "received", F.col("key").cast("string").alias("key"), "group")
    nodes = common.written(nodes, "manifest-nodes")
    tiers = climbed(nodes, ((size["n"] or 1) - 1).bit_length())
    subroots = tiers[-1]
    upper = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit((size["trees"] - 1).bit_length() if size["trees"] else 0).alias("left"), F.col("tree").alias("pos"), "hash"), (max(size["trees"], 1) - 1).bit_length())
    outer = upper[-1].select("tree", "pos", F.lit(b"").alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    for tier in reversed(upper[:-1]):
        outer = common.written(opened(tier, outer), "manifest-outer")
    outer = outer.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root").join(subroots.select("tree", F.col("hash").alias("subroot")), "tree").select("tree", "pos", "path", "subroot", "root")
    for tier in reversed(tiers[1:-1]):
        outer = common.written(opened(tier, outer), "manifest-outer")

    def run(inner: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        paths, _ = _local(list(inner["hash"]), min(LEVELS, int(inner["left"].iloc[0])))
        top = over.iloc[0]
        paths, root = [p + top["path"] for p in paths], top["root"].hex()
        folded = [_fold((r or h).hex(), p) for h, r, p in zip(inner["hash"], inner["received"], paths, strict=True)]
        return pd.DataFrame({
            "key": inner["key"], "group": inner["group"], "leaf": [h.hex() for h in inner["hash"]], "subroot": top["subroot"].hex(), "root": root, "proof": [_proof(p) for p in paths],
            "folded_root": folded, "verified": [f == root for f in folded]})

    out = _met(nodes, outer).applyInPandas(run, "key string, group string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    return out.select(F.col("key").cast(kinds[key]).alias(key), F.col("group").alias(group), "leaf", "subroot", "root", "proof", "folded_root", "verified")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, with one more in ``n_chars`` of the documents whose id's CRC-32 divides by 7."""
    docs = common.table(spark, sf_dir, "documents")
    sds = docs.select(F.col("doc_id").cast("long").alias("sds_id"), F.col("source").alias("relative_path"), F.col("lang").alias("language"), F.col("n_chars").alias("page_count"), "text")
    touched = F.crc32(F.col("sds_id").cast("string")) % 7 == 0
    received = {"page_count": F.when(touched, F.col("page_count").cast("long") + 1).otherwise(F.col("page_count").cast("long"))}
    out = manifest(sds, received=received)
    return out.select(F.col("sds_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
