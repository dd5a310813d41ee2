"""Near duplicates of sheet texts by fingerprint: SimHash of word shingles, meet-in-the-middle search of near fingerprints, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text
from .neardup import components

SHINGLE, SEED, RADIUS = 3, 42, 3
HALF = (RADIUS + 1) // 2
VARIANTS = 6_000_000  # of fingerprints in one bucket; a bucket of more is dealt again by more bits
STEP = 8  # bits by which it is dealt again
BLOCK = 1 << 20  # variants held at once inside a task
PART = 1 << 20  # bytes of a text whose words are held at once
_blank = re.compile(rb"[\x20\x09-\x0D]")

# for each byte a row of eight counters, one a bit, in the lanes of a 64-bit word
_LANES = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).view(np.uint64).ravel()


def shingle_hashes(whole_text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of every run of SHINGLE lower-case words, repeats included, or of all words where there are fewer; a long text comes in several parts."""
    at, last, any_run = 0, [], False
    while at < len(whole_text):
        cut = _blank.search(whole_text, at + PART)
        end = cut.start() if cut else len(whole_text)
        words = last + whole_text[at:end].lower().split()
        at, last = end, words[1 - SHINGLE :]
        if len(words) >= SHINGLE:
            any_run = True
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            stop = np.cumsum(size + 1) - 1
            begin = (stop - size)[: len(words) - SHINGLE + 1].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, stop[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(begin))
    if last and not any_run:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def bit_counts(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes (none is empty) how many have each of the 64 bits."""
    parts = -(-sizes // 255)  # a lane counts to 255
    before = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    some = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(len(begin), 64).astype(np.int64)
    return np.add.reduceat(some, before, axis=0)


def majority(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text: the bits that are set in over half of its hashes. Texts without words get zero."""
    count, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        if held:
            of, sizes = np.array([t for t, _ in held]), np.array([len(h) for _, h in held])
            np.add.at(count, of, bit_counts(sizes, np.concatenate([h for _, h in held])))
            np.add.at(total, of, sizes)
            held.clear()

    for t, one in enumerate(texts):
        for part in shingle_hashes(one):
            held.append((t, part))
            if len(part) > PART // 64 or len(held) >= 256:
                add()
    add()
    return np.packbits(2 * count > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(sds: DataFrame) -> DataFrame:
    """``sds_id`` and ``fingerprint`` (64 bits as a long) of every sheet."""
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(majority(texts).view(np.int64))], ["sds_id", "fingerprint"])

    return sds.select("sds_id", "text").mapInArrow(run, f"sds_id {kind}, fingerprint long")


def masks(bits: int, most: int, offset: int = 0) -> list[int]:
    """All words of at most ``most`` set bits among ``bits`` bits, those from ``offset`` on; fewer set bits first."""
    return [sum(1 << (offset + i) for i in at) for n in range(most + 1) for at in combinations(range(bits), n)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def dealt(prints: DataFrame, bits: int) -> DataFrame:
    """Every fingerprint once for each way in which a variant of it can begin: ``bucket``, the variant's leading ``bits``, and ``fingerprint``."""
    flips = F.array(*[F.lit(_signed(m)) for m in masks(bits, HALF, 64 - bits)])
    rows = prints.select("fingerprint", F.explode(flips).alias("flip"))
    return rows.select(F.shiftrightunsigned(F.col("fingerprint").bitwiseXOR(F.col("flip")), 64 - bits).alias("bucket"), "fingerprint")


def dealt_again(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """Rows (bucket of ``bits``, fingerprint) once for each way in which their variants can go on for ``more`` bits."""
    lead = F.shiftrightunsigned(F.shiftleft("fingerprint", bits), 64 - more) if bits else F.shiftrightunsigned("fingerprint", 64 - more)
    used = _used(bits)
    ways = F.when(used == 0, F.array(*[F.lit(m) for m in masks(more, HALF)]))
    for n in range(1, HALF + 1):
        ways = ways.when(used == n, F.array(*[F.lit(m) for m in masks(more, HALF - n)]))
    return rows.select("fingerprint", F.col("bucket").alias("old"), lead.alias("lead"), F.explode(ways).alias("flip")).select(F.shiftleft("old", more).bitwiseOR(F.col("lead").bitwiseXOR(F.col("flip"))).alias("bucket"), "fingerprint")


def _used(bits: int) -> Column:
    """How many bits the bucket's beginning differs in from the fingerprint's own."""
    return F.bit_count(F.shiftrightunsigned("fingerprint", 64 - bits).bitwiseXOR(F.col("bucket")))


def _size(bits: int) -> Column:
    """How many variants of a fingerprint begin with its bucket."""
    out, used = F.lit(1), _used(bits)
    for n in range(HALF):
        out = F.when(used == n, len(masks(64 - bits, HALF - n))).otherwise(out)
    return out


def joined_classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``n`` nodes, by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _near_and_far(low: np.ndarray, used: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The variants of fingerprints inside one bucket, by their last ``bits``: those at most RADIUS - HALF bits away with their fingerprint, and those further away in blocks.

    ``used``: in how many bits the fingerprint differs from the bucket's beginning.
    """
    near, owner, far = [], [], []
    for n in range(HALF + 1):
        at = np.flatnonzero(used == n)
        every = masks(bits, HALF - n)
        close = np.array([m for m in every if n + m.bit_count() <= RADIUS - HALF], np.uint64)
        near.append((low[at][:, None] ^ close[None, :]).ravel())
        owner.append(np.repeat(at, len(close)))
        far.append((at, np.array([m for m in every if n + m.bit_count() > RADIUS - HALF], np.uint64)))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, flips in far:
            if len(flips):
                for i in range(0, len(at), max(1, BLOCK // len(flips))):
                    part = at[i : i + max(1, BLOCK // len(flips))]
                    yield (low[part][:, None] ^ flips[None, :]).ravel(), np.repeat(part, len(flips))

    return np.concatenate(near), np.concatenate(owner), blocks()


def colliding(prints: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) by index between distinct ``prints`` that share a variant in the bucket and are at most RADIUS bits apart.

    Two prints this near share a variant that lies within RADIUS - HALF bits of one and within HALF bits of the other. So of all variants only those are
    looked up that are also so near to some print, and everything that meets there is linked to the first such print, which is a link by itself.
    """
    rest = 64 - bits
    mask = np.uint64((1 << rest) - 1)
    low = prints & mask
    used = np.bitwise_count((prints >> np.uint64(rest)) ^ np.uint64(bucket & (2**64 - 1))) if bits else np.zeros(len(prints), np.uint8)
    near, owner, blocks = _near_and_far(low, used.astype(np.int64), rest)
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((owner, near))
    near, owner = near[order], owner[order]
    new = np.append(True, near[1:] != near[:-1])
    head = owner[new][np.cumsum(new) - 1]
    key, lead = near[new], owner[new]
    a, b = [owner[head != owner]], [head[head != owner]]
    shift = np.uint64(64 - max(10, int(len(key) * 16).bit_length()))
    slot = lambda v: (v * np.uint64(common.BASE)) >> shift
    seen = np.zeros(1 << (64 - int(shift)), bool)
    seen[slot(key)] = True
    for values, of in blocks:
        hit = np.flatnonzero(seen[slot(values)])
        values, of = values[hit], of[hit]
        at = np.minimum(np.searchsorted(key, values), len(key) - 1)
        met = (key[at] == values) & (lead[at] != of)
        a.append(of[met])
        b.append(lead[at[met]])
    a, b = np.concatenate(a), np.concatenate(b)
    pair = np.unique(a * np.int64(len(prints)) + b)
    a, b = pair // len(prints), pair % len(prints)
    true = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
    return a[true], b[true]


def linked(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between fingerprints of a bucket, one for each that is not the least of its component there. ``rows``: bucket of ``bits``, fingerprint."""

    def run(group: pa.Table) -> pa.Table:
        prints = np.unique(group.column("fingerprint").to_numpy().view(np.uint64))
        a, b = colliding(prints, int(group.column("bucket")[0].as_py()), bits)
        root = joined_classes(len(prints), a, b)
        other = np.flatnonzero(root != np.arange(len(prints)))
        return pa.table({"a": prints[other].view(np.int64), "b": prints[root[other]].view(np.int64)})

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_prints(prints: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """Links (a, b) that connect all distinct ``prints`` (fingerprint long) which chains of steps of at most RADIUS bits connect.

    Every fingerprint stands for all its variants, the words within half the radius, rounded up, which shuffle by their leading bits, as many as the count of
    fingerprints asks for. A bucket of over ``variants`` is dealt again by STEP more bits, in the end by all 64, where at most 2,081 fingerprints share one.
    """
    n = prints.count()
    bits = next(b for b in range(1, 65) if n * len(masks(64, HALF)) <= (variants / 4) * (1 << b) or b == 24)
    rows, out = common.written(dealt(prints, bits), "variants"), []
    while True:
        size = rows.groupBy("bucket").agg(F.sum(_size(bits)).alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        sizes = common.written(size.select("bucket", (F.col("n") > variants).alias("again")), "variant-buckets")
        met = rows.join(sizes, "bucket")
        out.append(common.written(linked(met.where("not again").select("bucket", "fingerprint"), bits), "print-links"))
        if bits >= 64 or sizes.where("again").isEmpty():
            break
        more = min(STEP, 64 - bits)
        rows, bits = common.written(dealt_again(met.where("again").select("bucket", "fingerprint"), bits, more), "variants"), bits + more
    links = out[0]
    for more_links in out[1:]:
        links = links.unionByName(more_links)
    return links.distinct()


def components_of_prints(sds: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """The near-duplicate component of every sheet: ``sds_id``, ``fingerprint`` (long) and ``component_id``, the least ``sds_id`` that links reach.

    ``sds``: sds_id, text string. A to Z are lower-cased, words are what the blanks and controls 0x09 to 0x0D separate, shingles are runs of three words (a
    text of fewer is one shingle), repeats included. A bit of the fingerprint is set if over half of the shingles' XXH64 hashes have it. Sheets whose
    fingerprints differ in three bits or fewer are linked.

    Null texts count as empty; texts without words have fingerprint zero and are linked as any other. Equal texts have equal fingerprints, so each distinct
    fingerprint is searched once, however many sheets have it. Repeated rows stay. A null ``sds_id`` is never a component's least unless all are null. Other
    columns are ignored. No rows in, no rows out.
    """
    rows = common.written(fingerprints(sds), "fingerprints")
    prints = common.written(rows.groupBy("fingerprint").agg(F.min("sds_id").alias("least")), "prints")
    roots = components(near_prints(prints.select("fingerprint"), variants))
    named = common.written(prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "print-roots")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(first, "root").select("fingerprint", "component_id"), "fingerprint").select("sds_id", "fingerprint", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near fingerprints of ``documents``."""
    found = components_of_prints(common.sds_texts(common.table(spark, sf_dir, "documents")))
    return found.select(F.col("sds_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
