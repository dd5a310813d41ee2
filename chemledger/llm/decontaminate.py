"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1  # two fingerprints within it differ by BLOCK_RADIUS bits at most in some block
BLOCK_ITEMS, WINDOWS_AT_ONCE = 20_000, 2_000

_part = np.ones(256, bool)
_part[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_near = np.array([sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in itertools.combinations(range(64 // BLOCKS), r)], np.int64)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, ASCII case folded), and each text's first word."""
    w = text.words(texts, _part)
    return text.spans(text.byte_sums(_lower[w.data]), w.start, w.end), w.first


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes: bit by bit the majority, where a shingle counts as often as it stands there."""
    out = np.empty(len(shingles), np.uint64)
    for at in range(0, len(shingles), WINDOWS_AT_ONCE):
        rows = np.ascontiguousarray(shingles[at : at + WINDOWS_AT_ONCE])
        bits = np.unpackbits(rows.view(np.uint8).reshape(*rows.shape, 8), axis=2)
        out[at : at + len(rows)] = np.packbits(bits.sum(1) * 2 > rows.shape[1], axis=1).view(np.uint64)[:, 0]
    return out


@dataclass
class Size:
    """The items of one length: their numbers, shingles with counts, fingerprints, and for each block and value the items within BLOCK_RADIUS."""

    length: int
    item: np.ndarray
    shingle: list[tuple[np.ndarray, np.ndarray]]
    print_: np.ndarray
    at: np.ndarray
    near: np.ndarray


class Index:
    """Benchmark items by length, and the set of all their shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.sizes: list[Size] = []
        every = [np.zeros(0, np.uint64)]
        for length in sorted({len(codes) for _, codes in items if len(codes)}):
            own = [(i, text.runs(codes, min(SHINGLE, length))) for i, codes in items if len(codes) == length]
            prints = simhash(np.array([s for _, s in own]))
            block, value, which = [], [], []
            for b in range(BLOCKS):
                v = (prints.view(np.uint8).reshape(-1, 8)[:, b].astype(np.int64)[:, None] ^ _near).ravel()
                block.append(np.full(len(v), b))
                value.append(v)
                which.append(np.repeat(np.arange(len(own)), len(_near)))
            key = np.concatenate(block) * 256 + np.concatenate(value)
            order = np.argsort(key, kind="stable")
            at = np.searchsorted(key[order], np.arange(BLOCKS * 256 + 1))
            self.sizes.append(Size(length, np.array([i for i, _ in own], np.int64), [np.unique(s, return_counts=True) for _, s in own], prints, at, np.concatenate(which)[order]))
            every += [s for _, s in own]
        self.known = np.unique(np.concatenate(every))
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.shortest = {k: min((s.length for s in self.sizes if min(SHINGLE, s.length) == k), default=0) for k in range(1, SHINGLE + 1)}

    def _hits(self, shingles: np.ndarray) -> np.ndarray:
        hit = self.coarse[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        some = np.flatnonzero(hit)
        at = np.minimum(np.searchsorted(self.known, shingles[some]), max(len(self.known) - 1, 0))
        hit[some] = self.known[at] == shingles[some] if len(self.known) else False
        return hit

    def matches(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, item, best similarity) for each text that holds an item-sized window of similarity SIMILARITY or more.

        A window is looked at only if so many of its shingles occur in items that it can be that similar at all.
        """
        for k in range(1, SHINGLE + 1):
            sizes = [s for s in self.sizes if min(SHINGLE, s.length) == k]
            if not sizes:
                continue
            shingles = text.runs(codes, k)
            hit = np.append(self._hits(shingles), np.zeros(len(codes) - len(shingles), bool))
            seen = np.concatenate([[0], np.cumsum(hit)])
            doc = np.flatnonzero(seen[first[1:]] - seen[first[:-1]] >= SIMILARITY * (self.shortest[k] - k + 1))
            doc = doc[first[doc + 1] - first[doc] >= k]
            for size in sizes:
                yield from self._windows(size, k, shingles, seen, first, doc)

    def _windows(self, size: Size, k: int, shingles: np.ndarray, seen: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float]]:
        own = np.minimum(first[doc + 1] - first[doc], size.length)  # a shorter text is one window as a whole
        count = first[doc + 1] - first[doc] - own + 1
        of = np.repeat(np.arange(len(doc)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[doc][of]
        wide = own[of] - k + 1
        good = seen[start + wide] - seen[start] >= SIMILARITY * (size.length - k + 1)
        of, start, wide = of[good], start[good], wide[good]
        for m in np.unique(wide):
            o, s = of[wide == m], start[wide == m]
            rows = shingles[s[:, None] + np.arange(m)]
            prints = simhash(rows)
            best: dict[tuple[int, int], float] = {}
            parts = prints.view(np.uint8).reshape(-1, BLOCKS).astype(np.int64) + np.arange(BLOCKS) * 256
            for r in range(len(s)):
                near = np.unique(np.concatenate([size.near[size.at[p] : size.at[p + 1]] for p in parts[r]]))
                for i in near[np.bitwise_count(size.print_[near] ^ prints[r]) <= RADIUS]:
                    value, n = size.shingle[i]
                    at = np.minimum(np.searchsorted(value, rows[r]), len(value) - 1)
                    both = np.minimum(np.bincount(at[value[at] == rows[r]], minlength=len(value)), n).sum()
                    alike = both / (m + n.sum() - both)
                    key = (int(doc[o[r]]), int(size.item[i]))
                    if alike >= SIMILARITY and alike > best.get(key, 0):
                        best[key] = float(alike)
            yield from ((d, i, x) for (d, i), x in best.items())


def _indexes(items: DataFrame, block_items: int) -> Iterator[Index]:
    """The items in blocks of about ``block_items``, so that no task or driver holds more, whatever their number."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        codes, first = word_codes([x.encode() for x in rows.column("text").to_pylist()])
        yield Index([(i, codes[first[k] : first[k + 1]]) for k, i in enumerate(rows.column("item_id").to_pylist())])


def benchmark_leaks(sds: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Which sheets hold which benchmark items: ``sds_id``, ``item_id``, ``similarity`` (of the best window), a row for each pair that is SIMILARITY alike.

    ``sds``: sds_id, text string. ``items``: item_id long, text string; the reference has no benchmark of its own, so any table of texts will do. Similarity
    is the weighted Jaccard index of the shingles of five words (all words where an item has fewer; case and punctuation aside). The items are held in
    blocks of about ``block_items``; each block is one pass over the sheets.

    Null or empty texts and items match nothing. Equal items match alike, each under its number; repeated sheets give repeated rows. Other columns are
    ignored. Without items or sheets there are no rows.
    """
    kind = dict(sds.dtypes)["sds_id"]
    out = None
    for index in _indexes(items, block_items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for own, texts in text.chunks(batches):
                found = sorted({(d, i): x for d, i, x in index.matches(*word_codes(texts))}.items()) if index.sizes else []
                ids = own.column(0).take(pa.array([d for (d, _), _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for (_, i), _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], ["sds_id", "item_id", "similarity"])

        part = sds.select("sds_id", "text").mapInArrow(run, f"sds_id {kind}, item_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(rows: DataFrame, items: DataFrame, text_column: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows whose text holds no item, by the measure of ``benchmark_leaks``, with all their columns. Rows do not move."""
    for index in _indexes(items, block_items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for own, texts in text.chunks(batches, text_column):
                keep = np.ones(len(texts), bool)
                keep[[d for d, _, _ in index.matches(*word_codes(texts))] if index.sizes else []] = False
                yield own.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` that hold ``benchmark`` items, as pairs."""
    sds = common.sds_texts(common.table(spark, sf_dir, "documents"))
    return benchmark_leaks(sds, common.table(spark, sf_dir, "benchmark")).withColumnRenamed("sds_id", "doc_id")
