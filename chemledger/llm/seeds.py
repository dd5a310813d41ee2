"""Substring dedup by words: seeds on winnowed anchors, extension both ways, maximal repeats over a length threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

WINDOW, SEED = 20, 8


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows: (position, key, first window, last window), where a window's anchor is its rightmost seed of least hash.

    Equal windows have equal anchors at equal offsets, and every window has exactly one.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, np.zeros(0, np.uint64), none, none
    runs, wide = text.runs(hashes, seed), window - seed + 1
    start = np.flatnonzero(text.whole(doc, window))
    if not len(start):
        return none, np.zeros(0, np.uint64), none, none
    at = start + wide - 1 - np.argmin(sliding_window_view(runs, wide)[:, ::-1], axis=1)[start]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], runs[at[first]], start[first], start[last]


def _anchors(texts: list[bytes], window: int, seed: int) -> tuple[text.Words, np.ndarray, tuple]:
    w = text.words(texts)
    h = text.word_hashes(w)
    return w, h, winnow(h, w.doc, window, seed)


def anchor_keys(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The key of every anchor of every sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_anchors(texts, window, seed)[2][1].view(np.int64))], ["key"])

    return sds.select("text").mapInArrow(run, "key long")


def anchors(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Every anchor of every sheet: ``key``, ``around`` (hash of all its windows' words), ``sds_id``, ``low`` (its first window's word) and ``n`` windows."""
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            w, h, (at, key, low, high) = _anchors(texts, window, seed)
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * text.powers(len(h)), out=sums[1:])
            shape = ((at - low) * window + high - low).astype(np.uint64)
            around = common.mix64(text.spans(sums, low, high + window) + shape * np.uint64(common.BASE))
            doc = w.doc[low]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array((low - w.first[doc]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32))], ["key", "around", "sds_id", "low", "n"])

    return sds.select("sds_id", "text").mapInArrow(run, f"key long, around long, sds_id {kind}, low int, n int")


def fetched(sds: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sheets that ``wanted`` names (one row for each sds_id), with its columns. A runtime Bloom filter, which is of bounded size, keeps most other texts from moving."""
    conf = sds.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1GB")
    return sds.select("sds_id", "text").join(wanted, "sds_id")


def contexts(sds: DataFrame, wanted: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The words (as hashes) of the wanted anchors: ``key``, ``sds_id``, ``low``, ``n``, ``at`` (words before the seed) and ``words``.

    ``wanted``: sds_id and ``lows``, the first windows of the anchors in that sheet.
    """
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            w, h, (at, key, low, high) = _anchors(texts, window, seed)
            lists = rows.column(2)
            want = lists.flatten().to_numpy() + np.repeat(w.first[:-1], lists.value_lengths().to_numpy())
            pick = np.flatnonzero(np.isin(low, want))
            size = high[pick] - low[pick] + window
            flat = h[np.arange(int(size.sum())) + np.repeat(low[pick] - (np.cumsum(size) - size), size)].view(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            doc = w.doc[low[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array((low[pick] - w.first[doc]).astype(np.int32)), pa.array((high - low + 1)[pick].astype(np.int32)), pa.array((at - low)[pick].astype(np.int32)), words], ["key", "sds_id", "low", "n", "at", "words"])

    return fetched(sds, wanted).select("sds_id", "text", "lows").mapInArrow(run, f"key long, sds_id {kind}, low int, n int, at int, words array<long>")


def extended(pairs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Each anchor against its key's first holder: how far the two agree to the left and right of the seed.

    Returns ``sds_id``, ``start``, ``stop``: the windows first to last (in words) that both hold, and ``rest``, structs of (hash, word) of the anchor's
    other windows, which only other holders may have (none where the key has just these two).
    """
    kind = dict(pairs.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            low, n, at, lead_at, kinds = (col[f].to_numpy() for f in ("low", "n", "at", "lead_at", "kinds"))
            flat = lambda c: (c.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]))
            (own, o), (lead, k) = flat(col["words"]), flat(col["lead_words"])

            def agree(step: int) -> np.ndarray:
                """Words that agree with the leader's, outward from the seed."""
                edge = (o[:-1] + at + (seed if step > 0 else -1), k[:-1] + lead_at + (seed if step > 0 else -1))
                room = np.minimum(o[1:] - edge[0], k[1:] - edge[1]) if step > 0 else np.minimum(at, lead_at)
                out, on = np.zeros(len(at), np.int64), room > 0
                for d in range(int(room.max(initial=0))):
                    on &= d < room
                    i = np.flatnonzero(on)
                    same = own[edge[0][i] + step * d] == lead[edge[1][i] + step * d]
                    on[i] = same
                    out[i] += same
                return out

            left, right = agree(-1), agree(1)
            first = at - left
            last = np.minimum(at + seed + right - window, n - 1)
            shared = last >= first
            hashes = text.runs(own, window)
            rest = [[(int(v), int(low[i]) + x) for x, v in enumerate(hashes[o[i] : o[i] + n[i]].view(np.int64).tolist()) if not (shared[i] and first[i] <= x <= last[i])] if kinds[i] > 2 else [] for i in range(len(at))]
            rows = pa.array([[{"hash": v, "word": x} for v, x in r] for r in rest], pa.list_(pa.struct([("hash", pa.int64()), ("word", pa.int32())])))
            yield pa.RecordBatch.from_arrays([col["sds_id"], pa.array(np.where(shared, low + first, 0).astype(np.int32)), pa.array(np.where(shared, low + last, -1).astype(np.int32)), rows], ["sds_id", "start", "stop", "rest"])

    return pairs.select("sds_id", "low", "n", "at", "words", "lead_at", "lead_words", "kinds").mapInArrow(run, f"sds_id {kind}, start int, stop int, rest array<struct<hash:long,word:int>>")


def repeated_words(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The windows of ``window`` words that also start earlier: ``sds_id``, ``start``, ``stop`` (first and last window of a run, by their first word).

    1. Anchors whose key occurs once are dropped: their windows occur once. 2. Anchors that agree with an earlier one in all their words repeat as a
    whole. 3. Of what is left, one anchor for each differing surrounding, the first holder of a key leads, and the others are extended against it both
    ways. 4. Windows beyond that extension are held against those of other holders by hash. Every step is an aggregate or a join whose hot keys Spark
    can split; no step pairs the holders of a key with each other.
    """
    keys = common.written(anchor_keys(sds, window, seed).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "seed-keys")
    live = common.written(anchors(sds, window, seed).join(keys, "key"), "seeds")
    around = common.written(live.groupBy("key", "around").agg(F.min(F.struct("sds_id", "low")).alias("first"), F.count(F.lit(1)).alias("times")), "surroundings")
    again = live.join(around.where("times > 1"), ["key", "around"]).where(F.struct("sds_id", "low") > F.col("first")).select("sds_id", F.col("low").alias("start"), (F.col("low") + F.col("n") - 1).alias("stop"))
    several = common.written(around.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "branching")
    branch = common.written(around.join(several, "key").select("key", "first.sds_id", "first.low", "kinds"), "branches")
    wanted = common.written(branch.groupBy("sds_id").agg(F.collect_set("low").alias("lows")), "branch-sheets").where(F.size("lows") > 0)
    held = common.written(contexts(sds, wanted, window, seed).join(several, "key"), "contexts")
    lead = common.written(held.groupBy("key").agg(F.min(F.struct("sds_id", "low", "at", "words")).alias("lead")), "leaders")
    pairs = held.join(lead, "key").where(F.struct("sds_id", "low") > F.struct("lead.sds_id", "lead.low")).select("sds_id", "low", "n", "at", "words", "kinds", F.col("lead.at").alias("lead_at"), F.col("lead.words").alias("lead_words"))
    met = common.written(extended(pairs, window, seed), "extended")
    loose = common.written(met.select("sds_id", F.explode("rest").alias("w")).select(F.col("w.hash").alias("hash"), "sds_id", F.col("w.word").alias("word")), "loose")
    origin = common.written(loose.groupBy("hash").agg(F.min(F.struct("sds_id", "word")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "loose-first")
    late = loose.join(origin, "hash").where(F.struct("sds_id", "word") > F.col("first")).select("sds_id", F.col("word").alias("start"), F.col("word").alias("stop"))
    return again.unionByName(met.where("stop >= start").select("sds_id", "start", "stop")).unionByName(late)


def dedup_words(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Remove every word that a window of ``window`` words covers which also starts earlier (smaller ``sds_id``, or the same sheet, earlier word).

    ``sds``: sds_id (the sheet's key), text string. Words are the runs of characters other than blanks and the controls 0x09 to 0x0D. Returns ``sds_id``,
    ``n_words``, ``n_removed``, and ``kept`` (the words left, joined by one blank). Windows are judged on the input. Null texts have no words. Sheets of
    fewer than ``window`` words lose nothing. Rows that repeat an ``sds_id`` are taken for the same sheet: they are reported each, and no source of repeats
    for each other. Null ``sds_id`` loses nothing. Other columns are ignored. No rows in, no rows out.
    """
    kind = dict(sds.dtypes)["sds_id"]
    spans = repeated_words(sds, window, seed).groupBy("sds_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = common.written(spans, "word-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            total, gone, kept = [], [], []
            lists = rows.column(2)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            start, stop = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            for i, t in enumerate(texts):
                words = t.split()  # for bytes these are the blanks and controls named above
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[at[i] : at[i + 1]], 1)
                np.add.at(edge, stop[at[i] : at[i + 1]] + window, -1)
                drop = np.cumsum(edge)[:-1] > 0
                total.append(len(words))
                gone.append(int(drop.sum()))
                kept.append(b" ".join([words[j] for j in np.flatnonzero(~drop)] if gone[-1] else words))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["sds_id", "n_words", "n_removed", "kept"])

    return sds.select("sds_id", "text").join(spans, "sds_id", "left").select("sds_id", "text", "spans").mapInArrow(cut, f"sds_id {kind}, n_words long, n_removed long, kept string")


def op5_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level dedup of every whole text of ``documents``."""
    out = dedup_words(common.sds_texts(common.table(spark, sf_dir, "documents")))
    return out.select(F.col("sds_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
