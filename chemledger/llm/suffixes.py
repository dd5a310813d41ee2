"""Substring dedup by bytes over a sparse suffix array: range-partitioned suffixes, multikey quicksort in each bucket, comparison across buckets.

A suffix is taken at every anchor. Anchors are chosen by content, so that equal windows have equal anchors at equal offsets; the windows of an anchor are
then told apart by how far suffixes (and the bytes before them) of neighbours in sorted order agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, text
from .seeds import fetched

WINDOW, SEED, BUCKET_ROWS, SMALL = 200, 64, 40_000, 24
_POSITION_BITS = 28


def anchored(data: np.ndarray, at: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of joined texts: (position, first window, last window), windows by their first byte.

    A window's anchor is, of the places where a seed fits into it, the one whose next eight bytes hash least, the rightmost of equals. Longer texts than a
    position has bits for are read in parts that share window - 1 bytes; windows of one anchor that a cut divides are put together again.
    """
    if len(data) < 1 << _POSITION_BITS:
        return _anchored(data, at, window, seed)
    step, parts = (1 << _POSITION_BITS) - window - 1, []
    for begin, end in zip(at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True):
        for a in range(begin, max(begin + 1, end - window + 1), step):
            piece = data[a : min(a + step + window - 1, end)]
            got = _anchored(np.append(piece, np.uint8(0x20)), np.array([0, len(piece) + 1]), window, seed)
            parts.append([x + a for x in got])
    place, first, last = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if not len(place):
        return place, first, last
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)))
    return place[new], first[new], last[np.append(new[1:], len(place)) - 1]


def _anchored(data: np.ndarray, at: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    size, wide = np.diff(at) - 1, window - seed + 1
    count = np.maximum(size - window + 1, 0)
    if not count.any():
        return none, none, none
    start = np.arange(int(count.sum())) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    low = np.uint64((1 << _POSITION_BITS) - 1)
    order = (common.mix64(words) & ~low) | (low - np.arange(len(words), dtype=np.uint64))
    blocks = np.concatenate([order, np.full(-len(order) % wide, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = low - (np.minimum(after[start], before[start + wide - 1]) & low)
    edge = np.append(True, (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(best)) - 1
    return best[first].astype(np.int64), start[first], start[last]


def anchor_keys(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The hash of the seed of every anchor of every sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text.chunks(batches):
            data, at = text.joined(texts)
            place, _, _ = anchored(data, at, window, seed)
            yield pa.RecordBatch.from_arrays([pa.array(text.spans(text.byte_sums(data), place, place + seed).view(np.int64))], ["key"])

    return sds.select("text").mapInArrow(run, "key long")


def anchors(sds: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Every anchor of every sheet: ``key``, ``around`` (hash of all bytes of its windows), ``sds_id``, ``low`` (its first window) and ``n`` windows."""
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            data, at = text.joined(texts)
            place, low, high = anchored(data, at, window, seed)
            sums = text.byte_sums(data)
            shape = ((place - low) * window + high - low).astype(np.uint64)
            around = common.mix64(text.spans(sums, low, high + window) + shape * np.uint64(common.BASE))
            doc = np.searchsorted(at, low, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(text.spans(sums, place, place + seed).view(np.int64)), pa.array(around.view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array((low - at[doc]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32))], ["key", "around", "sds_id", "low", "n"])

    return sds.select("sds_id", "text").mapInArrow(run, f"key long, around long, sds_id {kind}, low int, n int")


def pieces(sds: DataFrame, wanted: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The wanted anchors with their bytes: ``key``, ``sds_id``, ``low``, ``n``, ``suffix`` (from the anchor to the end of its last window) and ``prefix`` (the bytes before it, nearest first)."""
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            data, at = text.joined(texts)
            place, low, high = anchored(data, at, window, seed)
            lists = rows.column(2)
            want = lists.flatten().to_numpy() + np.repeat(at[:-1], lists.value_lengths().to_numpy())
            pick = np.flatnonzero(np.isin(low, want))
            place, low, high = place[pick], low[pick], high[pick]
            raw = data.tobytes()
            doc = np.searchsorted(at, low, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(text.spans(text.byte_sums(data), place, place + seed).view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array((low - at[doc]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32)),
                pa.array([raw[p : h + window] for p, h in zip(place, high, strict=True)], pa.binary()), pa.array([raw[a:p][::-1] for a, p in zip(low, place, strict=True)], pa.binary()),
            ], ["key", "sds_id", "low", "n", "suffix", "prefix"])

    return fetched(sds, wanted).select("sds_id", "text", "lows").mapInArrow(run, f"key long, sds_id {kind}, low int, n int, suffix binary, prefix binary")


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a table, padded with zeros, and their sizes."""
    out = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)
    return out, np.minimum(np.array([len(s) for s in strings], np.int64), width)


def multikey_quicksort(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """The order of pairs of byte strings: three-way partition about a pivot of eight bytes; equals go on with the next eight."""

    def columns(strings: list[bytes]) -> np.ndarray:
        words = -(-max(map(len, strings), default=0) // 8)
        return np.column_stack([matrix(strings, 8 * words)[0].view(">u8").astype(np.uint64), np.array([len(s) for s in strings], np.uint64)]) if words else np.zeros((len(strings), 1), np.uint64)

    table = np.hstack([columns(first), columns(second)])
    order, stack = np.arange(len(first)), [(0, len(first), 0)]
    while stack:
        a, b, depth = stack.pop()
        own = order[a:b]
        if b - a <= SMALL:
            order[a:b] = sorted(own, key=lambda i: (first[i], second[i]))
            continue
        word = table[own, depth]
        pivot = np.partition(word, len(word) // 2)[len(word) // 2]
        less, more = word < pivot, word > pivot
        equal = ~(less | more)
        order[a:b] = np.concatenate([own[less], own[equal], own[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        stack += [(x, y, d) for x, y, d in ((a, i, depth), (i, j, depth + 1), (j, b, depth)) if y - x > 1 and d < table.shape[1]]
    return order


def agreement(one: list[bytes], other: list[bytes], width: int) -> np.ndarray:
    """The length of the common prefix of each pair."""
    (a, na), (b, nb) = matrix(one, width), matrix(other, width)
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(na, nb)) if len(a) else np.zeros(0, np.int64)


def sorted_neighbours(rows: DataFrame, by: str, then: str, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For every piece and its neighbours in the order of (``by``, ``then``): ``sds_id``, ``low``, and the bytes agreed on to the ``right`` of the anchor and to the ``left``.

    Sampled splitters range-partition the pieces into buckets of about ``bucket_rows``; each bucket is sorted for itself, and the last piece of each is
    compared with the first of the next.
    """
    kind = dict(rows.dtypes)["sds_id"]
    buckets = max(1, -(-rows.count() // bucket_rows))
    dealt = rows.select("sds_id", "low", "suffix", "prefix").repartitionByRange(buckets, by, then, "sds_id", "low")
    names = ["sds_id", "low", "right", "left", "edge", "bucket", "suffix", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        own = pa.Table.from_batches(held).combine_chunks()
        suffix, prefix = own.column("suffix").to_pylist(), own.column("prefix").to_pylist()
        order = multikey_quicksort(*((suffix, prefix) if by == "suffix" else (prefix, suffix)))
        suffix, prefix = [suffix[i] for i in order], [prefix[i] for i in order]
        own = own.select(["sds_id", "low"]).take(pa.array(order))
        right, left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order) - 1, 5_000):
            to = min(at + 5_000, len(order) - 1)
            right = np.append(right, agreement(suffix[at:to], suffix[at + 1 : to + 1], window))
            left = np.append(left, agreement(prefix[at:to], prefix[at + 1 : to + 1], window))
        ends = [0, len(order) - 1]
        pick = pa.array(np.concatenate([np.arange(len(right)), np.arange(len(right)) + 1, ends]))
        whole = own.take(pick)
        number, nulls = len(right) * 2, [None] * (len(right) * 2)
        yield from pa.table([
            whole.column(0), whole.column(1), pa.array(np.concatenate([right, right, [0, 0]]).astype(np.int32)), pa.array(np.concatenate([left, left, [0, 0]]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(number), [1, 2]]).astype(np.int32)), pa.array(np.full(number + 2, TaskContext.get().partitionId(), np.int32)),
            pa.array(nulls + [suffix[i] for i in ends], pa.binary()), pa.array(nulls + [prefix[i] for i in ends], pa.binary()),
        ], names=names).to_batches(10_000)

    found = common.written(dealt.mapInArrow(run, f"sds_id {kind}, low int, right int, left int, edge int, bucket int, suffix binary, prefix binary"), f"neighbours-by-{by}")
    ends = found.where("edge > 0").select("sds_id", "low", "edge", "bucket", "suffix", "prefix")
    # one row for each bucket that is not empty
    following = ends.where("edge = 2").select("bucket").withColumn("next", F.lead("bucket").over(Window.orderBy("bucket"))).where("next is not null")
    last = ends.where("edge = 2").drop("edge").join(following, "bucket")
    head = ends.where("edge = 1").select(F.col("bucket").alias("next"), *[F.col(c).alias(f"next_{c}") for c in ("sds_id", "low", "suffix", "prefix")])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            right, left = (agreement(c[f].to_pylist(), c[f"next_{f}"].to_pylist(), window).astype(np.int32) for f in ("suffix", "prefix"))
            for side in ("", "next_"):
                yield pa.RecordBatch.from_arrays([c[f"{side}sds_id"], c[f"{side}low"], pa.array(right), pa.array(left)], ["sds_id", "low", "right", "left"])

    edges = last.join(head, "next").select("sds_id", "low", "suffix", "prefix", "next_sds_id", "next_low", "next_suffix", "next_prefix").mapInArrow(across, f"sds_id {kind}, low int, right int, left int")
    return found.where("edge = 0").select("sds_id", "low", "right", "left").unionByName(edges)


def settled(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """What neighbours tell of each piece: ``spans`` (first and last window, shown to repeat), and ``from_``, ``to_``: the offsets (bytes before the anchor)
    of windows that may repeat at all, with ``open``, whether some of these are not shown to."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f: b.column(i).to_pylist() for i, f in enumerate(b.schema.names)}
            spans, low_end, high_end, open_ = [], [], [], []
            for low, n, at, agreed in zip(c["low"], c["n"], c["at"], c["agreed"], strict=True):
                least, most = at - n + 1, at
                a, z = max(least, window - max(g["right"] for g in agreed)), min(most, max(g["left"] for g in agreed))
                good, at_, gap = [], a, False
                for p, q in sorted((max(a, window - g["right"]), min(z, g["left"])) for g in agreed):
                    if p <= q:
                        gap |= p > at_
                        at_ = max(at_, q + 1)
                        good.append({"start": low + at - q, "stop": low + at - p})
                spans.append(good)
                low_end.append(a)
                high_end.append(z)
                open_.append(a <= z and (gap or at_ <= z))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(low_end, pa.int32()), pa.array(high_end, pa.int32()), pa.array(open_, pa.bool_())], ["key", "sds_id", "low", "at", "spans", "from_", "to_", "open"])

    return rows.select("key", "sds_id", "low", "at", "n", "agreed").mapInArrow(run, f"key long, sds_id {kinds['sds_id']}, low int, at int, spans array<struct<start:int,stop:int>>, from_ int, to_ int, open boolean")


def window_hashes(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each window that may repeat, of the given pieces: ``hash`` (two numbers), ``sds_id``, ``start``."""
    kind = dict(rows.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            suffix, prefix = c["suffix"].to_pylist(), c["prefix"].to_pylist()
            for at in range(0, len(suffix), 2_000):
                to = min(at + 2_000, len(suffix))
                own = [p[::-1] + s for p, s in zip(prefix[at:to], suffix[at:to], strict=True)]
                low, mid, a, z = (c[f].to_numpy()[at:to].astype(np.int64) for f in ("low", "at", "from_", "to_"))
                begin = np.cumsum([0] + [len(x) for x in own])[:-1]
                count = np.maximum(z - a + 1, 0)
                of = np.repeat(np.arange(len(own)), count)
                offset = mid[of] - z[of] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                data = np.frombuffer(b"".join(own), np.uint8)
                start = begin[of] + offset
                hashes = text.spans(text.byte_sums(data), start, start + window)
                check = text.spans(text.byte_sums(data[::-1]), len(data) - start - window, len(data) - start)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(check.view(np.int64)), c["sds_id"].slice(at, to - at).take(pa.array(of)), pa.array((low[of] + offset).astype(np.int32))], ["hash", "check", "sds_id", "start"])

    return rows.select("sds_id", "low", "at", "from_", "to_", "suffix", "prefix").mapInArrow(run, f"hash long, check long, sds_id {kind}, start int")


def repeated_bytes(sds: DataFrame, window: int = WINDOW, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The windows of ``window`` bytes that also start elsewhere: ``sds_id``, ``start``, ``stop`` (first and last window of a run, by their first byte).

    1. Anchors whose seed occurs once are dropped: their windows occur once. 2. Anchors whose bytes all round agree with another's repeat as a whole; one
    of them stays to stand for them. 3. The suffixes of what is left are sorted, and then, in the same way, the bytes before the anchors. Neighbours in the
    first order agree furthest to the right and in the second furthest to the left, which bounds the windows that can repeat; most are shown to by the
    neighbours themselves. 4. Seeds with a window that is possible but not shown have all possible windows compared by hash.
    """
    keys = common.written(anchor_keys(sds, window, seed).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "suffix-keys")
    live = common.written(anchors(sds, window, seed).join(keys, "key"), "suffix-anchors")
    around = common.written(live.groupBy("key", "around").agg(F.min(F.struct("sds_id", "low", "n")).alias("first"), F.count(F.lit(1)).alias("times")), "suffix-surroundings")
    span = lambda low, n: [F.col(low).alias("start"), (F.col(low) + F.col(n) - 1).alias("stop")]
    again = live.join(around.where("times > 1").select("key", "around"), ["key", "around"]).select("sds_id", *span("low", "n"))
    several = common.written(around.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key"), "suffix-branching")
    branch = common.written(around.join(several, "key").select("key", "first.sds_id", "first.low"), "suffix-branches")
    wanted = common.written(branch.groupBy("sds_id").agg(F.collect_set("low").alias("lows")), "suffix-sheets").where(F.size("lows") > 0)
    held = common.written(pieces(sds, wanted, window, seed).join(several, "key").dropDuplicates(["sds_id", "low"]), "suffix-pieces")
    met = sorted_neighbours(held, "suffix", "prefix", window, bucket_rows).unionByName(sorted_neighbours(held, "prefix", "suffix", window, bucket_rows))
    agreed = met.groupBy("sds_id", "low").agg(F.collect_set(F.struct("right", "left")).alias("agreed"))
    known = common.written(settled(held.select("key", "sds_id", "low", "n", F.length("prefix").alias("at")).join(agreed, ["sds_id", "low"]), window), "settled")
    shown = known.select("sds_id", F.explode("spans").alias("s")).select("sds_id", "s.start", "s.stop")
    open_keys = known.where("open").select("key").distinct()
    rest = common.written(held.join(known.where("from_ <= to_").join(open_keys, "key").select("sds_id", "low", "at", "from_", "to_"), ["sds_id", "low"]), "open-pieces")
    loose = common.written(window_hashes(rest, window), "open-windows")
    twice = loose.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    late = loose.join(twice, ["hash", "check"]).select("sds_id", "start", F.col("start").alias("stop"))
    return again.unionByName(shown).unionByName(late)


def dedup_bytes(sds: DataFrame, window: int = WINDOW, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Remove every byte that a string of ``window`` bytes covers which also starts anywhere else, in the same sheet too.

    ``sds``: sds_id (the sheet's key), text string, read as UTF-8. Returns ``sds_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the remaining bytes, which need not be UTF-8). Strings never cross sheets, may overlap, and are judged on the input. Null texts are empty.
    Texts of fewer than ``window`` bytes lose nothing. Rows that repeat a sheet's key and text are repeats of each other. A null ``sds_id`` loses nothing.
    Other columns are ignored. No rows in, no rows out.
    """
    kind = dict(sds.dtypes)["sds_id"]
    spans = common.written(repeated_bytes(sds, window, seed, bucket_rows).groupBy("sds_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "byte-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            lists = rows.column(2)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            start, stop = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            gone, runs, kept = [], [], []
            for i, t in enumerate(texts):
                if at[i] == at[i + 1]:
                    gone.append(0)
                    runs.append(0)
                    kept.append(t)
                    continue
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, start[at[i] : at[i + 1]], 1)
                np.add.at(edge, stop[at[i] : at[i + 1]] + window, -1)
                drop = np.cumsum(edge)[:-1] > 0
                gone.append(int(drop.sum()))
                runs.append(int((np.diff(np.append(False, drop).astype(np.int8)) > 0).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~drop].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["sds_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return sds.select("sds_id", "text").join(spans, "sds_id", "left").select("sds_id", "text", "spans").mapInArrow(cut, f"sds_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level dedup of every whole text of ``documents``."""
    out = dedup_bytes(common.sds_texts(common.table(spark, sf_dir, "documents")))
    return out.select(F.col("sds_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
