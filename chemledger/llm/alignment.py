"""Two tokenizers over the same sheet texts: where their tokens end together, which tokens that links, and how often over all sheets."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

TOKENIZERS, BYTE_BPE, PIECE_BPE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level BPE cuts a text before merging
HELD_SEGMENTS, HELD_BYTES = 300_000, 48 << 20  # what a worker remembers of segments it has aligned
USUAL = 1_000  # characters of a segment that the quicker encoder takes
COMMON_PAIRS = 65_536  # the pairs of highest count are looked up in memory, all others by a join
# blanks between two characters that are no white space: both tokenizers begin a token there, whatever stands around
_between = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A (byte-level BPE of ``tokenizers``) and B (BPE of ``sentencepiece``) with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = _byte_of()
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            if all(c in byte for c in token):
                self.a_bytes[i] = bytes(byte[c] for c in token)
        # ids that follow the order of merges are ranks, so that the quicker encoder gives the same ids
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x and i not in set(self.a.get_added_tokens_decoder())}
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) and all(bytes([k]) in ranks for k in range(256)) else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        piece = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(piece)]
        # a piece that goes on after a blank could cross a cut
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) for p in piece)
        self.a_size, self.b_size = (np.array([len(x) for x in every]) for every in (self.a_bytes, self.b_bytes))
        self.n_b = n
        self.a_parts, self.b_parts = (np.array([f"{i}{c}".encode() for c in ends for i in range(len(every))], object) for every, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.a_part_size, self.b_part_size = (np.array([len(x) for x in every]) for every in (self.a_parts, self.b_parts))

    def encode_a(self, whole: str, quick: bool) -> list[int]:
        return self.quick.encode_ordinary(whole) if quick and self.quick else self.a.encode(whole, add_special_tokens=False).ids


@lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@dataclass
class Aligned:
    """Segments in both tokenizers: their numbers of tokens, their groups as text, and how many of the ``links``, pairs a x (size of B) + b, each has. ``exact``: both tokenizers give its bytes back."""

    exact: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[bytes]
    n_links: np.ndarray
    links: np.ndarray


def _one_run(segments: list[str], t: Tokenizers, quick: bool) -> Aligned | None:
    """The segments encoded as one text, blanks between them; None unless both tokenizers give its bytes back and end tokens with every segment."""
    whole = " " + " ".join(segments)
    a, b = np.array(t.encode_a(whole, quick), np.int64), np.array(t.b.encode(whole[1:]), np.int64)
    data = whole.encode()
    if b"".join([t.a_bytes[i] for i in a.tolist()]) != data or b"".join([t.b_bytes[i] for i in b.tolist()]) != data:
        return None
    edge = np.cumsum([len(s.encode()) + 1 for s in segments])
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    last = np.searchsorted(both, edge)
    if last[-1] >= len(both) or (both[last] != edge).any():
        return None
    a_at, b_at = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
    # tokens of A, then of B, group by group; the last of each side in a group has its own ending
    a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
    a_before, b_before = np.append(0, a_at + 1), np.append(0, b_at + 1)
    a_part, b_part = a.copy(), b.copy()
    a_part[a_at] += len(t.a_bytes)
    b_part[b_at] += t.n_b
    parts, size = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
    a_place, b_place = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_before[b_group + 1]
    parts[a_place], parts[b_place] = t.a_parts[a_part], t.b_parts[b_part]
    size[a_place], size[b_place] = t.a_part_size[a_part], t.b_part_size[b_part]
    text_of, upto = b"".join(parts.tolist()), np.cumsum(size)
    stop = upto[a_before[last + 1] + b_before[last + 1] - 1].tolist()
    groups = [text_of[i : j - 1] for i, j in zip([0, *stop[:-1]], stop, strict=True)]
    per = lambda ends: np.diff(np.append(0, np.searchsorted(ends, edge, "right")))
    return Aligned(np.ones(len(segments), bool), per(a_end), per(b_end), groups, np.diff(np.append(-1, last)), a[a_at] * t.n_b + b[b_at])


def _joined(parts: list[Aligned]) -> Aligned:
    every = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Aligned(every("exact"), every("n_a"), every("n_b"), [g for p in parts for g in p.groups], every("n_links"), every("links"))


def _runs(segments: list[str], t: Tokenizers, quick: bool) -> Aligned:
    """Segments that may stand in one text: all at once, or in halves down to the ones that a tokenizer does not give back."""
    zero = np.zeros(len(segments), np.int64)
    if not segments:
        return Aligned(zero.astype(bool), zero, zero, [], zero, zero)
    if (got := _one_run(segments, t, quick)) is not None:
        return got
    if len(segments) == 1:
        return Aligned(zero.astype(bool), zero, zero, [b""], zero, zero[:0])
    half = len(segments) // 2
    return _joined([_runs(segments[:half], t, quick), _runs(segments[half:], t, quick)])


def align(segments: list[str], t: Tokenizers) -> tuple[list[str], Aligned]:
    """The segments, in another order, each with a blank before it for A (B adds its own), in the tokens of both, cut where both end together."""
    usual, other, alone = [], [], []
    for s in segments:
        if not t.cuts or not s or s[0].isspace() or s[-1].isspace():
            alone.append(s)
        elif len(s) <= USUAL and max(s) < "\u0530":  # scripts whose classes of characters do not hang on the version of a table
            usual.append(s)
        else:
            other.append(s)
    return usual + other + alone, _joined([_runs(usual, t, True), _runs(other, t, False), *[_runs([s], t, False) for s in alone]])


class Memo:
    """Segments that a worker has aligned and remembers; it forgets all when they get too many."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.at, self.held, self.bytes = {}, Aligned(none.astype(bool), none, none, [], none, none), 0

    def places(self, texts: list[str]) -> list[list[int]]:
        """For each text the places in ``held`` of its segments."""
        if len(self.at) > HELD_SEGMENTS or self.bytes > HELD_BYTES:
            self.forget()
        cut = [_between.split(s) if self.t.cuts else [s] for s in texts]
        new = list(dict.fromkeys(s for own in cut for s in own if s not in self.at))
        if new:
            order, more = align(new, self.t)
            self.at.update(zip(order, range(len(self.at), len(self.at) + len(order)), strict=True))
            self.held = _joined([self.held, more])
            self.bytes += sum(map(len, more.groups)) + more.links.nbytes
        at = self.at
        return [[at[s] for s in own] for own in cut]


def aligned_texts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Texts (node, copies, text) in both tokenizers: ``node``, ``copies``, ``n_a``, ``n_b``, ``groups`` (text), and the distinct ``pairs`` that links hold with their ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        memo = Memo(t)
        for rows, raw in text.chunks(batches):
            places = memo.places([x.decode() for x in raw])
            held = memo.held
            size = np.fromiter(map(len, places), np.int64, len(places))
            flat, doc = np.fromiter((i for own in places for i in own), np.int64, int(size.sum())), np.repeat(np.arange(len(places)), size)
            usable = np.array([bool(x) for x in raw]) & (np.bincount(doc, ~held.exact[flat], len(places)) == 0)
            groups = [";".join([held.groups[i].decode() for i in own]) if good else "" for own, good in zip(places, usable, strict=True)]
            flat, doc = flat[usable[doc]], doc[usable[doc]]
            n_a, n_b = (np.bincount(doc, n[flat], len(places)).astype(np.int64) for n in (held.n_a, held.n_b))
            many, begin = held.n_links[flat], (np.cumsum(held.n_links) - held.n_links)[flat]
            place = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            links = held.links
            d, pair, times = text.counted(np.repeat(doc, many), links[place])
            edge = pa.array(np.searchsorted(d, np.arange(len(places) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n_a), pa.array(n_b), pa.array(groups, pa.string()), pa.ListArray.from_arrays(edge, pa.array(pair)), pa.ListArray.from_arrays(edge, pa.array(times))],
                ["node", "copies", "n_a", "n_b", "groups", "pairs", "times"])

    return texts.select("node", "copies", "text").mapInArrow(run, "node binary, copies long, n_a long, n_b long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """How many links over all sheets hold each pair, and whether no pair of the same B token has more: ``pair``, ``count``, ``best``."""
    each = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), (F.col("x.times") * F.col("copies")).alias("links"))
    counts = common.written(each.groupBy("pair").agg(F.sum("links").alias("count")), "pair-counts")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))
    return common.written(counts.join(most, F.col("pair") % n_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-ranks")


def scored(aligned: DataFrame, counts: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``node``, ``n_links``, ``n_best`` and ``count_sum`` of each aligned text.

    The ``common_pairs`` pairs of highest count are sent to all tasks, so that only the rare ones of a text are joined.
    """
    top = counts.orderBy(F.desc("count"), "pair").limit(common_pairs).toPandas().sort_values("pair")
    pair, count, best = top["pair"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["best"].to_numpy(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists, times = rows.column(1), rows.column(2).flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            doc, own = np.repeat(np.arange(len(rows)), size), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            place = at[known]
            total = np.zeros((3, len(rows)), np.int64)
            np.add.at(total[0], doc, times)
            np.add.at(total[1], doc[known], times[known] * best[place])
            np.add.at(total[2], doc[known], times[known] * count[place])
            edge = pa.array(np.searchsorted(doc[~known], np.arange(len(rows) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(x) for x in total], pa.ListArray.from_arrays(edge, pa.array(own[~known])), pa.ListArray.from_arrays(edge, pa.array(times[~known]))], ["node", "n_links", "n_best", "count_sum", "pairs", "times"])

    known = common.written(aligned.select("node", "pairs", "times").mapInArrow(run, "node binary, n_links long, n_best long, count_sum long, pairs array<long>, times array<long>"), "known-pairs")
    rare = known.select("node", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("node", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
    rest = rare.groupBy("node").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_count"))
    more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return known.join(rest, "node", "left").select("node", "n_links", more("n_best", "more_best"), more("count_sum", "more_count"))


def align_sds(sds: DataFrame, a_path: str, b_path: str, groups: Column | None = None, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """How two tokenizers agree on every sheet: ``sds_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``sds``: sds_id, text string. A (a byte-level BPE file of ``tokenizers``) encodes a blank and the text, B (a BPE model of ``sentencepiece``) the text, to
    which it adds a blank; strings of special tokens are plain text. Where a token of A and one of B end at the same byte, a group ends and the two are
    linked. The count of a pair of tokens is how many links of all sheets hold it. ``n_best`` counts the links whose pair no other pair of its B token
    exceeds, ``count_sum`` adds the counts of a sheet's links. ``groups`` reads ``a1,a2|b1;a3|b2,b3``; another column expression over that name may take its
    place, and is evaluated where texts are aligned.

    Rows are shuffled by their full text, so that each distinct text is encoded once and counts as often as it occurs; sheets find it by its SHA-256. Inside
    a task words recur, so segments between blanks that both tokenizers must cut at are encoded once as well.

    Null and empty texts, and those that a tokenizer does not give back byte by byte (U+2581 is a blank to B), have no tokens: zeros and empty ``groups``.
    Repeated rows stay and count. Other columns are ignored. No rows in, no rows out.
    """
    own = F.coalesce("text", F.lit(""))
    node = lambda c: F.unhex(F.sha2(c, 256))
    texts = sds.groupBy(own.alias("text")).agg(F.count(F.lit(1)).alias("copies")).select(node(F.col("text")).alias("node"), "copies", "text")
    n_groups = F.when(F.col("n_a") > 0, F.length("groups") - F.length(F.replace("groups", F.lit(";"))) + 1).otherwise(0).cast("long").alias("n_groups")
    aligned = aligned_texts(texts, a_path, b_path).select("node", "copies", "n_a", "n_b", n_groups, (F.col("groups") if groups is None else groups).alias("groups"), "pairs", "times")
    aligned = common.written(aligned, "aligned")
    counts = pair_counts(aligned, tokenizers(a_path, b_path).n_b)
    measures = aligned.drop("copies", "pairs", "times").join(scored(aligned, counts, common_pairs), "node")
    return sds.select("sds_id", node(own).alias("node")).join(measures, "node").select("sds_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over ``documents``."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = align_sds(common.sds_texts(common.table(spark, sf_dir, "documents")), f"{TOKENIZERS}/{BYTE_BPE}", f"{TOKENIZERS}/{PIECE_BPE}", digest)
    return out.withColumnsRenamed({"sds_id": "doc_id", "groups": "groups_sha256"})
