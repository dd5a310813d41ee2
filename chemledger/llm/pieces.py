"""SentencePiece encoding and decoding of sheet texts by suffix-array matching.

The distinct segments of a batch are joined to one text and indexed by a suffix array. Every piece of the vocabulary is binary-searched in it, which gives
the range of its occurrences; the occurrences, sorted by position, are the edges of a graph over the text. Relaxing that graph by merge rank, lowest rank
first and leftmost among equals, gives the pieces of a byte-fallback BPE model.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_SEGMENTS, LONG_SEGMENT, LONGEST_PIECE = 600_000, 400, 32
BLANK = "▁"
NONE = np.int64(1) << 62


@dataclass
class Vocabulary:
    """Pieces of a BPE model with byte fallback: bytes (blanks as 0x20), id and merge rank of each, and the ids of the 256 byte pieces."""

    piece: list[bytes]
    id: np.ndarray
    rank: np.ndarray
    byte_id: np.ndarray
    surface: list[bytes]

    @property
    def name(self) -> str:
        return hashlib.sha256(b"\0".join(self.surface)).hexdigest()


def vocabulary(model: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; its size is that of the vocabulary, whatever the corpus."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {i: sp.id_to_piece(i).replace(BLANK, " ").encode() for i in plain}
    of_byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    if len(of_byte) != 256:
        raise ValueError("the model has no byte fallback")
    if max(map(len, pieces.values())) > LONGEST_PIECE or any(b" " in p.lstrip(b" ") for p in pieces.values()):
        raise ValueError("pieces over 32 bytes, or with a blank after another character, are not supported")
    order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
    surface = [pieces.get(i, b"") for i in range(n)]
    for b, i in of_byte.items():
        surface[i] = bytes([b])
    return Vocabulary(list(pieces.values()), np.array(plain, np.int64), np.array([order[sp.get_score(i)] for i in plain], np.int64), np.array([of_byte[b] for b in range(256)], np.int64), surface)


def _big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    return out


def _padded(parts: list[bytes], fill: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(p[:8].ljust(8, fill) for p in parts), ">u8").astype(np.uint64)


def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
    """Prefix doubling: the rank at each position with the rank ``step`` bytes on (0 past the end) as one sortable number."""
    after = np.zeros(len(rank), np.int64)
    after[:-step] = rank[step:] + 1
    return (rank.astype(np.int64) << 32) | after


@dataclass
class Matcher:
    """A vocabulary laid out for searching, with a bounded store of segments already encoded."""

    vocab: Vocabulary
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __post_init__(self) -> None:
        pieces, size = self.vocab.piece, np.array([len(p) for p in self.vocab.piece])
        self.size = size
        cut = lambda a, b: [p[a:b] for p in pieces]
        self.low, self.high = [_padded(cut(8 * k, 8 * k + 8), b"\0") for k in range(4)], [_padded(cut(8 * k, 8 * k + 8), b"\xff") for k in range(4)]
        wide = np.zeros(128, bool)  # ASCII characters that occur in pieces of several bytes
        for p in pieces:
            if len(p) > 1:
                wide[[b for b in p if b < 128]] = True
        self.lone = np.concatenate([~wide, np.zeros(128, bool)])
        self.lone[0x20] = False

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces in ``data``, sorted: position*64+length, and the piece's index."""
        u1, r1 = np.unique(_big_endian(data), return_inverse=True)
        u2, r2 = np.unique(_pairs(r1, 8) if len(data) > 8 else r1.astype(np.int64) << 32, return_inverse=True)
        key = _pairs(r2, 16) if len(data) > 16 else r2.astype(np.int64) << 32
        suffix = np.argsort(key)
        key = key[suffix]

        def within(first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Ranks of 16-byte prefixes that the piece bytes from 8*``first`` on allow: [low, high)."""
            a_low, a_high = np.searchsorted(u1, self.low[first]), np.searchsorted(u1, self.high[first], "right")
            b_low, b_high = np.searchsorted(u1, self.low[first + 1]), np.searchsorted(u1, self.high[first + 1], "right")
            long = self.size > 8 * first + 8
            low = np.where(long, (a_low << 32) | (b_low + 1), a_low << 32)
            high = np.where(long, np.where(a_high > a_low, (a_low << 32) | (b_high + 1), a_low << 32), a_high << 32)
            return np.searchsorted(u2, low), np.searchsorted(u2, high)

        (low, high), (next_low, next_high) = within(0), within(2)
        long = self.size > 16
        from_key = np.where(long, (low << 32) | (next_low + 1), low << 32)
        to_key = np.where(long, np.where(high > low, (low << 32) | (next_high + 1), low << 32), high << 32)
        begin, end = np.searchsorted(key, from_key), np.searchsorted(key, to_key)
        count = np.maximum(end - begin, 0)
        which = np.repeat(np.arange(len(count)), count)
        place = suffix[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[which]]
        edge = place * 64 + self.size[which]
        order = np.argsort(edge)
        return edge[order], which[order]

    def encode(self, segments: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of segments (joined bytes and their sizes), with the count for each segment."""
        begin = np.cumsum(size + 1) - (size + 1)
        data = np.full(int((size + 1).sum()), 0xFF, np.uint8)  # 0xFF parts segments and is in no piece
        data[_fan(begin, size)] = segments
        edge, which = self.edges(data)
        head = (data & 0xC0) != 0x80
        head[begin] = True
        start = np.flatnonzero(head & (data != 0xFF)) if not (segments == 0xFF).any() else np.setdiff1d(np.flatnonzero(head), begin + size)
        seg = np.searchsorted(begin, start, "right") - 1
        end = np.append(start[1:], 0)
        last = np.append(seg[1:] != seg[:-1], True)
        end[last] = (begin + size)[seg[last]]

        def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            want = a * 64 + np.minimum(b - a, 63)
            i = np.minimum(np.searchsorted(edge, want), max(len(edge) - 1, 0))
            return np.where(edge[i] == want, which[i], -1) if len(edge) else np.full(len(a), -1)

        def weigh(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            w = find(a, b)
            return np.where(w >= 0, (self.vocab.rank[w] << 36) | a, NONE)

        many = np.bincount(seg, minlength=len(size))
        slow = many[seg] > LONG_SEGMENT
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for s in np.flatnonzero(many > LONG_SEGMENT):
            a, b = np.searchsorted(seg, [s, s + 1])
            done.append(_relax_long(start[a:b], end[a:b], edge, which, self.vocab.rank))
        start, end, seg = start[~slow], end[~slow], seg[~slow]
        cost = np.full(len(start), NONE)
        pair = np.flatnonzero(seg[1:] == seg[:-1])
        cost[pair] = weigh(start[pair], end[pair + 1])
        while len(start):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(cost, first)
            open_ = best < NONE
            if not open_.all():
                sizes = np.diff(np.append(first, len(seg)))
                stay = np.repeat(open_, sizes)
                done.append((start[~stay], end[~stay]))
                start, end, seg, cost, best = start[stay], end[stay], seg[stay], cost[stay], best[open_]
                if not len(start):
                    break
            left = np.searchsorted(start, best & ((1 << 36) - 1))
            end[left] = end[left + 1]
            keep = np.ones(len(start), bool)
            keep[left + 1] = False
            left -= np.arange(len(left))
            start, end, seg, cost = start[keep], end[keep], seg[keep], cost[keep]
            fresh = np.unique(np.concatenate([left, left[left > 0] - 1]))
            inside = fresh + 1 < len(start)
            inside[inside] = seg[fresh[inside] + 1] == seg[fresh[inside]]
            cost[fresh] = NONE
            cost[fresh[inside]] = weigh(start[fresh[inside]], end[fresh[inside] + 1])
        start = np.concatenate([d[0] for d in done] + [np.zeros(0, np.int64)])
        end = np.concatenate([d[1] for d in done] + [np.zeros(0, np.int64)])
        order = np.argsort(start)
        start, end = start[order], end[order]
        found = find(start, end)
        lack = found < 0  # a character without a piece: its bytes
        count = np.where(lack, end - start, 1)
        ids = np.empty(int(count.sum()), np.int32)
        to = np.cumsum(count) - count
        ids[to[~lack]] = self.vocab.id[found[~lack]]
        ids[_fan(to[lack], count[lack])] = self.vocab.byte_id[data[_fan(start[lack], count[lack])]]
        return ids, np.bincount(np.searchsorted(begin, start, "right") - 1, count, minlength=len(size)).astype(np.int64)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of whole texts, with the count for each text."""
        own = [b" " + t.replace(BLANK.encode(), b" ") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(own), np.uint8)
        at = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(x) for x in own], out=at[1:])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank, lone = data == 0x20, self.lone[data]
        cut = np.ones(len(data), bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | lone[1:] | lone[:-1]
        cut[at[:-1][at[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(data)))
        h = text.spans(text.byte_sums(data), start, start + size)
        names, example, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_SEGMENTS:
            self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        i = np.searchsorted(self.known, names)
        new = ~(self.known[np.minimum(i, len(self.known) - 1)] == names) if len(self.known) else np.ones(len(names), bool)
        if new.any():
            s = example[new]
            ids, count = self.encode(data[_fan(start[s], size[s])], size[s])
            self._store(names[new], ids, count)
            i = np.searchsorted(self.known, names)
        count = np.diff(self.at)[i][which]
        ids = self.ids[_fan(self.at[:-1][i][which], count)]
        doc = np.searchsorted(at, start, "right") - 1
        return ids, np.bincount(doc, count, minlength=len(texts)).astype(np.int64)

    def _store(self, names: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        both = np.concatenate([self.known, names])
        counts = np.concatenate([np.diff(self.at), count])
        begin = np.cumsum(counts) - counts
        order = np.argsort(both)
        self.ids = np.concatenate([self.ids, ids])[_fan(begin[order], counts[order])]
        self.known, self.at = both[order], np.concatenate([[0], np.cumsum(counts[order])])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Texts of piece ids: pieces joined, byte pieces as bytes, without the blank that encoding puts first."""
        if not hasattr(self, "_surface"):
            self._size = np.array([len(s) for s in self.vocab.surface])
            self._surface, self._begin = np.frombuffer(b"".join(self.vocab.surface), np.uint8), np.cumsum(self._size) - self._size
        size = self._size[ids]
        data = self._surface[_fan(self._begin[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _fan(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+count[0]-1, begin[1] .. and so on."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def _relax_long(start: np.ndarray, end: np.ndarray, edge: np.ndarray, which: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same merges for one long segment, by a heap of edges."""
    a, b = np.searchsorted(edge, [start[0] * 64, end[-1] * 64])
    cost = dict(zip(edge[a:b].tolist(), rank[which[a:b]].tolist(), strict=True))
    s, e, n = start.tolist(), end.tolist(), len(start)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (size := e[j] - s[i]) < 64 and (r := cost.get(s[i] * 64 + size)) is not None:
            heapq.heappush(heap, (r, i, j, e[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and e[j] == stop):
            continue
        e[i], alive[j], right[i] = stop, False, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    keep = np.array(alive)
    return np.array(s)[keep], np.array(e)[keep]


_live: dict[str, Matcher] = {}


def _matcher(vocab: Vocabulary) -> Matcher:
    """One matcher for each worker process and vocabulary, kept between tasks."""
    if (name := vocab.name) not in _live:
        _live.clear()
        _live[name] = Matcher(vocab)
    return _live[name]


def encode_sds(sds: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Encode every sheet's whole text: ``sds_id``, ``pieces`` (array of ids), ``n_pieces`` and ``exact`` (decoding gives the text back).

    ``sds``: sds_id long, text string. Ids equal those of the model's own encoder. Null and empty texts have no pieces and are exact. ``exact`` is false
    only for a text that holds U+2581 itself, which the model reads as a blank. Repeated rows stay; other columns are ignored; no rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(vocab)
        for rows, texts in text.chunks(batches):
            ids, count = m.texts(texts)
            exact = [a == b for a, b in zip(m.decode(ids, count), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(count), pa.array(exact, pa.bool_())], ["sds_id", "pieces", "n_pieces", "exact"])

    return sds.select("sds_id", "text").mapInArrow(run, "sds_id long, pieces array<int>, n_pieces long, exact boolean")


def decode_sds(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The texts of encoded sheets: ``sds_id``, ``text``. Null ``pieces``: an empty text. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(vocab)
        for b in batches:
            lists = b.column(1)
            count = np.array([len(x) if x is not None else 0 for x in lists], np.int64)
            texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["sds_id", "text"])

    return encoded.select("sds_id", "pieces").mapInArrow(run, "sds_id long, text string")


def op1_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every whole text of ``documents`` as pieces, with the round trip checked."""
    sds = common.sds_texts(common.table(spark, sf_dir, "documents"))
    return encode_sds(sds, vocabulary(model)).withColumnRenamed("sds_id", "doc_id").select("doc_id", "n_pieces", "exact", F.col("pieces"))
