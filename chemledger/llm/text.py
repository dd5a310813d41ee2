"""Vectorised reading of texts inside tasks: whole texts as byte buffers, words, and hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import BASE, mix64, powers

CHUNK_BYTES = 1 << 20
INVERSE = pow(BASE, -1, 1 << 64)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_code = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and whole texts (null: empty) in runs of about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        size = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.zeros(0, np.int64)
        at, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield batch.slice(at, i - at), [x or b"" for x in column.slice(at, i - at).to_pylist()]
                at, total = i, 0
            total += int(n) + 1
        if at < len(column):
            yield batch.slice(at), [x or b"" for x in column.slice(at).to_pylist()]


@dataclass
class Words:
    """Words of a run of texts: the joined bytes, and for each word its text and its first and past-last byte. ``first[t]`` is text t's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    text_at: np.ndarray


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one blank after each, and where each begins (one entry more than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), at


def words(texts: list[bytes], is_space: np.ndarray = _space) -> Words:
    """Split at blanks and the controls 0x09 to 0x0D."""
    data, at = joined(texts)
    gap = is_space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, doc, first, at)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of coded bytes times powers of the base, with a leading 0, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_code[data] * powers(len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte span."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), INVERSE)[start])


def word_hashes(w: Words) -> np.ndarray:
    return spans(byte_sums(w.data), w.start, w.end)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` neighbouring values (across texts too: mask by ``whole``)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(n), out=sums[1:])
    at = np.arange(n - length + 1)
    return mix64((sums[at + length] - sums[at]) * powers(n, INVERSE)[at])


def whole(doc: np.ndarray, length: int) -> np.ndarray:
    """Which runs of ``length`` words stay inside one text."""
    return doc[: len(doc) - length + 1] == doc[length - 1 :] if len(doc) >= length else np.zeros(0, bool)


def counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs with their counts, in order of text and value."""
    if not len(doc):
        return doc, value, np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
    return d[new], v[new], np.diff(np.append(new, len(d)))
