"""Quality classifier: histogram gradient-boosted trees over statistics of a sheet's text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "letters", "capitals", "digits", "marks", "symbols", "line_breaks", "words_per_line", "distinct_words",
    "top_word", "repeated_neighbours", "distinct_pairs", "top_pair", "marked_words", "short_words", "capital_words", "lone_marks", "distinct_lines", "common_words",
)
MAX_LABELLED, TREES, DEPTH, BINS, RATE, RIDGE, LEAST_LEAF = 50_000, 80, 5, 64, 0.15, 2.0, 10

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in ".,;:!?'\"()-"]] = True
_symbol = ~(_letter | _digit | _mark | text._space)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; a text without words has zeros."""
    w = text.words(texts)
    n, size = len(texts), np.array([len(x) for x in texts], np.float64)
    at = w.text_at
    per_text = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), at[:-1]) if n else np.zeros(0)
    count = np.diff(w.first).astype(np.float64)
    by_doc = lambda values: np.bincount(w.doc, values, minlength=n)
    safe, some = np.maximum(size, 1), np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = by_doc(length) / some
    h = text.word_hashes(w)
    d, _, times = text.counted(w.doc, h)
    pairs, inside = text.runs(h, 2), text.whole(w.doc, 2)
    pd, _, ptimes = text.counted(w.doc[: len(pairs)][inside], pairs[inside])
    top, ptop = np.zeros(n), np.zeros(n)
    np.maximum.at(top, d, times)
    np.maximum.at(ptop, pd, ptimes)
    same = np.concatenate((h[1:] == h[:-1], [False])) if len(h) else np.zeros(0, bool)
    same[:-1] &= w.doc[1:] == w.doc[:-1]
    breaks = per_text(w.data == 10)
    tail = _mark[w.data[w.end - 1]] | _symbol[w.data[w.end - 1]]
    tail2 = tail & (length > 2) & (_mark | _symbol)[w.data[np.maximum(w.end - 2, 0)]]
    head = w.data[w.start]
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    line_doc = np.repeat(np.arange(n), [len(x) for x in lines])
    ld = np.repeat(np.arange(n), [len(set(x)) for x in lines])
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    upper = _capital[head] & _capital[w.data[np.maximum(w.end - 2, w.start)]] & (length > 2)
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(by_doc(length**2) / some - mean**2, 0)),
        per_text(_letter[w.data]) / safe, per_text(_capital[w.data]) / safe, per_text(_digit[w.data]) / safe, per_text(_mark[w.data]) / safe, per_text(_symbol[w.data]) / safe,
        breaks / safe, count / (breaks + 1), np.bincount(d, minlength=n) / some, top / some, by_doc(same) / some, np.bincount(pd, minlength=n) / np.maximum(count - 1, 1), ptop / some,
        by_doc(tail2) / some, by_doc(length <= 3) / some, by_doc(upper) / some, by_doc((length == 1) & _symbol[head]) / some,
        np.bincount(ld, minlength=n) / n_lines, np.bincount(d, times >= 3, minlength=n) / np.maximum(np.bincount(d, minlength=n), 1),
    ])


def sheet_statistics(sds: DataFrame) -> DataFrame:
    """``sds_id``, ``label`` and ``stats`` (array of STATISTICS) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            values = pa.FixedSizeListArray.from_arrays(pa.array(statistics(texts).ravel(), pa.float64()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), values], ["sds_id", "label", "stats"])

    return sds.select("sds_id", "label", "text").mapInArrow(run, "sds_id long, label int, stats array<double>")


@dataclass
class Trees:
    """Boosted trees as flat arrays of shape (trees, nodes); node k has children 2k+1 and 2k+2; a feature of -1 ends the path."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: all rows go down all trees level by level."""
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.bin, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                right = binned[row, np.maximum(f, 0)] > cut[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST_LEAF) -> Trees:
    """Boost on the logistic loss; splits are found on histograms of gradients over quantile bins. One class only: a constant."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    share = (y.sum() + 1) / (len(y) + 2)
    nodes = 2 ** (depth + 1) - 1
    out = Trees(edges, np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.int16), np.zeros((trees, nodes)), float(np.log(share / (1 - share))))
    if not len(x) or y.min() == y.max():
        return out
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + np.arange(width) * bins
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(nodes):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            out.value[t, k] = -rate * gs / (hs + ridge)
            if k >= nodes // 2 or len(rows) < 2 * least:
                continue
            where = flat[rows].ravel()
            per = lambda v: np.bincount(where, np.repeat(v, width), minlength=width * bins).reshape(width, bins).cumsum(1)
            gl, hl, nl = per(g[rows]), per(h[rows]), per(np.ones(len(rows)))
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-6:
                continue
            f, cut = divmod(best, bins)
            out.feature[t, k], out.bin[t, k] = f, cut
            node[rows] = 2 * k + 1 + (binned[rows, f] > cut)
        margin += out.value[t, node]
    return out


def train(sds: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on at most ``max_labelled`` labelled sheets, those of ``sds`` whose hashed ``sds_id`` comes first; labels of one sheet are averaged.

    The ids are chosen before any text is read: a hash threshold from their number leaves little more than ``max_labelled`` to be put in order.
    A sheet repeated with other texts counts once, by the smallest statistics.
    """
    marked = labels.where("label is not null").groupBy("sds_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    marked = marked.join(sds.select("sds_id"), "sds_id", "left_semi").withColumn("draw", F.xxhash64("sds_id"))
    share = (max_labelled + 8 * max_labelled**0.5 + 64) / max(marked.count(), 1)
    few = marked.where(F.col("draw") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    # at most max_labelled rows of two numbers
    chosen = F.broadcast(few.orderBy("draw", "sds_id").limit(max_labelled).select("sds_id", "label"))
    rows = sheet_statistics(sds.join(chosen, "sds_id")).groupBy("sds_id").agg(F.min(F.struct("stats", "label")).alias("own")).select("own.*").toPandas()
    x = np.array(rows["stats"].tolist(), np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["label"].to_numpy(np.float64))


def score_quality(sds: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every sheet's whole text: ``sds_id``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    ``sds``: sds_id long, text string. ``labels``: sds_id long, label int (1 good), the rows to learn from; labels without a sheet and null labels are
    ignored. Scores come from the text alone. Null and empty texts have statistics of zero and a score like any other. Equal texts score alike, repeated
    rows stay. Without labels, or with one class only, every score is the smoothed share of 1. Other columns are ignored.
    """
    model = train(sds, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            p = model.score(statistics(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["sds_id", "score", "predicted"])

    return sds.select("sds_id", "text").mapInArrow(run, "sds_id long, score double, predicted int")


def held_out(key: str, folds: int, fold: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def learnable(spark: SparkSession, sf_dir: str, name: str, folds: int, fold: int) -> DataFrame:
    """The labels outside the held-out fold."""
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("sds_id"), F.col(name).cast("int").alias("label"))
    return labels.where(~held_out("sds_id", folds, fold))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learnt from four fifths of ``labels``."""
    scored = score_quality(common.sds_texts(common.table(spark, sf_dir, "documents")), learnable(spark, sf_dir, "quality", 5, 0))
    return scored.select(F.col("sds_id").alias("doc_id"), F.coalesce(held_out("sds_id", 5, 0), F.lit(False)).alias("held_out"), "score", "predicted")


def only_good(rows: DataFrame, labels: DataFrame, key: str = "sds_id", text_column: str = "text", threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows whose whole text scores ``threshold`` or more, with all their columns; learnt from ``labels`` as in ``score_quality``. Rows do not move."""
    sds = rows.select(F.col(key).alias("sds_id"), F.col(text_column).cast("string").alias("text"))
    model = train(sds, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in text.chunks(batches, text_column):
            yield own.filter(pa.array(model.score(statistics(texts)) >= threshold))

    return rows.mapInArrow(run, rows.schema)
