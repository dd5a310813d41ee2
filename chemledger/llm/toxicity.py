"""Toxicity classifier by non-negative positive-unlabelled learning over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text
from .quality import held_out, learnable

FEATURES = 1 << 18
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 8_000
STEPS, RATE, RIDGE, LEAST_SURPRISE, STEM_BYTES = 200, 0.05, 1e-3, 5.0, 6

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_not_letter = np.ones(256, bool)
_not_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each whole text as (text, feature) pairs in order: its words (runs of letters, ASCII case folded), and for longer
    words the first STEM_BYTES bytes together with the length, which stands for a stem with an ending of that size."""
    w = text.words(texts, _not_letter)
    sums, size = text.byte_sums(_lower[w.data]), w.end - w.start
    long = size > STEM_BYTES
    stem = text.spans(sums, w.start[long], w.start[long] + STEM_BYTES) + size[long].astype(np.uint64) * np.uint64(common.BASE)
    value = np.concatenate([text.spans(sums, w.start, w.end), common.mix64(stem)]) & np.uint64(FEATURES - 1)
    doc, value, _ = text.counted(np.concatenate([w.doc, w.doc[long]]), value)
    return doc, value.astype(np.int64)


@dataclass
class Linear:
    """A score of hashed words: sigmoid(scale * margin + shift), margin = bias + sum of the weights of a text's distinct words."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        margin = self.bias + np.bincount(doc, self.weight[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def fit_nnpu(doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE, surprise: float = LEAST_SURPRISE) -> Linear:
    """Minimise the non-negative risk of sets P (``positive``) and U (the other texts) with Adam on the whole set.

    With logistic losses l(+), l(-) the risk is prior*E_P[l(+)] + max(0, E_U[l(-)] - prior*E_P[l(-)]); where the second part falls below zero the step
    goes up that part instead. Only features that P holds ``surprise`` standard errors more often than U are used; the rest weigh nothing.
    """
    n, p, u = len(positive), positive, ~positive
    in_p, in_u = np.bincount(feature[p[doc]], minlength=FEATURES), np.bincount(feature[u[doc]], minlength=FEATURES)
    expected = in_u * (p.sum() / max(u.sum(), 1))
    keep = ((in_p - expected) / np.sqrt(expected + 0.5) >= surprise)[feature]
    doc, feature = doc[keep], feature[keep]
    model = Linear(np.zeros(FEATURES), 0.0)
    if not p.any() or not u.any():
        model.bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return model
    used, at = np.unique(feature, return_inverse=True)
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m1, m2, c1, c2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.9, 0.999
    n_p, n_u = p.sum(), u.sum()
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(doc, w[at], minlength=n), -30, 30)
        s = 1 / (1 + np.exp(-z))
        soft = np.logaddexp(0, z)
        negative_risk = soft[u].mean() - prior * soft[p].mean()
        d = np.zeros(n)
        if negative_risk >= 0:
            d[p] = prior * ((s[p] - 1) - s[p]) / n_p
            d[u] = s[u] / n_u
        else:
            d[p], d[u] = prior * s[p] / n_p, -s[u] / n_u
        g = np.append(np.bincount(at, d[doc], minlength=len(used)) + ridge * w, d.sum())
        m1, m2 = c1 * m1 + (1 - c1) * g, c2 * m2 + (1 - c2) * g * g
        step = rate * (m1 / (1 - c1**t)) / (np.sqrt(m2 / (1 - c2**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    model.weight[used], model.bias = w, float(b)
    return model


def calibrate(model: Linear, doc: np.ndarray, feature: np.ndarray, label: np.ndarray) -> Linear:
    """Set scale and shift by logistic regression of labels on margins (ridge-damped Newton steps); one class only: left as they are."""
    if not len(label) or label.min() == label.max():
        return model
    z = model.bias + np.bincount(doc, model.weight[feature], minlength=len(label))
    x = np.column_stack([z, np.ones(len(z))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(h, x.T @ (p - label) + 1e-3 * (theta - [1, 0]))
    model.scale, model.shift = float(max(theta[0], 1e-3)), float(theta[1])
    return model


def sheet_words(sds: DataFrame, *carry: str) -> DataFrame:
    """Distinct hashed words of each sheet as an array of at most FEATURES numbers, with the ``carry`` columns."""
    kinds = dict(sds.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            doc, feature = word_features(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in carry), own], [*carry, "words"])

    return sds.select(*carry, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", words array<int>")


def train(sds: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Linear:
    """Fit on a bounded sample, taken by hashed ``sds_id``: up to ``max_positive`` toxic sheets as P and up to ``max_unlabelled`` sheets of any kind as U.

    The class prior is the toxic share of all ``labels``; the margin is calibrated on the labelled sheets of the sample.
    """
    marked = labels.where("label is not null").groupBy("sds_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    first = F.xxhash64("sds_id", F.lit("pu"))
    share = marked.agg(F.avg("label")).first()[0]
    prior = min(max(share or 0.01, 1e-4), 0.9)
    toxic = marked.where("label = 1").orderBy(first, "sds_id").limit(max_positive).select("sds_id", F.lit(True).alias("positive"))
    others = sds.select("sds_id").where("sds_id is not null").distinct().orderBy(first, "sds_id").limit(max_unlabelled).select("sds_id", F.lit(False).alias("positive"))
    # at most max_positive + max_unlabelled rows of three short columns
    chosen = toxic.unionByName(others).groupBy("sds_id").agg(F.max("positive").alias("positive"), F.min("positive").alias("only")).join(marked, "sds_id", "left")
    rows = sheet_words(sds.join(F.broadcast(chosen), "sds_id"), "sds_id", "positive", "only", "label").dropDuplicates(["sds_id"]).toArrow()
    flags = rows.drop_columns(["words"]).to_pandas()
    words = rows.column("words").combine_chunks()
    size, flat = words.value_lengths().to_numpy(), words.flatten().to_numpy()
    del rows, words
    begin = np.cumsum(size) - size
    # a toxic sheet drawn for U as well counts on both sides
    positive, label = flags["positive"].to_numpy(bool), flags["label"].to_numpy(np.float64)
    use = np.concatenate([np.arange(len(flags)), np.flatnonzero(positive & ~flags["only"].to_numpy(bool))])

    def pick(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[of]
        return np.repeat(np.arange(len(of), dtype=np.int32), n), flat[np.arange(int(n.sum())) + np.repeat(begin[of] - (np.cumsum(n) - n), n)]

    model = fit_nnpu(*pick(use), np.append(positive, np.zeros(len(use) - len(positive), bool)), prior)
    known = np.flatnonzero(~np.isnan(label))
    return calibrate(model, *pick(known), label[known])


def score_toxicity(sds: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = 0.7, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Score every sheet's whole text: ``sds_id``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    ``sds``: sds_id long, text string. ``labels``: sds_id long, label int (1 toxic). ``learn_from``: the sheets that the unlabelled sample may be drawn
    from (default: all). Scores come from the text alone. Null and empty texts have no words and score by the bias. Equal texts score alike, repeated
    rows stay. Without toxic labels the score is the prior for all. Null labels and labels without a sheet are ignored, as are other columns.
    """
    model = train(sds if learn_from is None else learn_from, labels, max_positive, max_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            p = model.score(*word_features(texts), len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["sds_id", "score", "predicted"])

    return sds.select("sds_id", "text").mapInArrow(run, "sds_id long, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learnt from two thirds of ``labels``."""
    sds = common.sds_texts(common.table(spark, sf_dir, "documents"))
    scored = score_toxicity(sds, learnable(spark, sf_dir, "toxic", 3, 1), sds.where(~held_out("sds_id", 3, 1)))
    return scored.select(F.col("sds_id").alias("doc_id"), F.coalesce(held_out("sds_id", 3, 1), F.lit(False)).alias("held_out"), "score", "predicted")
