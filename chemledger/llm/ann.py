"""Approximate nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, LIST_ROWS, MAX_LISTS = 20_000, 256, 4_096
REPLICAS, BOUNDARY = 2, 1.05
DEGREE, BEAM, LEAST_LISTS, PRUNE = 24, 160, 96, 1.25
TRIALS, RECALL = 64, 0.95
TOGETHER, PAGE, QUERY_PAGE, PAIRS = 32, 16_384, 1_024, 65_536


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.cast("array<double>").alias("vector")).where(F.coalesce(good, F.lit(False)))


def _rows(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, which gives all vectors the length ``norm``: the largest inner product is then the least distance to (query, 0)."""
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
    return np.column_stack([x, rest])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Split the largest cluster in two again and again, and settle all by k-means with a price on full clusters, which keeps their sizes near."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(np.unique(x, axis=0)))) if len(x) else 1
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    price = np.zeros(lists)
    for _ in range(rounds):
        d = _distances(x, centroids)
        own = (d + price).argmin(1)
        count = np.bincount(own, minlength=lists)
        price = 0.05 * np.median(d[np.arange(len(x)), own]) * (count / max(len(x) / lists, 1) - 1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        some = count > 0
        centroids[some] = total[some] / count[some, None]
        for k in np.flatnonzero(~some):  # an empty cluster takes half of the largest
            big = int(count.argmax())
            members = np.flatnonzero(own == big)
            centroids[k] = x[rng.choice(members)]
            count[big] //= 2
    return centroids


@dataclass
class Graph:
    """Centroids in memory, each linked to its nearest ones and to the next in a ring, so that each can be reached; searched by a beam from spread entry points."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, degree: int = DEGREE) -> Graph:
        d = _distances(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        k = max(1, min(degree, len(centroids) - 1))
        links = np.argpartition(d, k - 1, axis=1)[:, :k] if len(centroids) > 1 else np.zeros((1, 1), np.int64)
        links = np.column_stack([links, (np.arange(len(centroids)) + 1) % len(centroids)])
        entries = [0]
        far = _distances(centroids, centroids[:1])[:, 0]
        while len(entries) < min(16, len(centroids)):  # farthest first, so that no part of the graph is out of reach
            entries.append(int(far.argmax()))
            far = np.minimum(far, _distances(centroids, centroids[entries[-1:]])[:, 0])
        return Graph(centroids, links, np.array(entries))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each query its ``beam`` nearest lists found, nearest first, with their squared distances; all queries of a batch step together.

        A step follows the links of the nearest lists not yet followed, a sixteenth of the beam of them; it ends when all of the beam are followed.
        """
        n, c = len(q), len(self.centroids)
        beam = min(beam, c)
        stride = max(4, beam // 16)
        done = np.zeros((n, c), bool)
        found = np.full((n, c), np.inf)
        rows = np.arange(n)[:, None]
        found[:, self.entries] = _distances(q, self.centroids[self.entries])
        while True:
            best = np.argpartition(found, beam - 1, axis=1)[:, :beam]
            value = np.where(done[rows, best], np.inf, found[rows, best])
            pick = np.argpartition(value, min(stride, beam) - 1, axis=1)[:, :stride]
            open_ = np.isfinite(np.take_along_axis(value, pick, axis=1))
            if not open_.any():
                break
            row, node = np.nonzero(open_)[0], np.take_along_axis(best, pick, axis=1)[open_]
            done[row, node] = True
            fresh = np.zeros((n, c), bool)
            fresh[row[:, None], self.links[node]] = True
            row, node = np.nonzero(fresh & np.isinf(found))
            for at in range(0, len(row), PAIRS):
                r, m = row[at : at + PAIRS], node[at : at + PAIRS]
                found[r, m] = ((q[r] - self.centroids[m]) ** 2).sum(1)
        order = np.argsort(found, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(found, order, axis=1)


def _homes(x: np.ndarray, graph: Graph, norm: float, replicas: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``replicas`` nearest lists of each vector, nearest first, and which of them it stands in."""
    d = _distances(lifted(x, norm), graph.centroids)
    k = min(replicas, d.shape[1])
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = np.take_along_axis(d, near, axis=1)
    return near, (own <= own[:, :1] * boundary**2) | (np.arange(k) == 0)


def posted(vectors: DataFrame, graph: Graph, norm: float, replicas: int = REPLICAS, boundary: float = BOUNDARY) -> DataFrame:
    """``list``, ``vec_id``, ``vector``: each vector in its nearest list, and near a boundary in up to ``replicas`` lists within ``boundary`` times that distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2_000):
                part = b.slice(at, 2_000)
                near, stands = _homes(_rows(part.column(1)), graph, norm, replicas, boundary)
                i, j = np.nonzero(stands)
                yield pa.RecordBatch.from_arrays([pa.array(near[i, j].astype(np.int32)), *[c.take(pa.array(i)) for c in part.columns]], ["list", "vec_id", "vector"])

    return vectors.mapInArrow(run, "list int, vec_id long, vector array<double>")


def probed(queries: DataFrame, graph: Graph, most: int = LEAST_LISTS, prune: float = PRUNE, beam: int = BEAM) -> DataFrame:
    """``list``, ``vec_id``, ``vector``: each query at the lists that the graph finds within ``prune`` times the distance of the nearest, ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                x = _rows(part.column(1))
                near, d = graph.search(np.column_stack([x, np.zeros(len(x))]), beam)
                near, d = near[:, :most], d[:, :most]
                i, j = np.nonzero(np.isfinite(d) & ((d <= d[:, :1] * prune**2) | (np.arange(d.shape[1]) == 0)))
                yield pa.RecordBatch.from_arrays([pa.array(near[i, j].astype(np.int32)), *[c.take(pa.array(i)) for c in part.columns]], ["list", "vec_id", "vector"])

    return queries.mapInArrow(run, "list int, vec_id long, vector array<double>")


def block_best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for each query: (query, vector, score); scores are summed component by component, so that equal vectors score equally."""
    rough = q @ v.T
    rough[q_id[:, None] == v_id] = -np.inf
    slack = 1e-9 * (1 + np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1])
    edge = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((rough >= edge[:, None] - slack) & np.isfinite(rough))
    score = np.zeros(len(i))
    for d in range(q.shape[1]):
        score += q[i, d] * v[j, d]
    order = np.lexsort((v_id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return q_id[i[nth < k]], v_id[j[nth < k]], score[nth < k]


def reach(good: DataFrame, asked: DataFrame, graph: Graph, norm: float, k: int, recall: float = RECALL, trials: int = TRIALS) -> tuple[int, float, int]:
    """How many lists, up to what ratio to the nearest list's distance, and how wide a beam queries need for ``recall``; LEAST_LISTS, PRUNE and BEAM at least.

    Measured on the ``trials`` queries whose hashed vec_id comes first: their true neighbours, by brute force over all vectors, and the lists these stand in.
    The beam doubles until the graph finds such a list for enough of them, and its ranks and ratios then give the other two, which leave out half of what
    may be lost each. So the share of lists that is searched follows the data, whatever their number.
    """
    rows = asked.orderBy(F.xxhash64("vec_id", F.lit("trial")), "vec_id").limit(trials).toPandas().drop_duplicates("vec_id")
    if not len(rows):
        return LEAST_LISTS, PRUNE, BEAM
    q_id, q = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_list())
    row_of = {v: n for n, v in enumerate(q_id.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2_000):
                part = b.slice(at, 2_000)
                v_id, v = part.column(0).to_numpy(), _rows(part.column(1))
                found_q, found_v, score = block_best(q_id, q, v_id, v, k)
                of = {x: n for n, x in enumerate(v_id.tolist())}
                near, stands = _homes(v[np.array([of[x] for x in found_v.tolist()], int)], graph, norm, REPLICAS, BOUNDARY)
                ends = np.concatenate([[0], stands.sum(1).cumsum()]).astype(np.int32)
                homes = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[stands].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(found_q), pa.array(found_v), pa.array(score), homes], ["query_id", "vec_id", "score", "homes"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = good.mapInArrow(run, "query_id long, vec_id long, score double, homes array<int>").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    need = true.select("query_id", "homes").toPandas()  # trials x k rows
    if not len(need):
        return LEAST_LISTS, PRUNE, BEAM
    i = np.repeat([row_of[x] for x in need["query_id"].tolist()], need["homes"].str.len())
    start = np.concatenate([[0], need["homes"].str.len().cumsum().to_numpy()[:-1]])
    home = np.concatenate(need["homes"].to_list())
    c, share, beam = len(graph.centroids), 1 - (1 - recall) / 2, BEAM
    while True:
        near, d = graph.search(np.column_stack([q, np.zeros(len(q))]), beam)
        place, ratio = np.full((len(q), c), c), np.full((len(q), c), np.inf)
        np.put_along_axis(place, near, np.where(np.isfinite(d), np.arange(near.shape[1]), c), axis=1)
        np.put_along_axis(ratio, near, np.sqrt(d / np.maximum(d[:, :1], 1e-300)), axis=1)
        place, ratio = np.minimum.reduceat(place[i, home], start), np.minimum.reduceat(ratio[i, home], start)
        if beam >= c or np.quantile(place, share, method="higher") < c:
            break
        beam *= 2
    most, prune = np.quantile(place, share, method="higher"), np.quantile(ratio, share, method="higher")
    return max(LEAST_LISTS, int(most) + 1), max(PRUNE, float(prune) * (1 + 1e-9)), beam


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, most: int | None = None, prune: float | None = None, beam: int | None = None) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``vectors`` and ``queries``: vec_id long, vector array<float or double> of one length; general, as the reference has no vectors. A query's own row is no
    candidate. Centroids are fitted on the ``sample`` vectors whose hashed vec_id comes first; every vector is indexed. There are as many lists as give
    about ``list_rows`` to each, ``max_lists`` at most, which bounds what tasks hold of the index. TOGETHER lists stand on one shelf; a shelf longer than
    PAGE is searched page by page, and queries of a popular shelf in pages too, so no task holds a whole list however long.

    How many lists a query searches, how far, and how wide a beam finds them, is measured on some queries (``reach``) unless ``most``, ``prune`` and ``beam`` say so.

    Vectors that are null, zero, or hold nulls or non-finite numbers take no part on either side. Ties go to the smaller vec_id. Rows that repeat a vec_id
    count once per different vector found. Other columns are ignored. Without vectors or queries there are no rows.
    """
    good, asked = usable(vectors), usable(queries)
    n, norm = good.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = float(norm)
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    graph = Graph.of(balanced_centroids(lifted(np.stack(rows.to_list()), norm), min(max_lists, -(-n // list_rows))))
    post = common.written(posted(good, graph, norm), "postings")
    if most is None or prune is None or beam is None:
        lists, ratio, width = reach(good, asked, graph, norm, k)
        most, prune, beam = lists if most is None else most, ratio if prune is None else prune, width if beam is None else beam
    ask = common.written(probed(asked, graph, most, prune, beam), "probes")
    shelf = F.floor(F.col("list") / TOGETHER).cast("int").alias("shelf")
    post, ask = post.select(shelf, "*"), ask.select(shelf, "*")
    # at most max_lists / TOGETHER rows each
    pages = post.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("pages"))
    askers = ask.groupBy("shelf").agg(F.ceil(F.count_distinct("vec_id") / QUERY_PAGE).cast("int").alias("askers"))
    plan = F.broadcast(pages.join(askers, "shelf"))
    hashed = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["shelf", "page", "asker", "list", "vec_id", "vector"]
    left = post.join(plan, "shelf").withColumn("page", hashed("pages")).withColumn("asker", each("askers")).select(*columns)
    right = ask.join(plan, "shelf").withColumn("asker", hashed("askers")).withColumn("page", each("pages")).select(*columns)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The best of a page of lists that stand together, list by list, for the queries that ask for each."""
        asked_by, found = dict(tuple(b.groupby("list"))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for name, rows in a.groupby("list"):
            if name in asked_by:
                q = asked_by[name]
                found.append(block_best(q["vec_id"].to_numpy(), np.stack(q["vector"].to_list()), rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_list()), k))
        q_id, v_id, score = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = pd.DataFrame({"query_id": q_id, "vec_id": v_id, "score": score}).drop_duplicates()
        rows = rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return rows[rows.groupby("query_id").cumcount() < k]

    keys = ["shelf", "page", "asker"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest ``embeddings`` of every twentieth."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
