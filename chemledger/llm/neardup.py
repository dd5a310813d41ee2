"""Near duplicates of sheet texts: ProbMinHash of weighted shingles, banding, verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 100, 5  # 20 bands of 5 rows: a pair at 0.8 is missed with odds of 4 in 10,000
ROUNDING = 1e-9  # sums of reciprocals stay this near to their exact value, so that a pair at exactly 0.8 is linked
FINE, DEVIATIONS = 512, 3  # registers that screen untried pairs: one at 0.8 is passed over with odds of 1 in 700
LONG, FRESH = 12, 8  # registers in a fresh band, and fresh bands a round
LEADERS, OF_ROOT, TRIES, CROWD, DRY = 64, 16, 2, 65_536, 1
CHUNK = 1 << 18  # links that a task follows at once
BLOCK, SURE = 4_096, 5  # members of a bucket that one comparison of all pairs holds of a side; a pair at 0.8 is passed over by it with odds of 1 in a million
SIEVE = 1 << 25  # bits, 4 MB sent to all, that tell which texts are needed; further bits would pass fewer texts for nothing


def shingle_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, as (text, shingle, count) in order; a text of fewer than SHINGLE words is one shingle."""
    w = text.words(texts)
    h = text.word_hashes(w)
    n = np.diff(w.first)
    runs, inside = text.runs(h, SHINGLE), text.whole(w.doc, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    own = [text.runs(h[w.first[t] : w.first[t + 1]], int(n[t]))[0] for t in short]
    doc = np.concatenate([w.doc[: len(runs)][inside], short])
    return text.counted(doc, np.concatenate([runs[inside], np.array(own, np.uint64)]))


def _unit(seed: np.ndarray) -> np.ndarray:
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures of ``n`` texts: registers agree with the odds of the probability Jaccard index.

    Every shingle is a Poisson process with its weight as the rate; each arrival goes to a register that its hash picks, and a register keeps the shingle
    that arrived first. A shingle stops as soon as its next arrival is later than all registers of its text. Texts without shingles keep zeros.
    """
    first, sign = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        seed = common.mix64(shingle + np.uint64((step * common.BASE) & (2**64 - 1)))
        time = time - np.log(_unit(seed)) / weight
        limit = first.reshape(n, registers).max(1)
        go = time < limit[doc]
        doc, shingle, weight, time, seed = doc[go], shingle[go], weight[go], time[go], seed[go]
        at = doc * registers + (common.mix64(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sign[at[won]] = shingle[won]
    return sign.reshape(n, registers)


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of ``rows`` registers, told apart by the band's number."""
    parts = sign.reshape(len(sign), -1, rows)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for r in range(rows):
        out = common.mix64(out * np.uint64(common.BASE) + parts[:, :, r])
    return out.view(np.int64)


def alike(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """The probability Jaccard index of the shingle counts of each pair of texts; without shingles on a side it is 0.

    With counts x and y it is the sum, over shared shingles i, of 1 / sum_j max(x_j/x_i, y_j/y_i): the Jaccard index where no shingle repeats.
    """
    n = len(one)
    a, b = shingle_counts(one), shingle_counts(other)
    pair, value = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    x, y = np.concatenate([a[2], np.zeros(len(b[2]))]), np.concatenate([np.zeros(len(a[2])), b[2]])
    order = np.lexsort((value, pair))
    pair, value, x, y = pair[order], value[order], x[order], y[order]
    if not len(pair):
        return np.zeros(n)
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (value[1:] != value[:-1])))
    pair, x, y = pair[new], np.add.reduceat(x, new), np.add.reduceat(y, new)
    order = np.lexsort((-np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0), pair))
    pair, x, y = pair[order], x[order], y[order]
    begin = np.searchsorted(pair, np.arange(n + 1))
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    to_x = sum_x[1:] - sum_x[begin[pair]]
    rest_y = sum_y[begin[pair + 1]] - sum_y[1:]
    both = (x > 0) & (y > 0)
    part = 1 / (to_x[both] / x[both] + rest_y[both] / y[both])
    return np.bincount(pair[both], part, minlength=n)


def sketches(sds: DataFrame) -> DataFrame:
    """``sds_id``, ``node`` (MD5 of the text: equal texts are one node) and ``bands`` of every sheet; texts without words have no bands."""
    kind = dict(sds.dtypes)["sds_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text.chunks(batches):
            doc, shingle, count = shingle_counts(texts)
            own = bands(prob_minhash(doc, shingle, count.astype(np.float64), len(texts)))
            lists = own.tolist()
            for t in np.setdiff1d(np.arange(len(texts)), doc):
                lists[t] = []
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(lists, pa.list_(pa.int64()))], ["sds_id", "node", "bands"])

    return sds.select("sds_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node")).mapInArrow(run, f"sds_id {kind}, node binary, bands array<long>")


def beyond(one: list[bytes], other: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of ``other`` that its partner in ``one`` lacks: (pair, shingle) in order."""
    a, b = shingle_counts(one), shingle_counts(other)
    pair, value, mine = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.repeat([False, True], [len(a[0]), len(b[0])])
    order = np.lexsort((mine, value, pair))
    pair, value, mine = pair[order], value[order], mine[order]
    new = mine & np.append(True, (pair[1:] != pair[:-1]) | (value[1:] != value[:-1]))[: len(mine)]
    return pair[new], value[new]


def compared(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, more: bool = False) -> DataFrame:
    """The ``pairs`` (a, b) with ``linked``, whether their texts are ``similarity`` alike, and with ``more`` the shingles of b that a lacks.

    ``texts``: node, text, a row for each node in a pair. Either side may be hot; Spark splits these joins.
    """
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), "text"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts_b in text.chunks(batches, limit=text.CHUNK_BYTES // 2):
            texts_a = [x or b"" for x in rows.column(2).cast(pa.large_binary()).to_pylist()]
            columns = [rows.column(0), rows.column(1), pa.array(alike(texts_a, texts_b) >= similarity - ROUNDING)]
            if more:
                pair, value = beyond(texts_a, texts_b)
                at = np.searchsorted(pair, np.arange(len(texts_b) + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "more"][: len(columns)])

    return both.select("a", "b", "text_a", "text").mapInArrow(run, "a binary, b binary, linked boolean" + ", more array<long>" * more)


def _trees(links: DataFrame) -> tuple[DataFrame, int]:
    """``node`` and ``root`` of the links (a, b) of each chunk, as if there were no other, and the number of chunks; a task holds one. The root is the node of least hash."""
    kind = dict(links.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rows for rows in batches if len(rows)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([x for c in (0, 1) for x in rows.column(c).chunks]).dictionary_encode()
        order = np.zeros(len(ends.dictionary), np.int64)
        order[ends.indices.to_numpy()] = np.concatenate([rows.column(c).to_numpy() for c in (2, 3)])
        order = np.argsort(order, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
        root = np.arange(len(order))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(order)), ends.dictionary.take(pa.array(order[root]))], ["node", "root"])

    links = common.written(links.select("a", "b"), "links")
    chunks = max(1, -(-links.count() // CHUNK))
    dealt = links.select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    return common.written((dealt.coalesce(1) if chunks == 1 else dealt.repartition(chunks)).mapInArrow(run, f"node {kind}, root {kind}"), "trees"), chunks


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (one node of its component, the same for all of it) for every node of the links (a, b).

    Links are dealt into chunks of CHUNK, each a task's own forest. A node that stands in trees of several chunks links their roots, and these links, among roots alone,
    are followed in the same way until one chunk holds them. Roots are least by hash, so that a long chain loses a third of its nodes each time, however it is dealt.
    """
    trees, chunks = _trees(links)
    if chunks == 1:
        return trees
    first = F.min(F.struct(F.xxhash64("root").alias("hash"), "root"))["root"]
    lows = common.written(trees.groupBy("node").agg(first.alias("low")), "lows")
    cross = common.written(trees.join(lows, "node").where("root != low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct(), "cross")
    if cross.isEmpty():
        return lows.select("node", F.col("low").alias("root"))
    to = components(cross).select(F.col("node").alias("low"), "root")
    return common.written(lows.join(to, "low", "left").select("node", F.coalesce("root", "low").alias("root")), "roots")


def _starred(members: DataFrame, label: str) -> DataFrame:
    """Pairs (a, b) of each bucket's leader, the member of most ``mass``, with its other members. ``members``: bucket, node, mass."""
    heads = members.groupBy("bucket").agg(F.max(F.struct("mass", "node"))["node"].alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    heads = common.written(heads, f"{label}-leaders")
    return members.join(heads, "bucket").where("node != leader").select("bucket", F.col("leader").alias("a"), F.col("node").alias("b"))


def fine_sketches(texts: DataFrame) -> DataFrame:
    """``node`` and ``sign``, FINE registers of a byte each, of texts (node, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, every in text.chunks(batches):
            for at in range(0, len(every), 500):
                part = every[at : at + 500]
                doc, shingle, count = shingle_counts(part)
                sign = common.mix64(prob_minhash(doc, shingle, count.astype(np.float64), len(part), FINE)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(at, len(part)), pa.array([x.tobytes() for x in sign], pa.binary())], ["node", "sign"])

    return texts.select("node", "text").mapInArrow(run, "node binary, sign binary")


def _fresh_bands(members: DataFrame, turn: int) -> DataFrame:
    """``members`` (node, root, sign) once for each of FRESH bands of LONG registers, drawn anew each turn: ``bucket``, ``node``, ``root``, ``sign``."""
    rng = np.random.default_rng(turn)
    drawn = [rng.choice(FINE, LONG, replace=False) for _ in range(FRESH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not len(rows):
                continue
            sign = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.uint64)
            own = np.concatenate([bands(sign[:, at], LONG) ^ np.int64(hash((turn, k))) for k, at in enumerate(drawn)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own.tolist(), pa.list_(pa.int64())), *(rows.column(k) for k in range(3))], ["buckets", "node", "root", "sign"])

    rows = members.select("node", "root", "sign").mapInArrow(run, "buckets array<long>, node binary, root binary, sign binary")
    return rows.select(F.explode("buckets").alias("bucket"), "node", "root", "sign")


def likely_partners(rows: DataFrame, similarity: float) -> DataFrame:
    """For each member of a bucket the TRIES leaders of other roots whose sketches agree most and allow ``similarity``: ``a`` (leader), ``b``, ``agree``.

    ``rows``: bucket, node, root, sign. The first members of a bucket lead it, LEADERS of them, at most OF_ROOT of one root; a task holds the leaders of one bucket and one batch.
    """
    least = FINE * similarity - DEVIATIONS * float(np.sqrt(FINE * similarity * (1 - similarity)))

    def pairs(node: list, root: list, sign: np.ndarray, leaders: list, per_root: dict) -> tuple[list, list, list]:
        for i in range(len(node)):
            if len(leaders) >= LEADERS:
                break
            if per_root.get(root[i], 0) < OF_ROOT:
                per_root[root[i]] = per_root.get(root[i], 0) + 1
                leaders.append((node[i], root[i], sign[i]))
        number = {r: k for k, r in enumerate({*root, *(x[1] for x in leaders)})}
        lead_root = np.array([number[x[1]] for x in leaders])
        agree = np.stack([np.count_nonzero(sign == x[2], axis=1) for x in leaders], axis=1)
        agree[np.array([number[r] for r in root])[:, None] == lead_root[None, :]] = 0
        best = np.argsort(-agree, axis=1, kind="stable")[:, :TRIES]
        at, k = np.nonzero(np.take_along_axis(agree, best, 1) >= least)
        return [leaders[j][0] for j in best[at, k]], [node[i] for i in at], agree[at, best[at, k]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, per_root = None, [], {}
        for rows in batches:
            bucket = rows.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
            out: tuple[list, list, list] = ([], [], [])
            for begin, end in zip(edges, edges[1:], strict=False):
                if int(bucket[begin]) != now:
                    now, leaders, per_root = int(bucket[begin]), [], {}
                part = rows.slice(begin, end - begin)
                sign = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, FINE)
                for one, more in zip(out, pairs(part.column(1).to_pylist(), part.column(2).to_pylist(), sign, leaders, per_root), strict=True):
                    one += more
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["a", "b", "agree"])

    return rows.select("bucket", "node", "root", "sign").repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("bucket", "node")).mapInArrow(run, "a binary, b binary, agree int")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, node, root) of buckets of several roots, dealt so that any two members of different roots meet in one block: ``bucket``, ``low``, ``high``, ``part``, ``node``, ``root``.

    A bucket of up to BLOCK members is one block. Else it is cut into parts, and a block holds two of them; members of a bucket's largest root, which need
    not meet each other, have parts of their own that meet the other parts only. So a block is small, whatever a bucket holds.
    """
    own = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    sizes = sizes.select("bucket", F.col("main.root").alias("main"), (F.col("n") <= BLOCK).alias("one"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("others"), F.ceil(F.col("main.n") / BLOCK).alias("mains"))
    is_main, drawn = F.col("root") == F.col("main"), F.xxhash64("bucket", "node")
    part = F.when(F.col("one"), F.lit(0)).when(is_main, F.col("others") + F.pmod(drawn, "mains")).otherwise(F.pmod(drawn, "others"))
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("one"), F.lit(0)).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    dealt = rows.join(sizes, "bucket").select("bucket", "node", "root", part.alias("part"), F.explode(meets).alias("other"))
    return dealt.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "root")


def _near(sign: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (from ``left``, from ``right``) of all pairs of different roots whose sketches allow ``similarity``, each once. Both sides are in order of root, and the same or without common places.

    Sketches are compared by a bit of each register, and those that are near by whole registers.
    """
    half, same = (1 + similarity) / 2, len(left) == len(right) and bool((left == right).all())
    least, least_bits = (FINE * s - SURE * float(np.sqrt(FINE * s * (1 - s))) for s in (similarity, half))
    bits = np.packbits(sign & 1, axis=1).view(np.uint64).T.copy()
    step = max(1, (1 << 18) // max(1, len(right)))
    for k in range(0, len(left), step):
        x = left[k : k + step]
        y = right[int(np.searchsorted(root[right], root[x[0]], side="right")) :] if same else right
        apart = np.zeros((len(x), len(y)), np.uint16)
        for word in bits:
            apart += np.bitwise_count(word[x][:, None] ^ word[y][None, :])
        new = root[x][:, None] < root[y][None, :] if same else root[x][:, None] != root[y][None, :]
        i, j = np.nonzero(new & (apart <= FINE - least_bits))
        for at in range(0, len(i), 1 << 14):
            a, b = x[i[at : at + (1 << 14)]], y[j[at : at + (1 << 14)]]
            keep = np.count_nonzero(sign[a] == sign[b], axis=1) >= least
            yield a[keep], b[keep]


def _block_links(texts: list[bytes], sign: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes (``root``) of a block as all its links would: each pair that sketches allow is verified, unless it is in one class by then.

    Where no shingle repeats in two texts, shared over all shingles is what ``alike`` gives; else the shared mass, which is never less, tells whether to ask it.
    """
    doc, shingle, count = shingle_counts(texts)
    value = np.unique(shingle, return_inverse=True)[1]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(first)
    total = np.bincount(doc, count, minlength=len(texts))
    share, repeats = count / total[doc], np.bincount(doc, count > 1, minlength=len(texts)) > 0
    own, at_class, found = np.zeros(int(value.max(initial=-1)) + 1), root.copy(), []
    for a, b in _near(sign, root, left, right, similarity):
        for i, j in ((i, b[a == i]) for i in np.unique(a)):
            j = j[at_class[j] != at_class[i]]
            mine = slice(first[i], first[i + 1])
            own[value[mine]] = share[mine]
            for at in range(0, len(j), 1_000):
                y = j[at : at + 1_000]
                held = np.repeat(np.arange(len(y)), size[y])
                rows = first[y][held] + np.arange(len(held)) - np.repeat(np.cumsum(size[y]) - size[y], size[y])
                theirs = own[value[rows]]
                both = np.bincount(held, theirs > 0, minlength=len(y))
                linked = both / (size[i] + size[y] - both) >= similarity - ROUNDING
                asked = np.flatnonzero((repeats[y] | repeats[i]) & (np.bincount(held, np.minimum(theirs, share[rows]), minlength=len(y)) >= similarity - 2 * ROUNDING))
                linked[repeats[y] | repeats[i]] = False
                if len(asked):
                    linked[asked] = alike([texts[i]] * len(asked), [texts[k] for k in y[asked]]) >= similarity - ROUNDING
                for k in y[linked].tolist():
                    if at_class[k] != at_class[i]:
                        found.append((int(i), k))
                        at_class[at_class == at_class[k]] = at_class[i]
            own[value[mine]] = 0
    return found


def crossing_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of each block as all links between its members would. ``rows``: bucket, low, high, part, node, root (see ``_blocks``), sign, text. A task holds one block."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        root = np.unique(np.array([x.hex() for x in rows.column("root").to_pylist()]), return_inverse=True)[1]
        order = np.argsort(root, kind="stable")
        part = rows.column("part").to_numpy()[order]
        left, right = (order[part == rows.column(c)[0].as_py()] for c in ("low", "high"))
        sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(-1, FINE)
        texts = [x or b"" for x in rows.column("text").cast(pa.large_binary()).to_pylist()]
        node, found = rows.column("node").to_pylist(), _block_links(texts, sign, root, left, right, similarity)
        return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.binary()), pa.array([node[j] for _, j in found], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for rows in batches:
            if not len(rows):
                continue
            key = np.stack([rows.column(k).to_numpy() for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if tuple(key[begin]) != now:
                    if held:
                        yield block(pa.Table.from_batches(held))
                    now, held = tuple(key[begin]), []
                held.append(rows.slice(begin, end - begin))
        if held:
            yield block(pa.Table.from_batches(held))

    dealt = rows.select("bucket", "low", "high", "part", "node", "root", "sign", "text").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(run, "a binary, b binary")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (node, root) with all roots that ``links`` (a, b) connect replaced by one of them."""
    ends = common.written(_ends(members, links).select("x", "y").distinct(), "joins")
    if ends.isEmpty():
        return members
    to = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return common.written(members.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "members")


def _remaining(met: DataFrame, members: DataFrame, signs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join what still stands in different classes of one bucket as all pairs there would: the exact way for what rounds leave.

    ``met``: bucket, node; ``members``: node, root. Every such pair is compared by its sketches and, if these allow, verified, inside blocks of a bucket. Where very many
    classes share a bucket the comparisons grow with their pairs; a block, and what it gives, does not.
    """
    blocks = _blocks(common.written(met.join(members, "node").select("bucket", "node", "root"), "met"))
    return common.written(crossing_links(blocks.join(signs, "node").join(texts.select("node", "text"), "node"), similarity), "crossing")


def _ends(members: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (a, b and more) between ``members`` (node, root) of different roots, with these roots as ``x`` and ``y``."""
    of = members.select("node", "root")
    return links.join(of.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x != y")


def _hooked(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (node, root) with each root that ``links`` (a, b) join to lesser ones replaced by the least of these; closing chains takes further rounds."""
    to = _ends(members, links).select(F.greatest("x", "y").alias("root"), F.least("x", "y").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
    return members.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _settled(members: DataFrame, roots: DataFrame, links: DataFrame, tried: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Further links (a, b) between members of different classes that share a bucket.

    ``members``: bucket, node; ``roots``: node, root, for the nodes that have links; ``links``: more of these, not in ``roots`` yet; ``tried``: pairs (a, b) found not alike.
    Where each of these buckets is one block of ``_remaining`` that is all. Else rounds spare it most pairs before.
    Each round bands the members of such buckets anew, with longer bands, so that buckets shrink to members that are nearly alike. Inside a bucket every
    member's sketch is compared with those of the leaders, and its likeliest untried partners are verified; classes that link are joined, until DRY rounds in
    a row (one) find no link. So a round's work grows with the members, never with their pairs. All pairs that are left then, in different classes,
    follow in ``_remaining``.
    """
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = common.written(named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("bucket", "n"), "mixed")
    open_members = common.written(named.join(mixed, "bucket", "left_semi").select("node", "root").distinct(), "unsettled")
    found = tried.select("a", "b").limit(0)
    if open_members.isEmpty():
        return found
    met, members = members, open_members
    signs = common.written(fine_sketches(texts.join(open_members.select("node"), "node", "left_semi")), "fine-sketches")
    if mixed.where(F.col("n") > BLOCK).isEmpty():
        return _remaining(met, _joined(members, links), signs, texts, similarity)
    members = common.written(_hooked(members, links), "members")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    turn = dry = 0
    while dry < DRY:
        turn += 1
        rows = common.written(_fresh_bands(members.join(signs, "node"), turn), "fresh-bands")
        sizes = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("bucket", F.ceil(F.col("n") / CROWD).alias("parts"))
        # a crowded bucket is dealt into parts, others each turn
        part = F.when(F.col("parts") > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("node", F.lit(turn)), "parts"))).otherwise(F.col("bucket"))
        likely = likely_partners(rows.join(sizes, "bucket").withColumn("bucket", part), similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("b").alias("of"), "agree").join(tried, ["a", "b"], "left_anti")
        likely = likely.groupBy("of").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "a", "b")), asc=False), 1, TRIES).alias("best"))
        new = likely.select(F.explode("best").alias("x")).select("x.a", "x.b").distinct()
        seen = common.written(compared(new, texts, similarity), "tried")
        now = seen.where("linked").select("a", "b")
        tried = tried.unionByName(seen.where("not linked").select("a", "b"))
        if now.isEmpty():
            dry += 1
            continue
        dry = 0
        found = found.unionByName(now)
        members = common.written(_hooked(members, now), "members")
    return found.unionByName(_remaining(met, _joined(members, links.unionByName(found)), signs, texts, similarity))


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``node`` is not ``wanted``, by a bitmap of hashed nodes of SIEVE bits; a join has to follow. So texts that nobody needs are not shuffled."""
    bit = F.pmod(F.xxhash64("node"), F.lit(SIEVE))
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, int(bitmap_bit_position(_bit) div 8) + 1, 1)")), 16, 10).cast("int")
    held = F.expr("bitmap_bit_position(_bit) % 8").cast("int")
    met = rows.withColumn("_bit", bit).withColumn("_page", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_page")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), held).cast("int")) != 0).drop("_bit", "_page", "_map")


def near_duplicates(sds: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The class of near duplicates of every sheet: ``sds_id``, ``class_id`` (its least ``sds_id``), ``node`` (the text's MD5) and ``keeps`` (this sheet stands for its class).

    ``sds``: sds_id, text string. Equal texts are one class. Different texts are linked if the probability Jaccard index of their shingles of five words
    is ``similarity`` or more, and classes are what links connect. Of each band's bucket one member leads, the one that meets most others over all bands,
    and the others are verified against it. Members that a leader did not take in are tried twice more, against the leaders of smaller groups: those it did
    not take in from one bucket, and those that share a shingle which the leader lacks. Two texts that are this alike, and neither of them like the leader
    because of what was added to it, must share such a shingle. What then still stands in different classes of one bucket is banded anew and tried in
    rounds, see ``_settled``, until a round finds no link; then all pairs of a bucket that are left, in different classes, are compared by
    their sketches and verified, see ``_remaining``. So two texts that share a bucket and are alike end in one class, whatever the group holds.

    Null and empty texts are equal to each other; texts without words are linked to nothing. A text of fewer than five words is one shingle. Repeated rows
    stay, and share ``keeps``. Other columns are ignored. No rows in, no rows out.
    """
    rows = common.written(sketches(sds), "sketches")
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"))
    met = common.written(nodes.select("node", F.explode("bands").alias("bucket")), "buckets")
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(common.written(sizes, "bucket-sizes"), "bucket")
    mass = common.written(met.groupBy("node").agg(F.sum("n").alias("mass"), F.collect_list("bucket").alias("buckets")), "mass")
    met, mass = mass.select("node", "mass", F.explode("buckets").alias("bucket")), mass.select("node", "mass")
    starred = common.written(_starred(met, "bands"), "starred")
    with_text = sds.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text", "sds_id")
    # one sheet stands for each node that shares a bucket, so that copies are not read twice
    chosen = rows.join(mass.select("node"), "node", "left_semi").groupBy("node").agg(F.min("sds_id").alias("sds_id"))
    texts = common.written(_sieved(with_text, mass.select("node")).join(chosen, ["node", "sds_id"]).select("node", "text").dropDuplicates(["node"]), "shared-texts")
    seen = common.written(compared(starred.select("a", "b").distinct(), texts, similarity, more=True), "compared")
    links = seen.where("linked").select("a", "b")
    roots = components(links)
    # leaders of two or more, not all of which they took in
    left = common.written(seen.groupBy("a").agg(F.count_if(~F.col("linked")).alias("out"), F.count(F.lit(1)).alias("n")).where("out > 0 and n > 1").select("a"), "left-out")
    apart = starred.join(seen.where("not linked").select("a", "b"), ["a", "b"]).select(F.xxhash64("bucket", F.lit("rest")).alias("bucket"), F.col("b").alias("node"))
    added = seen.join(left, "a").select(F.col("b").alias("node"), "a", F.explode("more").alias("shingle")).select(F.xxhash64("a", "shingle").alias("bucket"), "node")
    again = _starred(common.written(apart.unionByName(added).join(mass, "node"), "second"), "second").select("a", "b").distinct()
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    new = again.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = common.written(compared(new, texts, similarity).where("linked").select("a", "b"), "more-links")
    last = _settled(starred.select("bucket", F.col("b").alias("node")), roots, more, seen.where("not linked"), texts, similarity)
    more = more.unionByName(last)
    if not more.isEmpty():
        # the classes so far stand for their links, so that only classes that join are followed again
        at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        ends = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
        ends = common.written(ends, "ends")
        to = components(ends).select(F.col("node").alias("of"), F.col("root").alias("to"))
        every = roots.unionByName(ends.select(F.col("a").alias("node"), F.col("a").alias("root"))).unionByName(ends.select(F.col("b").alias("node"), F.col("b").alias("root"))).dropDuplicates(["node"])
        roots = every.join(to, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
    named = common.written(rows.select("sds_id", "node").join(roots, "node", "left").select("sds_id", "node", F.coalesce("root", "node").alias("root")), "named")
    first = common.written(named.groupBy("root").agg(F.min(F.struct("sds_id", "node")).alias("first")), "first")
    return named.join(first, "root").select("sds_id", F.col("first.sds_id").alias("class_id"), "node", (F.col("sds_id").eqNullSafe(F.col("first.sds_id")) & (F.col("node") == F.col("first.node"))).alias("keeps"))


def one_of_each(rows: DataFrame, key: str = "sds_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class of near duplicates, the one of least ``key``, with all its columns.

    Null texts count as empty, and all sheets without words are one class. A null key is the greatest only where it alone is there. Of rows that share key
    and text the one whose other columns come first as JSON stays. Any column names will do. No rows in, no rows out.
    """
    own = F.col(f"`{text_column}`").cast("string")
    whole = rows.select(F.col(f"`{key}`").alias("sds_id"), own.alias("text"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    kept = near_duplicates(whole.select("sds_id", "text"), similarity).where("keeps").select(F.col("sds_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct()
    node = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    met = whole.join(kept, (node == F.col("kept_node")) & F.col("sds_id").eqNullSafe(F.col("kept_id")))
    rest = F.to_json(F.struct(F.lit(0), *[F.col(f"row.`{c}`") for c in rows.columns if c != text_column]))
    first = met.groupBy("kept_node").agg(F.min_by("row", rest).alias("row"))
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns])


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``."""
    return near_duplicates(common.sds_texts(common.table(spark, sf_dir, "documents"))).select(F.col("sds_id").alias("doc_id"), "class_id", "keeps")
