"""Each operator against brute force or an exact round trip, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chemledger.llm import ann, decontaminate, neardup, pieces, quality, seeds, sharding, suffixes, surrogates, toxicity

SCHEMA = "sds_id long, text string, node string, list int, score double, kept string, key long, row int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, shared passages, null, empty, short and long ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(40)]
    passage = prose(rng, 60)
    texts: list[str | None] = [*base, base[0], base[0], base[1], None, None, "", "", " \t\n", "one two", "one two", "zażółć gęślą jaźń ▁ x", "x" * 700, "x" * 450, prose(rng, 5000)]
    texts += [base[k] + " " + passage for k in range(5, 9)] + [passage[:250] + base[9]] + [passage]
    for k in range(10, 14):
        w = base[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def sds(spark):
    rows = [(i, t, "n", 1, 0.5, "k", 7, 3) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["sds_id"]: r for r in df.collect()}


def test_words_of_repeats(sds, none):
    got = by_id(seeds.dedup_words(sds))
    seen: set[tuple] = set()
    for i, t in corpus():
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for x in range(len(w) - 19):
            key = tuple(w[x : x + 20])
            if key in seen:
                drop[x : x + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(v for v, d in zip(w, drop, strict=True) if not d).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(drop), kept), i
    assert seeds.dedup_words(none).count() == 0


def test_bytes_of_repeats(sds, none):
    got = by_id(suffixes.dedup_bytes(sds, bucket_rows=7))
    texts = {i: (t or "").encode() for i, t in corpus()}
    times = Counter(t[x : x + 200] for t in texts.values() for x in range(len(t) - 199))
    for i, t in texts.items():
        drop = np.zeros(len(t), bool)
        for x in range(len(t) - 199):
            if times[t[x : x + 200]] > 1:
                drop[x : x + 200] = True
        runs = int((np.diff(np.append(False, drop).astype(int)) > 0).sum())
        kept = np.frombuffer(t, np.uint8)[~drop].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(t), int(drop.sum()), runs, kept), i
    assert suffixes.dedup_bytes(none).count() == 0


def test_windows_beyond_the_leader(spark):
    """Passages that meet only in part: every pair shares another stretch, so that no single partner settles a text."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 30) for _ in range(3))
    texts = [f"{a} {b}", f"{b} {c}", f"{c} {a}", f"{a[:70]} {b[:120]} {c[5:]}", f"q {b} {c[:80]}", f"{a[90:]} {b} z"]
    df = spark.createDataFrame(list(enumerate(texts)), "sds_id long, text string")
    got = by_id(suffixes.dedup_bytes(df, window=60, seed=16, bucket_rows=2))
    times = Counter(t.encode()[x : x + 60] for t in texts for x in range(len(t.encode()) - 59))
    for i, t in enumerate(texts):
        drop = np.zeros(len(t.encode()), bool)
        for x in range(len(drop) - 59):
            if times[t.encode()[x : x + 60]] > 1:
                drop[x : x + 60] = True
        assert got[i]["n_removed"] == drop.sum(), i


def test_multikey_quicksort():
    rng = random.Random(2)
    one = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 40))) for _ in range(900)] + [b"x" * 50] * 90
    two = [bytes(rng.choice(b"\0a") for _ in range(rng.randint(0, 12))) for _ in one]
    order = suffixes.multikey_quicksort(one, two)
    assert [(one[i], two[i]) for i in order] == sorted(zip(one, two, strict=True))
    assert len(suffixes.multikey_quicksort([], [])) == 0


def test_pieces_round_trip(sds, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    vocab = pieces.vocabulary()
    coded = pieces.encode_sds(sds, vocab)
    got, back = by_id(coded), by_id(pieces.decode_sds(coded, vocab))
    for i, t in corpus():
        t = t or ""
        assert got[i]["pieces"] == own.encode(t), i
        assert got[i]["n_pieces"] == len(got[i]["pieces"])
        assert back[i]["text"] == t.replace("▁", " ")
        assert got[i]["exact"] == ("▁" not in t)
    assert pieces.encode_sds(none, vocab).count() == 0


def test_pieces_of_odd_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    own, m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Matcher(pieces.vocabulary())
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b ", "a\r\n\x00", "    " * 9 + "x", "ab" * 900, "a" * 3000] + ["".join(rng.choice("ab c\n\tin thé中😀  ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    ids, count = m.texts([t.encode() for t in texts])
    at = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(t) for t in texts]


def test_sharding(sds, none, spark):
    out = sharding.shard_sds(sds, sharding.topology(12, base=12), sharding.topology(13, base=12)).collect()
    texts = dict(corpus())
    for r in out:
        t = (texts[r["sds_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 16, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 12)
    slots: dict[int, list[int]] = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_sds(none, sharding.topology(4)).count() == 0
    ids = spark.range(20_000).select(F.col("id").alias("sds_id"), F.lit("t").alias("text"))
    tree = [sharding.Shard(0, "a", "r", 1.0), sharding.Shard(1, "a", "r", 3.0), sharding.Shard(2, "b", "s", 4.0)]
    share = {r["shard"]: r["count"] / 20_000 for r in sharding.shard_sds(ids, tree).groupBy("shard").count().collect()}
    assert share == pytest.approx({0: 0.125, 1: 0.375, 2: 0.5}, abs=0.02)
    heavier = [tree[0], sharding.Shard(1, "a", "r", 5.0), tree[2]]
    moved = sharding.shard_sds(ids, tree, heavier).where("shard <> grown_shard").select("shard", "grown_shard").distinct().collect()
    assert all(not (r["shard"] == 0 and r["grown_shard"] == 2) for r in moved)  # nothing enters the region whose weight stays
    with pytest.raises(ValueError):
        sharding.shard_sds(none, [])


def test_near_duplicates(sds, none):
    got = by_id(neardup.near_duplicates(sds))
    texts = dict(corpus())
    shingles = {}
    for i, t in texts.items():
        w = (t or "").split()
        shingles[i] = Counter(tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))) if w else Counter()
    for i in texts:
        for j in texts:
            a, b = shingles[i], shingles[j]
            if (texts[i] or "") == (texts[j] or "") or (a and b and sum((a & b).values()) / sum((a | b).values()) >= 0.82):
                assert got[i]["class_id"] == got[j]["class_id"], (i, j)
            elif not set(a) & set(b):
                assert got[i]["class_id"] != got[j]["class_id"], (i, j)
    for c in {r["class_id"] for r in got.values()}:
        assert sum(r["keeps"] for r in got.values() if r["class_id"] == c) == 1
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(sds.unionByName(sds))
    assert kept.columns == sds.columns and kept.count() == len({r["class_id"] for r in got.values()})


def test_copies_of_a_variant_are_found(spark):
    """All copies share a base that is like none of them; those of one variant are alike and must meet without the base."""
    rng = random.Random(4)
    base = prose(rng, 120).split()

    def edited(words: list[str], n: int) -> list[str]:
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"e{rng.random()}"
        return out

    variant = edited(base, 6)
    texts = [base] + [edited(base, 6) for _ in range(30)] + [variant] + [edited(variant, 1) for _ in range(6)]
    got = by_id(neardup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "sds_id long, text string")))
    assert len({got[i]["class_id"] for i in range(31, 38)}) == 1


def shortened(seed: int, groups: int, copies: int) -> list[str]:
    """Long texts, each with copies that lack some passages of it, and pairs among these that are 0.8 alike to the shingle."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"{rng.choice(WORDS)}{k}" for k in range(204)]
        out.append(base)
        for _ in range(copies):
            lost = {k for _ in range(rng.randint(1, 5)) for at in [rng.randrange(204)] for k in range(at, min(204, at + rng.randint(4, 25)))}
            out.append([w for k, w in enumerate(base) if k not in lost])
        out += [base[:104], base[:84]]  # 100 and 80 shingles: exactly 0.8
    return [" ".join(w) for w in out]


def brute_classes(texts: list[str], similarity: float = 0.8) -> list[int]:
    """The least place of each text's class, from all pairs; shingles must not repeat inside a text."""
    sets = [{tuple(w[x : x + 5]) for x in range(len(w) - 4)} for w in (t.split() for t in texts)]
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(sets):
        held[i, [number[y] for y in x]] = 1
    both, size = held @ held.T, held.sum(1)
    linked = both >= similarity * (size[:, None] + size - both) - 1e-3
    low = np.arange(len(texts))
    while True:
        new = np.where(linked, low, len(texts)).min(1)
        if (new == low).all():
            return low.tolist()
        low = new


def test_shortened_copies_are_as_in_brute_force(spark):
    texts = shortened(11, 1, 1_000)
    want = brute_classes(texts)
    assert len(set(want)) > 8
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "sds_id long, text string")))
    assert [got[i]["class_id"] for i in range(len(texts))] == want


def test_likely_partners_of_other_roots(spark):
    """Members meet the leaders of other roots that agree enough, the best first, and never their own root."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, neardup.FINE).astype(np.uint8)
    rows, sign = [], {}
    for i in range(200):
        own = base.copy()
        changed = rng.choice(neardup.FINE, int(rng.integers(0, 200)), replace=False)
        own[changed] = rng.integers(0, 256, len(changed))
        sign[bytes([i])] = own
        rows.append((i % 3, bytes([i]), bytes([i % 7]), own.tobytes()))
    root = {r[1]: r[2] for r in rows}
    got = [(bytes(r["a"]), bytes(r["b"]), r["agree"]) for r in neardup.likely_partners(spark.createDataFrame(rows, "bucket long, node binary, root binary, sign binary"), 0.8).collect()]
    assert got and all(root[a] != root[b] and a[0] % 3 == b[0] % 3 and n == (sign[a] == sign[b]).sum() for a, b, n in got)
    assert max(Counter(b for _, b, _ in got).values()) == neardup.TRIES


@pytest.mark.parametrize("copies", [4_000])
def test_recall_in_large_groups(spark, copies):
    """Links of a large group of shortened copies that join the same class, against all pairs at exactly 0.8."""
    texts = shortened(12, 1, copies)
    want = brute_classes(texts)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "sds_id long, text string")))
    right = sum(got[i]["class_id"] == w for i, w in enumerate(want))
    print(f"recall {copies}: {right / len(want):.4f} of texts in their class, {len(set(want))} classes, {len({r['class_id'] for r in got.values()})} found")
    assert right >= 0.9 * len(want)


def test_long_texts_are_anchored_in_parts(monkeypatch):
    """Anchors do not hang on where a text longer than a position's bits is cut."""
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (5_000, 0, 230, 150, 1_300)] + [b"x" * 2_000]
    data, at = suffixes.text.joined(texts)
    whole = suffixes.anchored(data, at)
    for bits in (9, 10, 12):
        monkeypatch.setattr(suffixes, "_POSITION_BITS", bits)
        assert all((a == b).all() for a, b in zip(suffixes.anchored(data, at), whole, strict=True))


def test_probability_jaccard():
    one, other = [b"a b c d e f g h i j", b"a b c d e a b c d e", b"", b"x"], [b"a b c d e f g h i k", b"a b c d e", b"", b"x"]
    shared = 5 / 7
    value = neardup.alike(one, other)
    assert value[0] == pytest.approx(shared) and value[2] == 0 and value[3] == 1
    counts = [neardup.shingle_counts(t) for t in (one, other)]
    signs = [neardup.prob_minhash(d, s, n.astype(float), 4, 512) for d, s, n in counts]
    for p in (0, 1, 3):
        assert (signs[0][p] == signs[1][p]).mean() == pytest.approx(value[p], abs=0.08)


def test_decontamination(sds, none, spark):
    texts = dict(corpus())
    item = " ".join(texts[3].split()[10:50])
    edited = item.split()
    edited[20] = "other"
    items = spark.createDataFrame([(1, item), (2, " ".join(edited)), (3, None), (4, ""), (5, "one two"), (6, prose(random.Random(77), 30)), (7, item.upper() + "!")], "item_id long, text string")
    got = {(r["sds_id"], r["item_id"]): r["similarity"] for r in decontaminate.benchmark_leaks(sds, items, block_items=2).collect()}
    short = [i for i, t in texts.items() if "one two" in (t or "")]
    same = [i for i, t in texts.items() if t == texts[3]]
    assert set(got) == {(i, k) for i in same for k in (1, 7)} | {(i, 5) for i in short} | {(i, 2) for i in same if 26 / 36 * 1.2 >= 0.8 and (i, 2) in got}
    assert got[(3, 1)] == 1.0
    kept = decontaminate.without_leaks(sds, items)
    assert kept.columns == sds.columns and {r["sds_id"] for r in kept.collect()} == set(texts) - {i for i, _ in got}
    assert decontaminate.benchmark_leaks(none, items).count() == 0
    assert decontaminate.benchmark_leaks(sds, items.limit(0)).count() == 0


def test_fingerprints_within_the_radius_share_a_block():
    rng = np.random.default_rng(3)
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        assert min(Counter(flips // 8)[b] for b in range(8)) <= decontaminate.BLOCK_RADIUS


def test_surrogates(spark, none):
    texts = [
        (1, "Mail Anna.Nowak7@Firma-x.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111 and 4111111111111111."),
        (2, "anna.nowak7@firma-x.example.com; ip 10.20.30.40, id 123-45-6789, key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
        (3, "Frau Maria Kowalska met Herr Jan Nowak and Господин Иван Петров. +17435553824"), (4, None), (5, ""), (6, "no data at all"), (6, "no data at all"), (7, "IBAN DE44500105175407324931!"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "sds_id long, text string, mentions string")
    rows = surrogates.surrogate_sds(df, "k", keep="mentions").collect()
    assert len(rows) == 8 and {r["mentions"] for r in rows} == {"x"}
    got = {r["sds_id"]: r for r in rows}
    assert (got[4]["text"], got[5]["text"], got[6]["text"], got[4]["n_entities"]) == (None, "", "no data at all", 0)
    one, two, three = got[1]["text"], got[2]["text"], got[3]["text"]
    assert [got[i]["n_entities"] for i in (1, 2, 3, 7)] == [4, 4, 4, 1]
    mails = [re.search(r"\S+@\S+?(?=[ ;])", t).group() for t in (one, two)]
    assert mails[0].lower() == mails[1].lower() != "anna.nowak7@firma-x.example.com" and mails[0].endswith(".com")
    cards = re.search(r"card ([\d ]{19}) and (\d{16})", one).groups()
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    digits = [int(c) for c in cards[1]]
    assert sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+(\d) \((\d{3})\) (\d{3})-(\d{4})", one) and "555-3824" not in one
    assert "".join(re.search(r"\+(\d) \((\d{3})\) (\d{3})-(\d{4})", one).groups()) == re.search(r"\+(\d{11})", three).group(1)
    assert re.search(r"ip \d+\.\d+\.\d+\.\d+, id \d{3}-\d{2}-\d{4}, key [0-9a-f]{40}$", two)
    women, men, cyrillic = re.match(r"Frau (\S+ \S+) met Herr (\S+ \S+) and Господин (\S+ [^.\s]+)\.", three).groups()
    assert women.split()[0].endswith("la") and men.split()[0].endswith("n") and re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", cyrillic)
    assert got[7]["text"] != "IBAN DE44500105175407324931!" and re.fullmatch(r"IBAN DE\d{20}!", got[7]["text"])
    assert surrogates.surrogate_sds(none, "k").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Draws that collide are drawn again, and none is an entity of the corpus."""
    few = lambda kind, entity, attempt, key: F.concat(F.lit("10.0.0."), (F.pmod(F.crc32(F.concat(entity, attempt.cast("string"))), F.lit(60)) + 10).cast("string"))
    monkeypatch.setattr(surrogates, "drawn", few)
    df = spark.createDataFrame([("IP", f"10.0.0.{k}") for k in range(30)], "kind string, entity string")
    rows = surrogates.surrogate_table(df, "k").collect()
    assert len(rows) == 30 and len({r["surrogate"] for r in rows}) == 30 and not {r["surrogate"] for r in rows} & {r["entity"] for r in rows}


def test_quality(spark, sds, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(30, 200)) if i % 3 else " ".join(f"{w.upper()}!!" for w in prose(rng, rng.randint(30, 200)).split())) for i in range(600)]
    df = spark.createDataFrame(rows, "sds_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400)] + [(3, None), (999_999, 1)], "sds_id long, label int")
    got = by_id(quality.score_quality(df, labels))
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in range(400, 600)]) >= 0.98
    out = by_id(quality.score_quality(sds, labels))
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out.values())
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}
    kept = quality.only_good(sds, labels)
    assert kept.columns == sds.columns


def test_trees_fit_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:2000], y[:2000], trees=40)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert model.feature.shape == model.value.shape and len(model.score(x[:0])) == 0


def test_toxicity(spark, sds, none):
    rng = random.Random(8)
    bad = ["scum", "moron", "idiocy"]
    rows, marks = [], []
    for i in range(900):
        w = prose(rng, rng.randint(30, 120)).split()
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "sds_id long, text string")
    labels = spark.createDataFrame(marks[:600] + [(5, None)], "sds_id long, label int")
    got = by_id(toxicity.score_toxicity(df, labels))
    assert np.mean([got[i]["predicted"] == m for i, m in marks[600:]]) >= 0.97
    out = by_id(toxicity.score_toxicity(sds, labels, df))
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert len({r["score"] for r in toxicity.score_toxicity(df, labels.limit(0)).collect()}) == 1


def test_nnpu_risk_is_held_at_zero():
    doc = np.repeat(np.arange(40), 1)
    feature = np.where(doc < 20, 3, 5)
    model = toxicity.fit_nnpu(doc, feature, doc < 20, 0.5, surprise=0.0)
    assert model.score(np.array([0]), np.array([3]), 1)[0] > 0.5 and np.isfinite(model.weight).all()


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)).round(3)
    x[10:60] = x[10]  # one hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("list", F.lit(1)).withColumn("score", F.lit("s"))
    got: dict[int, list] = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), list_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        score = [sum(a * b for a, b in zip(x[q], x[v], strict=True)) for _, v, _ in found]
        assert [f[2] for f in found] == pytest.approx(score, rel=1e-12)
        assert [f[1:] for f in found] == sorted([f[1:] for f in found], key=lambda f: (-f[1], f[0]))
        all_ = np.delete(x @ x[q], q)
        hit += sum(s >= np.sort(all_)[-20] - 1e-9 for s in score)
    assert hit / (20 * len(got)) >= 0.95
    assert ann.nearest(df.limit(0), df).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0"))
    assert few.count() == 4


def test_recall_does_not_fall_with_the_number_of_lists(spark):
    x = np.random.default_rng(8).normal(size=(4_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    hits = 0
    for r in ann.nearest(df, df.where("vec_id % 40 = 0"), list_rows=2).collect():
        score = x @ x[r["query_id"]]
        score[r["query_id"]] = -np.inf
        hits += r["vec_id"] in np.argsort(-score)[:20]
    assert hits / 2_000 >= 0.9


def test_hashes_do_not_depend_on_place():
    from chemledger.llm import text

    a = text.words([b"p q r s t u", b"", b"q r s"])
    h = text.runs(text.word_hashes(a), 3)
    assert h[1] == h[6]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_graph_of_lists():
    rng = np.random.default_rng(11)
    for centroids in (rng.normal(size=(900, 16)), rng.normal(size=(30, 16)), rng.normal(size=(1, 16)), np.repeat(np.eye(16), 12, axis=0)):
        graph, q = ann.Graph.of(centroids), rng.normal(size=(40, 16))
        true = np.sort(ann._distances(q, centroids), axis=1)
        near, d = graph.search(q, len(centroids))
        assert (np.sort(near, axis=1) == np.arange(len(centroids))).all() and np.allclose(d, true)  # the whole graph can be reached
        near, d = graph.search(q, 200)
        w = min(200, len(centroids))
        assert near.shape == (40, w) and (np.diff(d, axis=1) >= 0).all() and np.allclose(d, ann._distances(q, centroids)[np.arange(40)[:, None], near])
        assert (d[:, :50] <= true[:, : min(w, 50)][:, -1:] + 1e-9).mean() > 0.9


def test_what_rounds_leave_is_compared_in_full(spark, monkeypatch):
    """Without any round, and with blocks far smaller than the buckets, classes are still those of all pairs."""
    monkeypatch.setattr(neardup, "DRY", 0)
    monkeypatch.setattr(neardup, "BLOCK", 48)
    texts = shortened(12, 1, 400)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "sds_id long, text string")))
    assert [got[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("block", [5, 1_000])
def test_blocks_join_classes_as_all_pairs(spark, monkeypatch, block):
    """Every two members of one bucket and different roots meet in a block; texts with and without repeated shingles come out as by their index."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = shortened(5, 1, 40)
    texts += [t + " again and again and again and again and again and again" for t in texts[:15]]
    data = [(bytes([i]), t) for i, t in enumerate(texts)]
    met = spark.createDataFrame([(-7, n, bytes([0 if n[0] < 20 else n[0]])) for n, _ in data], "bucket long, node binary, root binary")
    nodes = spark.createDataFrame(data, "node binary, text string")
    rows = neardup._blocks(met).join(neardup.fine_sketches(nodes), "node").join(nodes, "node")
    got = [(r["a"][0], r["b"][0]) for r in neardup.crossing_links(rows, 0.8).collect()]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    value = neardup.alike(*([texts[p[k]].encode() for p in pairs] for k in (0, 1)))
    links = {p for p, v in zip(pairs, value, strict=True) if v >= 0.8 - 1e-9}

    def classes(found):
        low = [0 if i < 20 else i for i in range(len(texts))]
        for a, b in found:
            low = [low[a] if x == low[b] else x for x in low]
        return sorted([i for i, x in enumerate(low) if x == y] for y in set(low))

    assert all((max(g), min(g)) in links for g in got) and classes(got) == classes(links) and len(classes(links)) > 3


def test_sieve_keeps_what_is_wanted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIEVE", 1 << 17)
    rows = spark.range(5_000).selectExpr("id", "unhex(md5(string(id))) as node")
    left = neardup._sieved(rows, rows.where("id % 50 = 7").select("node"))
    assert left.columns == ["id", "node"]
    got = {r["id"] for r in left.collect()}
    assert {i for i in range(5_000) if i % 50 == 7} <= got and len(got) < 150


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_components_in_chunks(spark, monkeypatch, chunk):
    """A chain, a star and pairs have one root each, whether one task holds all links or none holds more than a few."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 125)] + [(200, 201), (201, 200), (300, 301), (300, 301)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in neardup.components(df).collect()}
    want = [set(range(31)), set(range(100, 125)), {200, 201}, {300, 301}]
    assert set(got) == set().union(*want)
    assert all({got[k] for k in c} <= c and len({got[k] for k in c}) == 1 for c in want)
    assert neardup.components(df.limit(0)).count() == 0


def test_buckets_of_one_block_need_no_rounds(spark, monkeypatch):
    """Where all pairs of each bucket are compared in one block at once, no rounds go before; classes are those of all pairs."""
    monkeypatch.setattr(neardup, "likely_partners", None)
    texts = shortened(12, 1, 150)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "sds_id long, text string")))
    assert [got[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)
