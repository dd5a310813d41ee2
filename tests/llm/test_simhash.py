"""Fingerprints and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from chemledger.llm import simhash as s

SCHEMA = "sds_id long, text string, fingerprint string, bucket int, node string, root string, a int"


def print_of(t: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints: list[int], ids: list) -> list:
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    low: dict = {}
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = x if low.get(r) is None else low[r] if x is None else min(low[r], x)
    return [low[find(i)] for i in range(len(prints))]


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    word = [f"Wort{i}" for i in range(300)]
    base = [" ".join(rng.choice(word) for _ in range(rng.randint(3, 300))) for _ in range(40)]
    out = [*base, None, "", " \t\n", "one", "one TWO", "One two", "Aß ÄÖ \u0085x", "a b c", "A  b\tC", base[0], base[0].upper(), "rep rep rep rep rep"]
    for k in range(20):
        w = base[k].split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    long = [rng.choice(word) for _ in range(3000)]
    for k in range(60):
        out.append(" ".join(long[: 3000 - k]))
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + rows[:5] + [(None, base[1]), (None, "only null")]


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "f", 1, "n", "r", 2) for i, t in rows], SCHEMA).repartition(3)
    prints = [print_of(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [x - (1 << 64) if x >> 63 else x for x in prints], classes(prints, [i for i, _ in rows]), strict=True), key=str)
    assert sorted((tuple(r) for r in s.components_of_prints(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in s.components_of_prints(df, variants=3_000).collect()), key=str) == want


def test_empty(spark):
    assert s.components_of_prints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    t = " ".join(f"W{rng.randrange(9)}" * rng.randint(1, 4) for _ in range(900))
    monkeypatch.setattr(s, "PART", 50)
    assert [int(x) for x in s.majority([t.encode(), b"", b"a b", t.encode() * 2])] == [print_of(t), 0, print_of("a b"), print_of(t * 2)]


@pytest.mark.parametrize("variants", [10**9, 20_000])
def test_chains_and_clumps(spark, variants):
    """Random prints, chains of steps of three bits, and a clump around one print, through one bucket and through buckets dealt again."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(10):
        x = rng.getrandbits(64)
        for _ in range(8):
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            prints.add(x)
    middle = rng.getrandbits(64)
    for _ in range(300):
        x = middle
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        prints.add(x)
    every = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in every], "fingerprint long").repartition(3)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in s.near_prints(df, variants).collect()]
    place = {x: i for i, x in enumerate(every)}
    root = s.joined_classes(len(every), np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]))
    assert root.tolist() == classes(every, list(range(len(every))))
