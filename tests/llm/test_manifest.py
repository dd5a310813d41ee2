"""The hash tree against a plain computation, over sizes around the superblock, nulls, ties, repeats and an empty table."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chemledger.llm import manifest as m

SCHEMA = "sds_id long, relative_path string, language string, page_count long, text string, tree string, path string, left int"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values: object) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(row: list[str]) -> list[list[str]]:
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows: list[tuple], touched) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees.append((own, levels([leaf(*r[:5]) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            proof, way = [], []
            for every, at in ((tree, i), (top, k)):
                for row in every[:-1]:
                    other = at ^ 1
                    if other < len(row):
                        proof.append(row[other])
                    way.append((other < at, row[other] if other < len(row) else ""))
                    at >>= 1
            cur = leaf(*r[:3], r[3] + 1 if touched(r[0]) and r[3] is not None else r[3], r[4])
            for first, other in way:
                cur = digest(other, cur) if first else digest(cur, other)
            out.append((r[0], r[2], leaf(*r[:5]), tree[-1][0], top[-1][0], "".join(proof), cur, cur == top[-1][0]))
    return out


def touched(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    hit = F.crc32(F.col("sds_id").cast("string")) % 7 == 0
    got = m.manifest(df, received={"page_count": F.when(hit, F.col("page_count") + 1).otherwise(F.col("page_count"))})
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 513])
def test_sizes(spark, n):
    rows = [(i * 3, f"p{i % 5}", "pl", i, f"tekst {i} ż", "t", "p", 1) for i in range(n)]
    assert run(spark, rows) == sorted(expected(rows, touched), key=str)


def test_groups_nulls_and_repeats(spark):
    rows = [(i, None if i % 4 else "", [None, "", "pl", "de", "Ω"][i % 5], None if i % 3 == 0 else i, [None, "", "x"][i % 3], "t", "p", 1) for i in range(60)]
    rows += rows[:7] + [(None, "a", "pl", 7, "x", "t", "p", 1)] * 3 + [(7, "a", "pl", 7, "x", "t", "p", 1), (7, "b", "pl", 7, "x", "t", "p", 1)]
    rows += [(1000 + i, "q", "en", i, "long " * 50, "t", "p", 1) for i in range(1100)]
    got = run(spark, rows)
    assert got == sorted(expected(rows, touched), key=str)
    assert {r[7] for r in got} == {True, False}


def test_many_groups(spark):
    rows = [(i, "p", f"l{i:04}", i, "x", "t", "p", 1) for i in range(700)]
    assert run(spark, rows) == sorted(expected(rows, touched), key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_query(spark, tmp_path):
    rows = [(i, f"text {i}", [None, "en", "de"][i % 3], f"s{i % 4}", None if i % 5 == 0 else i, "x") for i in range(40)] + [(None, None, None, None, None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in m.op11_manifest(spark, str(tmp_path)).collect()), key=str)
    want = expected([(r[0], r[3], r[2], r[4], r[1]) for r in rows], touched)
    assert got == sorted(((w[0], w[2], w[3], w[4], digest(w[5]), w[6], w[7]) for w in want), key=str)
