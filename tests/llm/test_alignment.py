"""Alignment against the two tokenizers' own encoders on whole texts."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import pytest

from chemledger.llm import alignment as al

A, B = f"{al.TOKENIZERS}/{al.BYTE_BPE}", f"{al.TOKENIZERS}/{al.PIECE_BPE}"
SCHEMA = "sds_id long, text string, node string, copies int, pair int, groups string"


def texts() -> list[str | None]:
    rng = random.Random(4)
    word = ["safety", "Sheet", "data,", "H301", "żółć", "naïve", "don't", "it's", "12.5", "%", "—", "…", "😀", "日本語", " x", "a\u0085b", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x" * 40, "https://a.b/c?d=1"]
    gap = [" ", " ", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "   ", " ", "\r\n", "\x1c"]
    out: list[str | None] = ["".join(rng.choice(word) + rng.choice(gap) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += [None, "", " ", "  ", "a", " a", "a ", "▁", "one ▁ two", "one two", "one two", "one  two", "\x00", "a\x00 b", "\n", "x" * 3000, "  lead", "tail  ", "ﬁ ① Å", "é"]
    return out + out[:4] + ["the same text again"] * 5


def expected(rows: list[str | None]) -> list[tuple]:
    t = al.tokenizers(A, B)
    every = []
    for s in rows:
        links, groups, a, b = [], "", [], []
        if s:
            a = t.a.encode(" " + s, add_special_tokens=False).ids
            b = t.b.encode(s)
            whole = (" " + s).encode()
            if b"".join(t.a_bytes[i] for i in a) == whole == b"".join(t.b_bytes[i] for i in b):
                ends_a, ends_b, n = {}, {}, 0
                for k, i in enumerate(a):
                    n += len(t.a_bytes[i])
                    ends_a[n] = k
                n = 0
                for k, i in enumerate(b):
                    n += len(t.b_bytes[i])
                    ends_b[n] = k
                i = j = 0
                parts = []
                for e in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a[e], ends_b[e]
                    parts.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
                    links.append((a[p], b[q]))
                    i, j = p + 1, q + 1
                groups = ";".join(parts)
            else:
                a, b = [], []
        every.append((len(a), len(b), links, groups))
    count = Counter(x for _, _, links, _ in every for x in links)
    most: dict = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), g) for n_a, n_b, x, g in every]


@pytest.mark.parametrize("common_pairs", [al.COMMON_PAIRS, 5, 0])
def test_against_whole_texts(spark, common_pairs):
    rows = texts()
    df = spark.createDataFrame([(i, t, "n", 1, 2, "g") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in al.align_sds(df, A, B, common_pairs=common_pairs).collect())
    assert got == [(i, *w) for i, w in enumerate(expected(rows))]
    assert any(w[2] for w in expected(rows)) and any(r and not w[0] for r, w in zip(rows, expected(rows), strict=True))


def test_empty(spark):
    assert al.align_sds(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_memory_is_given_up(monkeypatch):
    monkeypatch.setattr(al, "HELD_SEGMENTS", 3)
    memo = al.Memo(al.tokenizers(A, B))
    for t in ("one two three four five", "six one two", "one seven"):
        got = [memo.held.groups[i] for i in memo.places([t])[0]]
        assert b";".join(got) == al._runs([t], memo.t, False).groups[0]


def test_quick_encoder_is_the_same():
    """Over random usual characters both encoders of A agree."""
    rng = random.Random(8)
    t = al.tokenizers(A, B)
    assert t.quick and t.cuts
    for _ in range(3_000):
        s = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x530)])) for _ in range(rng.randint(1, 30)))
        s = "".join(s.split(" "))
        if s and not s[0].isspace() and not s[-1].isspace():
            assert t.encode_a(" " + s, True) == t.encode_a(" " + s, False), ascii(s)


def test_query(spark, tmp_path):
    rows = [(i, t, "g") for i, t in enumerate(texts())] + [(None, "one two", "g")]
    spark.createDataFrame(rows, "doc_id long, text string, groups string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in al.op13_alignment(spark, str(tmp_path)).collect()), key=str)
    want = [(r[0], *w[:6], sha256(w[6].encode()).hexdigest() if w[0] else "") for r, w in zip(rows, expected([r[1] for r in rows]), strict=True)]
    assert got == sorted(want, key=str)
