from __future__ import annotations

import corpus_pipeline
from chemledger.llm import registry

from .test_llm import brute_classes, corpus, prose, shortened


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in corpus()]
    leak = prose(rng, 40)
    rows += [(900, f"{prose(rng, 60)} {leak}", "en", "s", 0, 1), (901, f"{prose(rng, 90)} a.b@c.example.com", "en", "s", 0, 1), (902, " ".join(f"{w.upper()}!!" for w in prose(rng, 90).split()), "en", "s", 0, 1)]
    rows += [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose(rng, 80).split()) if i % 2 else prose(rng, 80), "en", "s", 0, 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node"]
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert 902 not in ids and {900, 901, 1000} <= ids
        if k == 1:
            assert 40 not in ids and 0 in ids
        if k == 2:
            assert 900 not in ids and 901 in ids
        if k == 3:
            assert "a.b@c.example.com" not in docs.where("doc_id = 901").first()["text"]
    assert docs.where("not exact and doc_id < 900").count() <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_one_of_each_class_of_shortened_copies_stays(spark):
    texts = shortened(11, 1, 300)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(brute_classes(texts)))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
