"""Readers and the evidence writer on small files."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest

from chemledger import schemas
from chemledger.sources import files


def test_listings_and_fingerprints(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name, data in {"a/b/x.pdf": b"%PDF-1.7", "a/y.PDF.txt": b"no", "z.pdf": b"x", "a/m.MSG": b"mail", "a/empty.png": b""}.items():
        (tmp_path / name).write_bytes(data)
    assert [r["relative_path"] for r in files.list_pdfs(spark, str(tmp_path)).collect()] == ["a/b/x.pdf", "z.pdf"]
    assert [r["relative_path"] for r in files.list_evidence(spark, str(tmp_path)).collect()] == ["a/b/x.pdf", "a/m.MSG", "z.pdf"]
    marks = {r["relative_path"]: (r["sha256"], r["is_pdf"]) for r in files.fingerprints(spark, str(tmp_path)).collect()}
    assert marks["a/b/x.pdf"] == (hashlib.sha256(b"%PDF-1.7").hexdigest(), True) and not marks["a/m.MSG"][1]


def test_evidence_manifest_and_rules(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/good.json").write_text(json.dumps({"schema": "S", "schema_version": "0.1", "documents": [{"document_key": "DOC-001", "page_range": {"from": 1, "to": 2}}]}))
    (tmp_path / "e/bad.json").write_text("{no json")
    rows = {r["file_name"]: r for r in files.evidence_files(spark, f"{tmp_path}/e").collect()}
    assert rows["good.json"]["documents"][0]["page_range"]["to"] == 2 and rows["bad.json"]["_corrupt"]
    (tmp_path / "m.json").write_text(json.dumps({"batch": "B", "files": [{"id": "2", "sha256": "x"}, {"id": "1", "sha256": "y"}]}))
    assert [(r["position"], r["id"]) for r in files.manifest(spark, f"{tmp_path}/m.json").orderBy("position").collect()] == [(0, "2"), (1, "1")]
    assert files.manifest(spark, f"{tmp_path}/m.json", ["1"]).count() == 1
    rule = {"alias_id": "A", "status": "ACTIVE", "role": "R"}
    (tmp_path / "r.json").write_text(json.dumps({"aliases": [rule, rule, {"alias_id": "B", "status": "?", "role": "R"}, {"alias_id": "C", "status": "ACTIVE", "role": ""}, {"alias_id": "D", "status": "ACTIVE", "role": "R"}]}))
    assert sorted((r["alias_id"], r["problem"]) for r in files.rule_catalogue(spark, f"{tmp_path}/r.json").fillna("").collect()) == [("A", "DUPLICATE_ID"), ("A", "DUPLICATE_ID"), ("B", "STATUS"), ("C", "ROLE"), ("D", "")]


def test_decisions(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"decisions": [{"decision": "LINK", "source_manifest_ids": ["1", "2"]}, {"decision": "SKIP", "source_manifest_ids": ["2", "9"]}]}))
    required = spark.createDataFrame([("1",), ("2",), ("3",)], "manifest_id string")
    assert {r["manifest_id"]: r["status"] for r in files.decisions(spark, f"{tmp_path}/d.json", required).collect()} == {"1": "OK", "2": "DUPLICATE", "3": "MISSING", "9": "UNEXPECTED"}


def test_registry_tables_and_writer(spark, tmp_path):
    row = [("r", dt.date(2024, 1, 1), "FINAL", dt.datetime(2024, 1, 1), None)]
    spark.createDataFrame(row, schemas.TABLES["physical_reviews"]).write.parquet(f"{tmp_path}/physical_reviews")
    assert files.registry_table(spark, str(tmp_path), "physical_reviews").schema == schemas.TABLES["physical_reviews"]
    drafts = spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, schema string")
    verdicts = spark.createDataFrame([("a", "G1", "PASS"), ("b", "G1", "PASS"), ("b", "G2", "FAIL")], "source_id string, gate string, status string")
    files.write_evidence(drafts, verdicts, f"{tmp_path}/out")
    assert [r["source_id"] for r in spark.read.json(f"{tmp_path}/out/evidence").collect()] == ["a"]
    with pytest.raises(Exception, match="exist"):
        files.write_evidence(drafts, verdicts, f"{tmp_path}/out")
