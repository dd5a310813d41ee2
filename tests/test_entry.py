"""The entry point with and without the training-data subpackage, and that every registry query has its SQL."""

from __future__ import annotations

import importlib
import sys

import pytest

from chemledger import catalog


@pytest.fixture
def entry():
    import __spark_entry__

    yield __spark_entry__
    importlib.reload(__spark_entry__)


def test_without_the_subpackage(entry, monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(catalog.QUERIES) == set(bare.oracle_sql())


def test_oracles_name_registered_queries(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
