"""The registered queries, and the SQL that says the same over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.fixtures.bindings import Registry

Query = Callable[[Registry], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is None where SQL cannot say it."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def joined(*columns: str) -> dict[str, Column]:
    """Array columns as text, for results that are compared by value."""
    return {c: F.array_join(c, "; ") for c in columns}
