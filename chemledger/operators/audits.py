"""Quality queries: orphans, ambiguity, counts, and every key, reference, domain and check of the registry schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger import schemas


def orphans(reg) -> DataFrame:
    """Documents without product."""
    return reg.sds_documents.join(reg.products.select("product_id"), "product_id", "left_anti").select("sds_id", "product_id")


def multiple_current(sds_documents: DataFrame) -> DataFrame:
    rows = sds_documents.where(F.col("document_status") == "CURRENT").groupBy("product_id").agg(F.count(F.lit(1)).alias("current_documents"))
    return rows.where("current_documents > 1")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, df in tables.items()])


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose row counts differ between two snapshots."""
    both = before.withColumnRenamed("row_count", "rows_before").join(after.withColumnRenamed("row_count", "rows_after"), "table_name", "full")
    return both.where(~F.col("rows_before").eqNullSafe(F.col("rows_after")))


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Null or repeated primary keys, and repeated unique keys: the rule and how many rows break it."""
    parts = []
    for name, df in tables.items():
        rules = [("primary key", schemas.PRIMARY_KEYS[name], None)] + [("unique", keys, when) for t, keys, when in schemas.UNIQUE_KEYS if t == name]
        for rule, keys, when in rules:
            rows = df.where(when) if when else df
            groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
            bad = groups.where((F.col("n") > 1) & ~nulls | (nulls if rule == "primary key" else F.lit(False)))
            parts.append(bad.agg(F.lit(name).alias("table_name"), F.lit(f"{rule} {', '.join(keys)}").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")))
    return _union(parts)


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose reference is set but names nothing."""
    rules = [r for r in schemas.REFERENCES if r[0] in tables and r[2] in tables]
    targets = list(dict.fromkeys((target, to) for _, _, target, to in rules))

    def key(no: int | None, of: int, columns: Sequence[str]) -> Column:
        """A reference's key: equal values alone, and null if one is."""
        texts = [F.col(c).cast("string") for c in columns]
        joined = texts[0] if len(texts) == 1 else reduce(lambda a, b: F.concat(a, F.lit("/"), b), [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])
        return F.struct(*([] if no is None else [F.lit(no).alias("no")]), F.lit(of).alias("of"), joined.alias("key"))

    # every table is read once for all its references and once as a target, and equal keys are counted before they are dealt
    held, counts = [], []
    for target in dict.fromkeys(t for t, _ in targets):
        keys = [key(None, of, to) for of, (t, to) in enumerate(targets) if t == target]
        held.append(tables[target].select(F.inline(F.array(*keys))))
    for name in dict.fromkeys(r[0] for r in rules):
        keys = [key(no, targets.index((target, to)), columns) for no, (n, columns, target, to) in enumerate(rules) if n == name]
        counts.append(tables[name].select(F.inline(F.array(*keys))).where("key is not null").groupBy("no", "of", "key").agg(F.count(F.lit(1)).alias("n")))
    bad = _union(counts).join(_union(held).distinct(), ["of", "key"], "left_anti")
    sums = bad.agg(*[F.coalesce(F.sum(F.when(F.col("no") == no, F.col("n"))), F.lit(0)).cast("long").alias(f"r{no}") for no in range(len(rules))])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(f"{', '.join(columns)} -> {target}").alias("rule"), F.col(f"r{no}").alias("violations")) for no, (name, columns, target, _) in enumerate(rules)]
    return sums.select(F.inline(F.array(*rows)))


def row_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside their domain and rows that break a check; a null passes both, as in SQL."""
    parts = []
    for name, df in tables.items():
        domains = [(f"domain {c}", F.col(c).isin(*members)) for (t, c), members in schemas.DOMAINS.items() if t == name and c in df.columns]
        rules = domains + [(f"check {rule}", F.expr(sql)) for t, rule, sql in schemas.CHECKS if t == name]
        if rules:
            counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(f"r{k}") for k, (_, ok) in enumerate(rules)])
            rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"r{k}").alias("violations")) for k, (rule, _) in enumerate(rules)])
            parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(rows)))
    return _union(parts)


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    return key_violations(tables).unionByName(reference_violations(tables)).unionByName(row_violations(tables))
