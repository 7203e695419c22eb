"""Aggregates: counts from several relations, deduplication at the least depth, groups of carriers, top files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def tagged_counts(key: str, **relations: DataFrame) -> DataFrame:
    """Per key the number of rows in each relation, 0 where it has none: a union of partial counts, no outer join."""
    parts = [rows.groupBy(key).agg(*(F.count(F.lit(1)).alias(n) if n == name else F.lit(0).cast("long").alias(n) for n in relations)) for name, rows in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(*(F.sum(n).alias(n) for n in relations))


def top(rows: DataFrame, score: str, tie: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(n)


def least_by(rows: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """Of rows with one key the first in `order`: its order columns and values."""
    kept = [*order, *(v for v in values if v not in order)]
    first = F.min(F.struct(*kept)).alias("first")
    return rows.groupBy(*key).agg(first).select(*key, *(F.col(f"first.{v}").alias(v) for v in kept))


def distinct_types(rows: DataFrame, key: str, value: str, missing: str = "(global)") -> DataFrame:
    """Per key (missing ones under one name) the distinct values as a sorted, comma-joined text, and their number."""
    named = rows.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(missing)))
    return named.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("types")).select(key, F.array_join("types", ",").alias("types"), F.size("types").cast("long").alias("n_types"))


def run_statistics(**relations: DataFrame) -> DataFrame:
    """(metric, value): the number of rows of each relation."""
    out = None
    for name, rows in relations.items():
        part = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out
