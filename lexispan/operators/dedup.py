"""Keyed deduplication, and maps built from lists of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each key the row with the least order; partial aggregates keep one row a key and task, so hot keys don't gather."""
    names = rows.columns
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("__row"))
    return least.select(*[F.col(f"__row.{c}").alias(c) for c in names])


def keep_longest(rows: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """The row with the longest text of each key; of equal lengths the earliest."""
    return _best(rows, keys, F.struct(-F.length(text), F.col(seq)))


def keep_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return _best(rows, keys, F.struct(*order))


def shortest_by_key(rows: DataFrame, key: Column, word: str, seq: str) -> DataFrame:
    """(key, val): the shortest word of each key; of equal lengths the first."""
    return rows.groupBy(key.alias("key")).agg(F.min_by(word, F.struct(F.length(word), F.col(seq))).alias("val"))


def merged_by_priority(sources: list[DataFrame], key: str, seq: str) -> DataFrame:
    """One row a key: that of the earliest source, and in it of the first row. Sources share their columns."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return _best(rows, [key], F.struct("__source", seq)).drop("__source")
