"""Running counts and marks over scopes of any size: ranges of a scope are scanned on their own, and only their summaries are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged


def _with_summary(rows: DataFrame, keys: list[str], summary: list[Column], carry: list[Column]) -> DataFrame:
    """Each row with what its scope's other ranges carry to its range; a summary is a row for each scope and range."""
    parts = rows.groupBy(*keys, "__range").agg(*summary)
    named = parts.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__range").alias("__of"), *carry)
    match = rows["__range"] == named["__of"]
    for k in keys:
        match = match & rows[k].eqNullSafe(named[f"__key_{k}"])
    return rows.join(named, match).drop("__of", *[f"__key_{k}" for k in keys])


def _around(keys: list[str], after: bool = False):
    ordered = Window.partitionBy(*keys).orderBy("__range")
    return ordered.rowsBetween(1, Window.unboundedFollowing) if after else ordered.rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: list[str]):
    return Window.partitionBy(*keys, "__range").orderBy("__place")


def segments(rows: DataFrame, keys: list[str], order: list[str], start: Column, into: str = "segment") -> DataFrame:
    """Rows numbered by segment within their scope: each start opens one; rows before the first are left out. `order` has no ties within a scope."""
    cut = ranged(rows.withColumn("__start", F.coalesce(start, F.lit(False)).cast("long")), [*keys, *order])
    carried_in = _with_summary(cut, keys, [F.sum("__start").alias("__n")], [F.coalesce(F.sum("__n").over(_around(keys)), F.lit(0)).alias("__before")])
    running = F.sum("__start").over(_inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    return carried_in.withColumn(into, F.col("__before") + running).where(F.col(into) > 0).drop("__start", "__before", "__range", "__place")


def carried(rows: DataFrame, keys: list[str], order: list[str], marker: str, into: str) -> DataFrame:
    """The last marker seen up to each row of its scope."""
    cut = ranged(rows, [*keys, *order])
    last = F.max_by(marker, F.when(F.col(marker).isNotNull(), F.col("__place")))
    carried_in = _with_summary(cut, keys, [last.alias("__last")], [F.last("__last", ignorenulls=True).over(_around(keys)).alias("__before")])
    own = F.last(marker, ignorenulls=True).over(_inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    return carried_in.withColumn(into, F.coalesce(own, "__before")).drop("__before", "__range", "__place")


def page_at_flush(starts: DataFrame, keys: list[str], order: list[str], page: str, final: str, into: str) -> DataFrame:
    """An entry's page is the one seen when the next entry of its scope begins; the last one gets the scope's final page."""
    cut = ranged(starts, [*keys, *order])
    first = F.min_by(F.struct(F.col(page).alias("page")), "__place")
    carried_in = _with_summary(cut, keys, [first.alias("__first")], [F.first("__first").over(_around(keys, after=True)).alias("__after")])
    following = F.lead(F.struct(F.col(page).alias("page"))).over(_inside(keys))
    found = F.coalesce(following, "__after")
    return carried_in.withColumn("__next", found).withColumn(into, F.coalesce("__next.page", final)).drop("__next", "__after", "__range", "__place")


def running_sum(cut: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Rows that have `__range` and `__place` already, with the sum of the values in front of each in its scope."""
    carried_in = _with_summary(cut, keys, [F.sum(value).alias("__sum")], [F.coalesce(F.sum("__sum").over(_around(keys)), F.lit(0)).alias("__before")])
    own = F.coalesce(F.sum(value).over(_inside(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return carried_in.withColumn(into, F.col("__before") + own).drop("__before")
