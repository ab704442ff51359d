"""Order-dependent operators that never put all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Rows of a range of an order, about; each is sorted on its own, and only the ranges' counts are put in order.
RANGE = 1_000_000
#: What a row's place takes of the number that Spark gives it within its partition.
PLACE_BITS = 33


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0, into: str = "rank") -> DataFrame:
    """One page of an order with its ranks: only size + offset rows of each task survive."""
    top = rows.orderBy(*order).limit(size + offset)
    return top.withColumn(into, F.row_number().over(Window.orderBy(*order))).where(F.col(into) > offset)


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `__range` and, within it, `__place` from 0: ranges follow each other in the order, and hold about RANGE rows each.

    One range exchange and a sort in each partition; written down, so that a range and its summary are the same however
    often they are read. Rows that tie in the whole order share a range.
    """
    parts = max(1, -(-rows.count() // RANGE))
    number = F.monotonically_increasing_id()  # the partition, and the place in it
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__number", number)
    cut = sorted_.withColumns({"__range": F.shiftright("__number", PLACE_BITS), "__place": F.col("__number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    return stored(cut.drop("__number"), "ranged")


def _starts(parted: DataFrame) -> DataFrame:
    """(__of, __before, __count): the number of rows in front of each range, and in it; a row for each range."""
    counts = parted.groupBy("__range").count()
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(F.col("__range").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"), F.col("count").alias("__count"))


def numbered(rows: DataFrame, key: str, into: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order of a key that has no repeats and no nulls: what stands in front of its range, and its place there."""
    parted = ranged(rows, [key])
    starts = _starts(parted).drop("__count")
    return parted.join(starts, parted["__range"] == starts["__of"]).withColumn(into, F.col("__before") + F.col("__place")).drop("__range", "__place", "__of", "__before")


def at_place(rows: DataFrame, key: str, place: int, into: str = "number") -> DataFrame:
    """The row that `numbered` gives the number `place`: only the range that holds it is read again."""
    parted = ranged(rows, [key])
    holds = (F.col("__before") <= place) & (F.col("__before") + F.col("__count") > place)
    at = _starts(parted).where(holds).first()  # one row
    wanted = (F.col("__range") == at["__of"]) & (F.col("__place") == place - at["__before"]) if at else F.lit(False)
    return parted.where(wanted).drop("__range", "__place").withColumn(into, F.lit(place).cast("long"))


def head_and_tail(rows: DataFrame, key: str, n: int, above: int) -> DataFrame:
    """The first and last n rows by a unique key if there are more than `above` rows, else all; `side` says which."""
    if rows.count() <= above:
        return rows.withColumn("side", F.lit("all"))
    first = rows.orderBy(F.col(key).asc()).limit(n).withColumn("side", F.lit("head"))
    return first.union(rows.orderBy(F.col(key).desc()).limit(n).withColumn("side", F.lit("tail")))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str, order: list[Column] | None = None, into: str = "place") -> DataFrame:
    """n rows at random without replacement, the same ones on each run: the smallest hashes of the key; with `order`, each with its place in that order."""
    drawn = rows.withColumn("draw", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("draw", key).limit(n)
    return drawn.withColumn(into, F.row_number().over(Window.orderBy(*order))) if order else drawn
