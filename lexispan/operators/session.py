"""A user's state from event logs: history, favourites, and the last of a burst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: queries that a history holds.
HISTORY = 8


def history(log: DataFrame, user: str, query: str, ts: str, tie: str, most: int = HISTORY) -> DataFrame:
    """(user, query, ts, place): each user's latest queries, each once whatever its case, in the casing used last."""
    latest = log.groupBy(user, F.lower(query).alias("__q")).agg(F.max_by(F.struct(query, ts, tie), F.struct(ts, tie)).alias("__last"))
    rows = latest.select(user, F.col(f"__last.{query}").alias(query), F.col(f"__last.{ts}").alias(ts), F.col(f"__last.{tie}").alias("__tie"))
    order = Window.partitionBy(user).orderBy(F.desc(ts), F.desc("__tie"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("__tie")


def toggled_on(log: DataFrame, *keys: str) -> DataFrame:
    """Keys that were toggled an odd number of times."""
    return log.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n % 2 = 1").drop("__n")


def settled(log: DataFrame, user: str, ts: str, tie: str, quiet: str) -> DataFrame:
    """The last event of each burst: no other of the user follows within the interval."""
    after = F.lead(ts).over(Window.partitionBy(user).orderBy(ts, tie))
    return log.withColumn("__after", after).where(F.col("__after").isNull() | (F.col("__after") > F.col(ts) + F.expr(f"interval {quiet}"))).drop("__after")
