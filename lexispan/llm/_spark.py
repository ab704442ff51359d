"""Shared helpers: shared-folder tables, table loading, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key are dealt over so many salts before they meet in a join.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Without one, a temporary folder serves a local master; a cluster raises ValueError."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexispan-"))
    return context.getCheckpointDir()


class SharedTable:
    """A table written once in the shared folder: it cuts lineage, and every executor can reread it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self._fs().deleteOnExit(self._hadoop_path())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        self._fs().delete(self._hadoop_path(), True)

    def _hadoop_path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._hadoop_path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


#: Rows of whole texts that Spark hands to Python at once; its default of 10,000 makes batches of 30 MB and more on both sides.
BATCH_ROWS = 1_000


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session, unless it is set lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    return SharedTable(df, name).read()


def unit_hash(*cols, seed: int) -> F.Column:
    """A uniform double in (0, 1) that depends on the values and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *cols), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def with_least(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """The rows with the least value of their key.

    Values are first reduced by key and salt, then by key; the least one is passed down by key
    and salt, so rows of a hot key meet it in as many tasks as there are salts.
    """
    salted = rows.withColumn("__salt", salt(value))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias("__least"))
    whole = parts.groupBy(key).agg(F.min("__least").alias(into))
    return salted.join(parts.join(whole, key).select(key, "__salt", into), [key, "__salt"]).drop("__salt")


def salt(value: str) -> F.Column:
    return F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")


#: Edges that one task joins at once. Up to so many take no rounds, each of which is some ten stages that the driver plans.
EDGES_A_TASK = 1 << 18


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Up to EDGES_A_TASK edges are joined in one task. More take alternating large-star and small-star rounds: each is two joins on a partially
    aggregated minimum, and each round is a table in the shared folder, so neither
    the driver nor one task ever holds a component or the neighbours of a hub beyond that bound. An empty
    input gives no rows. Rounds grow with the logarithm of the longest path; if `max_rounds`
    aren't enough, RuntimeError is raised and no result is returned.
    """
    state = None
    table = SharedTable(_ordered(edges).distinct(), "edges")
    for _ in range(max_rounds):
        seen = table.read().agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        few = 0 < seen[0] <= EDGES_A_TASK
        if few:
            rows = table.read()
            after = SharedTable(rows.coalesce(1).mapInPandas(_stars, rows.schema), "edges")
            table.drop()
            table = after
        if few or seen == state or seen[0] == 0:
            stars = table.read()
            members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return members.union(roots)
        state = seen
        after = SharedTable(_small_star(_large_star(table.read())).distinct(), "edges")
        table.drop()
        table = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _stars(frames):
    """(a, b) for every node but the least of its component, which is b; of edges that fit in a task."""
    held = list(frames)
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    nodes, ends = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # only roots are hung on lesser ones
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    yield pd.DataFrame({"a": nodes[below], "b": nodes[root[below]]})


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller), without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of the node and its neighbours."""
    both = with_least(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", "b", "m")
    return _ordered(both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the least of them."""
    moved = with_least(edges, "a", "b", "m")
    return _ordered(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))))
