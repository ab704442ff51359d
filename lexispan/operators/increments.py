"""Results kept by group, of which a further run makes anew only those whose input has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import versions


def digest(rows: DataFrame, keys: list[str], also: str = "") -> DataFrame:
    """(keys, digest): the rows of each key in any order, repeats counted, and a text that all of them depend on."""
    line = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in keys)), {"ignoreNullFields": "false"})
    parts = [F.sum(F.xxhash64(line, F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return rows.groupBy(*keys).agg(F.concat_ws("/", *parts, F.count("*").cast("string"), F.lit(also)).alias("digest"))


class GroupStore:
    """Rows of groups under a path: each version holds the groups that its run made, and a manifest says which version of each group is live.

    A run compares the digests of its input's units (files, or pages of files) with those of the run before, makes the rows of
    the groups that a new, changed or vanished unit belongs to, writes them as a version, and then publishes manifest and digests
    in one table: what a failed run leaves is never named. Units carry the columns of their group among their own.
    """

    def __init__(self, spark: SparkSession, path: str, group: list[str]):
        self.spark, self.path, self.group = spark, path, group

    def _last(self, table: str) -> DataFrame | None:
        known = versions(self.spark, f"{self.path}/state")
        return self.spark.read.parquet(f"{self.path}/state/version={known[-1]}/{table}") if known else None

    def touched(self, units: DataFrame) -> DataFrame:
        """The groups of units (with `digest`) that aren't as they were in the run before."""
        before = self._last("units")
        if before is None:
            return units.select(*self.group).distinct()
        names = [c for c in units.columns if c != "digest"]
        match = [units[c].eqNullSafe(before[c]) for c in (*names, "digest")]
        there, gone = units.join(before, match, "left_anti"), before.join(units, match, "left_anti")
        return there.select(*self.group).union(gone.select(*self.group)).distinct()

    def run(self, units: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Makes the rows of the touched groups by `make`, which gets these groups; returns the number of the version that holds them."""
        number = max(versions(self.spark, f"{self.path}/rows"), default=0) + 1
        place = f"{self.path}/state/version={max(versions(self.spark, f'{self.path}/state'), default=0) + 1}"
        touched = f"{self.path}/touched/version={number}"
        self.touched(units).write.parquet(touched)
        groups = self.spark.read.parquet(touched)
        make(groups).write.parquet(f"{self.path}/rows/version={number}")
        made = self.spark.read.parquet(f"{self.path}/rows/version={number}").select(*self.group).distinct().withColumn("live", F.lit(number))
        before = self._last("manifest")
        if before is not None:
            kept = before.join(groups, [before[g].eqNullSafe(groups[g]) for g in self.group], "left_anti")
            made = kept.unionByName(made)
        made.write.parquet(f"{place}.new/manifest")
        units.write.parquet(f"{place}.new/units")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = folder(place).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.rename(folder(f"{place}.new"), folder(place)):  # both tables are named at once
            raise OSError(f"{place} can't be published")
        return number

    def current(self) -> DataFrame:
        """The live rows of all groups; ValueError before the first run."""
        manifest = self._last("manifest")
        if manifest is None:
            raise ValueError(f"nothing has been published under {self.path}")
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        live = manifest.select(*[F.col(g).alias(f"__{g}") for g in self.group], F.col("live"))
        match = [rows["version"] == live["live"], *[rows[g].eqNullSafe(live[f"__{g}"]) for g in self.group]]
        return rows.join(live, match, "left_semi").drop("version")
