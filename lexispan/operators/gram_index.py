"""A persisted index of letter runs: built in segments, merged, and read for a query's runs alone."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, strip
from ..sources.files import versions
from .ranking import page
from .search import BODY, EQUAL, INSIDE, PREFIX, is_empty, search_order

#: Letters of a run; shorter queries are found by runs of their own length.
LETTERS = 3
#: Entries whose postings of one run share a file.
FILE_ENTRIES = 1_000_000
#: The bound of a posting's score, by where the run stands: at the word's beginning, inside it, or in the body alone.
BOUNDS = (EQUAL, INSIDE, BODY)


def _runs(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _all_runs(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_runs(text, n) for n in range(1, LETTERS + 1)]))


class GramIndex:
    """Entries (key, word, norm_word, norm_body) and postings (gram, bound, key) of them under a path.

    Each batch is a segment of its own: postings lie in folders by the hash of their run, sorted by run within
    files, so a query opens the folders of its own runs and skips the other runs of a file by the ranges in its footer. Of a key that
    several segments hold the latest one counts. A manifest names the segments that are live; a merge writes one segment
    out of them and then names that one alone, so readers of an older manifest aren't disturbed, and what a failed run leaves is never named.
    The number of buckets is the index's own for good: about one for each million entries is expected, and 16 at least.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024):
        self.spark, self.path, self.buckets, self._schemas = spark, path, buckets, {}

    def _bucket(self, *columns) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, grams: list[str]) -> list[int]:
        """What `_bucket` gives for some runs."""
        hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
        return sorted({(h - (h >> 63 << 64)) % self.buckets for h in hashes})

    def segments(self) -> list[int]:
        known = versions(self.spark, f"{self.path}/manifest")
        return sorted(r["segment"] for r in self.spark.read.parquet(f"{self.path}/manifest/version={known[-1]}").collect()) if known else []

    def _publish(self, segments: list[int]) -> None:
        number = max(versions(self.spark, f"{self.path}/manifest"), default=0) + 1
        self.spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.parquet(f"{self.path}/manifest/version={number}")

    def _new_segment(self) -> int:
        return max(versions(self.spark, f"{self.path}/entries"), default=0) + 1

    def _read(self, table: str, segments: list[int] | None = None) -> DataFrame:
        """The live rows of a table with their segment."""
        live = self.segments() if segments is None else segments
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        reader = reader.schema(self._schemas[table]) if table in self._schemas else reader
        rows = reader.parquet(*[f"{self.path}/{table}/version={s}" for s in live])
        self._schemas[table] = rows.schema
        return rows

    def _write(self, entries: DataFrame, postings: DataFrame | None, segment: int) -> None:
        place = f"{self.path}/entries/version={segment}"
        entries.withColumn("bucket", self._bucket("key")).repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(place)
        kept = self._read("entries", [segment])
        if postings is None:
            w, b = F.col("norm_word"), F.col("norm_body")
            start = F.transform(F.sequence(F.lit(1), F.lit(LETTERS)), lambda n: F.left(w, n))
            both = kept.select("key", F.explode(_all_runs(F.concat_ws("\n", w, b))).alias("gram"), w.alias("w"), start.alias("start")).where(~F.contains("gram", F.lit("\n")))
            bound = F.when(F.array_contains("start", F.col("gram")), EQUAL).when(F.contains("w", F.col("gram")), INSIDE).otherwise(BODY)
            postings = both.select("key", "gram", bound.alias("bound"))
        shares = max(1, -(-kept.count() // FILE_ENTRIES))  # a run that every entry holds is cut in so many files
        dealt = postings.withColumns({"bucket": self._bucket("gram"), "__share": F.pmod(F.xxhash64("key"), F.lit(shares))})
        dealt.repartition("bucket", "__share").sortWithinPartitions("bucket", "gram", "bound", "key").drop("__share").write.partitionBy("bucket").parquet(f"{self.path}/postings/version={segment}")
        counts = self._read("postings", [segment]).groupBy("bucket", "gram", "bound").count()
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/counts/version={segment}")

    def add(self, rows: DataFrame, key: str, word: Column, body: Column) -> int:
        """Writes rows as a new segment, which replaces older entries of their keys; an entry without word and body is found no more.

        Keys aren't null (such rows are left out) and stand once in a batch; of repeated ones the greatest word and body count. Returns the segment's number.
        """
        folded = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(word, F.lit("")).alias("word"), fold(word).alias("norm_word"), fold(body).alias("norm_body"))
        once = folded.groupBy("key").agg(F.max(F.struct("word", "norm_word", "norm_body")).alias("e")).select("key", "e.*")
        live, segment = self.segments(), self._new_segment()
        self._write(once, None, segment)
        self._publish([*live, segment])
        return segment

    def merge(self) -> int:
        """Writes the live segments as one: the latest entry of each key, and the postings of these as they are."""
        segment = self._new_segment()
        latest = F.max_by(F.struct("word", "norm_word", "norm_body", "version"), "version")
        newest = self._read("entries").groupBy("key").agg(latest.alias("e"))
        entries = newest.select("key", "e.word", "e.norm_word", "e.norm_body")
        postings = self._read("postings").join(newest.select("key", F.col("e.version").alias("version")), ["key", "version"]).select("key", "gram", "bound")
        self._write(entries, postings, segment)
        self._publish([segment])
        return segment

    def postings(self, grams: list[str], least_bound: int = 0) -> DataFrame:
        """(gram, key, bound) of some runs: only their buckets are opened."""
        rows = self._read("postings").where(F.col("bucket").isin(self._buckets_of(grams)) & F.col("gram").isin(grams))
        return rows.where(F.col("bound") >= least_bound).select("gram", "key", "bound")

    def _rarest(self, grams: list[str], most: int = 2) -> list[str]:
        rows = self._read("counts").where(F.col("bucket").isin(self._buckets_of(grams)) & F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("count").alias("n")).collect()
        if len(rows) < len(grams):
            return []  # a run that no entry holds
        return [r["gram"] for r in sorted(rows, key=lambda r: (r["n"], r["gram"]))[:most]]

    def matches(self, query: str, least_bound: int = 0) -> DataFrame:
        """(key, word, score) of the entries that match, as a scan of all of them scores; entries that can't reach the bound may be left out.

        An empty query has no run and no match: what it shows isn't a search.
        """
        q = self.spark.range(1).select(fold(strip(F.lit(query)))).first()[0]
        none = self.spark.createDataFrame([], "key string, word string, score int")
        if is_empty(query) or not self.segments():
            return none
        n = min(LETTERS, len(q))
        grams = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
        rare = self._rarest(grams)
        if not rare:
            return none
        # a score of INSIDE or more needs every run of the query in the word, PREFIX or more its first run at the beginning
        found = self.postings(rare, min(least_bound, INSIDE))
        if least_bound > INSIDE:
            found = found.union(self.postings([q[:n]], EQUAL))
            rare = sorted({*rare, q[:n]})
        keys = found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("key", self._bucket("key").alias("bucket"))
        entries = self._read("entries").join(keys, ["bucket", "key"])
        latest = F.max_by(F.struct("word", "norm_word", "norm_body"), "version")
        held = entries.groupBy("key").agg(latest.alias("e")).select("key", "e.*")
        w, b = F.col("norm_word"), F.col("norm_body")
        score = F.when(w == q, EQUAL).when(F.startswith(w, F.lit(q)), PREFIX).when(F.contains(w, F.lit(q)), INSIDE).when(F.contains(b, F.lit(q)), BODY).otherwise(0)
        return held.select("key", "word", score.alias("score")).where(F.col("score") >= max(1, least_bound))

    def page(self, query: str, size: int, offset: int = 0) -> DataFrame:
        """(key, word, score, rank): a page of a search; postings of a lower bound are read only if those above don't fill it."""
        for bound in (PREFIX, INSIDE, 0):
            hits = self.matches(query, bound)
            if bound == 0 or hits.limit(size + offset).count() >= size + offset:
                return page(hits, search_order("word", "key"), size, offset)
        raise AssertionError("the last bound takes every posting")
