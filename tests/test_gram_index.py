import random
import re

from pyspark.sql import functions as F

from lexispan.operators import gram_index, search

WORDS = ["bwès", "Bwesrèye", "abwes", "â", "bw", "tchin", "tchinis'", "li bwès", "", None, "œuvré", "b\nw"]


def rows(spark, seed, keys):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, rng.choice(WORDS), rng.choice(["dji va å bwès", "tchin", "a", "", None, "œuvre bw es"])) for k in keys], "k long, w string, b string")


def scan(spark, table, query):
    index = search.search_index(table, F.col("w"), F.col("b"))
    return sorted((r["k"], r["score"]) for r in search.scored(index, query).collect())


QUERIES = ["bwès", "b", "bw", " TCHIN ", "œuvre", "es", "wesr", "none", "å bwe", "a"]


def test_index_equals_scan_over_batches_and_merge(spark, tmp_path):
    index = gram_index.GramIndex(spark, str(tmp_path / "i"), buckets=8)
    assert index.matches("b").count() == 0
    first, second = rows(spark, 1, range(60)), rows(spark, 2, range(40, 90))
    index.add(first, "k", F.col("w"), F.col("b"))
    index.add(second, "k", F.col("w"), F.col("b"))
    table = first.where("k < 40").union(second)
    for query in QUERIES:
        expected = scan(spark, table, query)
        assert sorted((r["key"], r["score"]) for r in index.matches(query).collect()) == expected, query
    assert index.segments() == [1, 2]
    index.merge()
    assert index.segments() == [3]
    for query in QUERIES[:4]:
        assert sorted((r["key"], r["score"]) for r in index.matches(query).collect()) == scan(spark, table, query), query
    assert index.matches("  ").count() == 0


def test_pages_equal_the_ranked_scan(spark, tmp_path):
    index = gram_index.GramIndex(spark, str(tmp_path / "i"), buckets=8)
    table = rows(spark, 3, range(80))
    index.add(table, "k", F.col("w"), F.col("b"))
    for query, size, offset in (("bwès", 3, 0), ("bwès", 5, 30), ("tchin", 50, 0), ("b", 4, 2)):
        hits = search.scored(search.search_index(table, F.coalesce("w", F.lit("")), F.col("b")), query).withColumn("w", F.coalesce("w", F.lit("")))
        order = search.search_order("w", "k")
        expected = [r["k"] for r in hits.orderBy(*order).limit(size + offset).collect()][offset:]
        assert [r["key"] for r in index.page(query, size, offset).orderBy("rank").collect()] == expected


def test_few_buckets_are_read(spark, tmp_path):
    index = gram_index.GramIndex(spark, str(tmp_path / "i"), buckets=8)
    index.add(rows(spark, 4, range(50)), "k", F.col("w"), F.col("b"))
    everything, some = index._read("postings"), index.postings(["bwe", "tch"])
    assert len({f.split("bucket=")[1].split("/")[0] for f in everything.inputFiles()}) == 8
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN \(\d, ?\d\)|= \d)", plan) and "In(gram, [bwe,tch])" in plan
    assert some.count() > 0


def test_a_failed_batch_is_never_named(spark, tmp_path, monkeypatch):
    index = gram_index.GramIndex(spark, str(tmp_path / "i"), buckets=8)
    index.add(rows(spark, 5, range(10)), "k", F.col("w"), F.col("b"))
    before = sorted((r["key"], r["score"]) for r in index.matches("bw").collect())
    monkeypatch.setattr(index, "_publish", lambda segments: (_ for _ in ()).throw(OSError("lost")))
    try:
        index.add(rows(spark, 6, range(10)), "k", F.col("w"), F.col("b"))
    except OSError:
        pass
    monkeypatch.undo()
    assert sorted((r["key"], r["score"]) for r in index.matches("bw").collect()) == before
    assert index.add(rows(spark, 5, range(10)), "k", F.col("w"), F.col("b")) == 3


def test_buckets_are_told_without_a_job(spark, tmp_path):
    index = gram_index.GramIndex(spark, str(tmp_path / "i"), buckets=64)
    grams = ["a", "bw", "wès", "å b", "œ", "\U0001f600"]
    rows = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", index._bucket("gram").alias("b")).collect()
    assert {r["b"] for r in rows} == set(index._buckets_of(grams))
