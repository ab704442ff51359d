import math
from collections import Counter
import hashlib

from pyspark.sql import functions as F

from lexispan.llm import mixing


def brute_count(seed, doc, mean):
    parts = max(1, math.ceil(mean / mixing.PART_MEAN))
    total = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc is None else doc}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean / parts)
        k = 0
        while c < u and k < mixing.STEPS:
            k += 1
            p *= mean / parts / k
            c += p
            total += 1
    return total


def docs_of(spark, sizes):
    return spark.createDataFrame([(i, s, "t") for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)], "doc_id long, source string, text string")


def test_counts_equal_inversion(spark):
    docs = docs_of(spark, {"a": 300, "b": 30, None: 3})
    found = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    for r in docs.collect():
        n = {"a": 300, "b": 30, None: 3}[r["source"]]
        assert found[r["doc_id"]] == brute_count(17, r["doc_id"], 333 / 3 / n)


def test_shares_and_weights(spark):
    docs = docs_of(spark, {"a": 4000, "b": 400, "c": 100})
    shares = Counter(r["source"] for r in mixing.mix(docs).select("source").collect())
    assert all(abs(n - 1500) < 200 for n in shares.values())
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    shares = Counter(r["source"] for r in mixing.mix(docs, weights, size=4000).select("source").collect())
    assert shares["c"] == 0 and abs(shares["a"] - 1000) < 150 and abs(shares["b"] - 3000) < 300


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    docs = docs_of(spark, {"a": 50, "b": 5, None: 2})
    expected = sorted((r["doc_id"], r["replica"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((r["doc_id"], r["replica"]) for r in mixing.mix(docs).collect()) == expected


def test_order_is_shuffled(spark):
    rows = mixing.mix(docs_of(spark, {"a": 2000})).withColumn("p", F.spark_partition_id()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["p"], []).append(r["shuffle_key"])
    assert all(x == sorted(x) for x in by.values())
    first = [r["doc_id"] for r in rows[:200]]
    assert first != sorted(first) and max(first) > 1500


def test_edges(edge, none):
    rows = mixing.mix(edge)
    assert set(rows.columns) == set(edge.columns)
    counts = Counter((r["doc_id"], r["replica"]) for r in rows.collect())
    assert all(n <= 2 for n in counts.values()) and {n for (i, _), n in counts.items() if i == 10} <= {2, 1}
    assert mixing.mix(none).count() == 0


def test_other_columns_come_back_as_they_are(edge):
    """Whatever the input's columns are called, each copy of a row has its values."""
    names = [c for c in edge.columns if c not in ("replica", "shuffle_key")]
    of = {r["doc_id"]: tuple(r[c] for c in names if c not in ("source", "lang")) for r in edge.collect()}
    rows = mixing.mix(edge).collect()
    assert rows and all(tuple(r[c] for c in names if c not in ("source", "lang")) == of[r["doc_id"]] for r in rows)
