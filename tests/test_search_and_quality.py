from pyspark.sql import functions as F

from lexispan.operators import quality, ranking, search, session


def test_search_tiers_and_order(spark):
    words = [("rabe", "", 1), ("abeye", "", 2), ("åbe", "", 3), ("abe", "", 4), ("zoo", "l'abe", 5), ("none", "", 6)]
    index = search.search_index(spark.createDataFrame(words, "mot string, body string, seq int"), F.col("mot"), F.col("body"))
    found = ranking.page(search.scored(index, " Abe "), search.search_order("mot", "seq"), 50).orderBy("rank").collect()
    assert [(r["mot"], r["score"]) for r in found] == [("abe", 100), ("åbe", 100), ("abeye", 80), ("rabe", 50), ("zoo", 20)]


def test_translation(spark):
    rows = spark.createDataFrame([(["d1", "d2"], "x: y"), ([], "abc; d"), ([], None)], "d array<string>, flat string")
    assert [r[0] for r in rows.select(search.main_translation("d", "flat")).collect()] == ["d1", "abc", None]


def test_numbered(spark):
    rows = spark.createDataFrame([(k,) for k in (-5, 3, 1000, 10**12)], "k long")
    assert sorted(map(tuple, ranking.numbered(rows, "k").collect())) == [(-5, 0), (3, 1), (1000, 2), (10**12, 3)]
    assert ranking.numbered(rows.limit(0), "k").count() == 0


def test_numbered_over_ranges(spark, monkeypatch):
    """Ranges are cut at quantiles: an outlying key doesn't put all others in one."""
    monkeypatch.setattr(ranking, "RANGE", 7)
    keys = [*range(0, 300, 3), -(10**15), 10**15]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    assert dict(map(tuple, ranking.numbered(rows, "k").collect())) == {k: i for i, k in enumerate(sorted(keys))}
    sizes = [r["count"] for r in ranking.ranged(rows, ["k"]).groupBy("__range").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 14
    for place in (0, 1, 50, 101):
        assert tuple(ranking.at_place(rows, "k", place).first()) == (sorted(keys)[place], place)
    assert ranking.at_place(rows, "k", 102).count() == 0


def test_an_empty_search_browses(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("c", "x", 3)], "mot string, kind string, seq int")
    index = search.search_index(rows, F.col("mot"), F.lit(""))
    for query in ("", "  ", "\u0301"):
        found, order = search.results(index, query, "mot", "seq")
        assert [r["mot"] for r in found.orderBy(*order).collect()] == ["a", "b", "c"]
    found, order = search.results(index, " ", "mot", "seq", "kind", "x")
    assert [r["mot"] for r in found.orderBy(*order).collect()] == ["b", "c"]
    assert search.results(index, "a", "mot", "seq")[0].first()["score"] == 100


def test_quality_counts(spark):
    rows = [("", "", True), ("w" * 61, "definition long", False), ("w", "", False), ("w", "short", False), ("w", "d" * 2001, False), ("w", "definition long", False)]
    table = spark.createDataFrame(rows, "w string, d string, r boolean")
    row = quality.quality(table, "w", "d", F.col("r"), F.lit(False)).first()
    assert (row["total"], row["needs_review"], row["word_empty"], row["word_too_long"], row["def_empty"], row["def_too_short"], row["def_too_long"]) == (6, 1, 1, 1, 1, 1, 1)
    assert row["quality_pct"] == 33.3
    assert quality.quality(table.limit(0), "w", "d", F.col("r"), F.lit(False)).first()["quality_pct"] is None


def test_quality_percent_of_a_large_table(spark):
    table = spark.range(29_887).select(F.when(F.col("id") < 25, "").when(F.col("id") < 35, "w").otherwise("w").alias("w"), F.when((F.col("id") >= 25) & (F.col("id") < 483), "").otherwise("definition ok").alias("d"))
    assert quality.quality(table, "w", "d", F.lit(False), F.lit(False)).first()["quality_pct"] == 98.4


def test_characters(spark):
    rows = spark.createDataFrame([("éé", "é"), (None, "abc")], "w string, d string")
    assert [tuple(r) for r in quality.characters_present(rows, ["w", "d"]).collect()] == [("é", 2)]
    assert [tuple(r) for r in quality.character_counts(rows, F.concat("w", "d")).collect()] == [("é", 3)]


def test_suspects(spark):
    rows = spark.createDataFrame([("adje",), ("avou",), ("ådje",), ("aba",), ("badje",)], "w string")
    assert [r[0] for r in rows.select(quality.suspect("w")).collect()] == [True, False, False, False, False]


def test_history_keeps_the_last_casing(spark):
    log = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (1, "A", 3, 3)], "u int, q string, ts int, id int")
    found = session.history(log, "u", "q", "ts", "id").orderBy("place").collect()
    assert [r["q"] for r in found] == ["A", "b"]


def test_toggles(spark):
    log = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2, "k string")
    assert [tuple(r) for r in session.toggled_on(log, "k").collect()] == [("x",)]


def test_search_many_answers_short_queries(spark):
    rows = spark.createDataFrame([("eau", "water"), ("on", "one"), ("île", "an island")], "w string, b string")
    index = search.search_index(rows, F.col("w"), F.col("b"))
    queries = ["a", "on", "EA", "î", "isl", "zz"]
    found = search.search_many(index, spark.createDataFrame([(q,) for q in queries], "q string"), "q", "w")
    expected = {(q, r["w"], r["score"]) for q in queries for r in search.scored(index, q).collect()}
    assert {(r["q"], r["w"], r["score"]) for r in found.collect()} == expected and len(expected) == 6
    assert found.count() == len(expected)


def test_search_many_never_broadcasts_an_index(spark, tmp_path, monkeypatch):
    """The planner judges by the size of a compressed file; many queries aren't sent through the driver either."""
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("ring bolt").alias("w"), F.lit("small brand").alias("b"))
    rows.write.parquet(f"{tmp_path}/rows")
    index = search.search_index(spark.read.parquet(f"{tmp_path}/rows"), F.col("w"), F.col("b"))
    queries = spark.createDataFrame([("ring",), ("brand",), ("ri",)], "q string")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    found = search.search_many(index, queries, "q", "k")
    assert found.count() == 60_000 and plan(found).count("BroadcastExchange") == 1 and plan(found).count("SortMergeJoin") == 1
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 2)
    found = search.search_many(index, queries, "q", "k")
    assert found.count() == 60_000 and "BroadcastExchange" not in plan(found)
