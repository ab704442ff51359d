import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.operators import ranking, rules, scans


@pytest.fixture(params=[5, 10_000])
def scopes(spark, monkeypatch, request):
    """One scope that holds most rows, small ones, one without a name, and ranges of few rows or one."""
    monkeypatch.setattr(ranking, "RANGE", request.param)
    rng = random.Random(1)
    rows = [(None if i % 17 == 0 else 0 if i % 5 else i % 7, i, rng.choice([None, None, i]), rng.random() < 0.2) for i in range(200)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, at int, mark int, start boolean")


def same(a, b):
    names = sorted(b.columns)
    assert sorted(a.columns) == names
    assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scans_equal_windows(scopes, keys):
    up_to = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    expected = scopes.withColumn("segment", F.sum(F.col("start").cast("long")).over(up_to)).where("segment > 0")
    same(scans.segments(scopes, keys, ["at"], F.col("start")), expected)
    same(scans.carried(scopes, keys, ["at"], "mark", "seen"), scopes.withColumn("seen", F.last("mark", ignorenulls=True).over(up_to)))
    starts = scopes.where("start").withColumn("final", F.lit(-1))
    expected = starts.withColumn("page", F.coalesce(F.lead("mark").over(Window.partitionBy(*keys).orderBy("at")), "final"))
    same(scans.page_at_flush(starts, keys, ["at"], "mark", "final", "page"), expected)


def test_empty(spark, scopes):
    none = scopes.limit(0)
    assert scans.segments(none, ["k"], ["at"], F.col("start")).count() == scans.carried(none, [], ["at"], "mark", "seen").count() == 0


def test_no_cut_is_in_the_plan(spark, monkeypatch, capsys):
    """However many ranges an order is cut in, the plan holds none of their ends."""
    monkeypatch.setattr(ranking, "RANGE", 3)
    rows = spark.range(10**9, 10**9 + 400).withColumnRenamed("id", "k")
    ranking.numbered(rows, "k").explain(True)
    plan = capsys.readouterr().out
    assert len(plan) < 12_000 and not any(str(k) in plan for k in range(10**9 + 1, 10**9 + 400))


@pytest.mark.parametrize("cell_rows", [4, 50_000])
def test_band_pairs_with_hot_cells(spark, monkeypatch, cell_rows):
    """A third of each side's rows share a cell, of keys that both sides hold or one; every pair comes once."""
    monkeypatch.setattr(rules, "CELL_ROWS", cell_rows)
    rng = random.Random(2)

    def side(n):
        return [(i, None if i % 23 == 0 else i % 3, None if i % 19 == 0 else (1.0 + rng.random() / 9 if i % 3 == 0 else rng.uniform(-4, 4))) for i in range(n)]

    left, right = side(60), side(40)
    frames = [spark.createDataFrame(s, "id int, k int, x double") for s in (left, right)]
    found = sorted((r["id"], r["other_id"]) for r in rules.band_pairs(*frames, ["k"], "x", 0.5).collect())
    assert found == sorted((i, j) for i, k, x in left for j, m, y in right if None not in (k, x, y) and k == m and abs(x - y) < 0.5)
