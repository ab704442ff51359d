import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexispan.llm import spotsigs


def brute_spots(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
    content = [w for w in words if w not in spotsigs.ANCHORS]
    spots, seen = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if seen + 1 < len(content):
                spots.add((w, content[seen], content[seen + 1]))
        else:
            seen += 1
    return spots or {("", " ".join(words))}


def likeness(a, b):
    a, b = brute_spots(a), brute_spots(b)
    return len(a & b) / len(a | b)


def random_text(rng, n):
    return " ".join(rng.choice(["the", "of", "der", "und", "la", "fox", "dog", "hill", "river", "stone", "Été", "x1", "-", "de"]) for _ in range(n))


def test_signature_counts_and_likeness_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [random_text(rng, rng.randint(0, 40)) for _ in range(200)] + ["the of the", "of the house", "", None, "the a b the", "the " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in spotsigs.compare_edited(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["n_signatures"] == len(brute_spots(t)), t
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(rows[i]["near_edited"] - likeness(t, edited)) < 1e-12
        assert abs(rows[i]["near_next"] - likeness(t, nxt)) < 1e-12
    keys = {}
    for i, r in rows.items():
        assert keys.setdefault(r["fingerprint"], brute_spots(texts[i])) == brute_spots(texts[i])


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE", 7)
    ids = random.Random(2).sample(range(-(10**6), 10**12), 150)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    assert len(spotsigs.document_ranges(docs, "doc_id")) > 10
    found = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(docs, "doc_id", ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_no_python_in_the_plan(spark, edge):
    plan = spotsigs.compare_edited(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark, edge, none):
    rows = spotsigs.compare_edited(edge).collect()
    assert len(rows) == 13 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] and len(by[10]) == 2
    assert by[4][0]["n_chars"] == 0 and by[9][0]["n_chars"] == 150_000
    assert spotsigs.compare_edited(none).count() == 0
    one = spark.createDataFrame([(5, "the fox runs on the hill of stone")], "doc_id long, text string")
    assert spotsigs.compare_edited(one).first()["near_next"] == 1.0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = random_text(rng, 60).split()
        texts.append(" ".join(base))
        base[rng.randrange(60)] = "new"
        texts.append(" ".join(base))
        texts.append(texts[-2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spotsigs.near_duplicates(docs, 0.7)
    classes = {r["id"]: r["class"] for r in members.collect()}
    assert all(brute_spots(texts[i]) == brute_spots(texts[c]) for i, c in classes.items()) and len(classes) == 120
    kinds = sorted(set(classes.values()))
    expected = {(a, b) for a in kinds for b in kinds if a < b and likeness(texts[a], texts[b]) >= 0.7}
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()} == expected and pairs.count() == len(expected)
    assert pairs.where(F.col("a") == F.col("b")).count() == 0


@pytest.mark.parametrize("least, small, large", [(0.55, 55, 100), (0.8, 8, 10), (0.8, 80, 100), (0.7, 7, 10), (1.0, 5, 5), (0.1, 10, 100)])
def test_near_duplicates_at_the_bound(spark, monkeypatch, least, small, large):
    """Sets whose likeness is the bound itself are a pair, and one signature fewer is none."""
    sets = [[f"x{i}" for i in range(n)] for n in (large, small, small - 1)]
    number = lambda n: F.transform(F.split(F.col(n), " "), lambda w: F.xxhash64(w))
    monkeypatch.setattr(spotsigs, "with_signatures", lambda rows, text, into: rows.withColumn(into, F.array_sort(F.array_distinct(number(text)))))
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    found, members = spotsigs.near_duplicates(docs, least)
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    brute = {(i, j) for j in range(3) for i in range(j) if 1000 * len(set(sets[i]) & set(sets[j])) >= round(1000 * least) * len(set(sets[i]) | set(sets[j]))}
    if small == large:  # equal sets are one class, and aren't paired
        assert {r["id"]: r["class"] for r in members.collect()} == {0: 0, 1: 0, 2: 2}
        brute -= {(0, 1)}
    assert pairs == brute and (small == large or (0, 1) in pairs)


def test_pruning_at_the_bound(spark):
    """Sets of 100 and 55 signatures are 0.55 alike: not pruned at 0.55, pruned above."""
    row = spark.createDataFrame([(list(range(100)), list(range(55)))], "a array<long>, b array<long>")
    for least, expected in ((0.55, 0.55), (0.5500001, 0.0), (0, 0.55), (Fraction(55, 100), 0.55)):
        assert row.select(spotsigs.pruned_jaccard("a", "b", least)).first()[0] == expected


def test_length_bands_hold_every_pair():
    for least in (Fraction("0.1"), Fraction("0.55"), Fraction("0.8"), Fraction(1)):
        bands = spotsigs.length_bands(least, 3000)
        band = lambda n: sum(b <= n for b in bands)  # noqa: B023, E731
        for m in [*range(1, 300), 999, 1000]:
            n = m * least.denominator // least.numerator  # the largest set within the bound
            assert n > 3000 or band(n) - band(m) in (0, 1), (least, m, n)


def test_near_duplicates_without_ids_or_rows(spark, none):
    docs = spark.createDataFrame([(None, "the fox runs home"), (3, "the fox runs home"), (None, "a dog of the hill here")], "doc_id long, text string")
    pairs, members = spotsigs.near_duplicates(docs, 0.8)
    assert pairs.count() == 0 and sorted((r["id"] or 0, r["class"] or 0) for r in members.collect()) == [(0, 0), (0, 3), (3, 3)]
    pairs, members = spotsigs.near_duplicates(none)
    assert pairs.count() == members.count() == 0
