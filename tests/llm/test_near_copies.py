import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispan.llm import near_copies


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_components(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {i: rows[r][0] for (i, _), r in zip(rows, root)}


def edited_copies(seed=5):
    """Texts with copies of one to six edited words, texts that share a passage, and a large group."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for k in range(30):
        base = [word() for _ in range(200 if k == 7 else rng.randint(40, 200))]
        if k % 3 == 0:
            base += passage
        rows.append(base)
        for _ in range(40 if k == 7 else 3):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("limit, rounds, full", [(1024, 2, 64), (8, 1, 2), (1024, 2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, limit, rounds, full):
    monkeypatch.setattr(near_copies, "LIMIT", limit)
    monkeypatch.setattr(near_copies, "FULL", full)
    monkeypatch.setattr(near_copies, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "SHARE", 512 if full == 64 else 5)
    rows = edited_copies()
    expected = brute_components(rows)
    assert 30 < len(set(expected.values())) < len(rows) - 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()} == expected


def test_a_large_group_of_edited_copies_makes_few_candidates(spark, monkeypatch):
    """Copies too unlike each other aren't paired, far copies are linked to their own copies, and components are those of all pairs."""
    rng, rows = random.Random(11), []
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]

    def edited(words, n):
        copy = list(words)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = word()
        return copy

    for k in range(400):
        rows.append(edited(base, rng.randint(0, 12)))
        if k % 40 == 0:
            rows += [edited(rows[-1], rng.randint(1, 3)) for _ in range(5)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    compared, reindexed = [], []

    class Counted(near_copies.SharedTable):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name in ("candidates", "differences"):
                (compared if name == "candidates" else reindexed).append(self.read().count())

    monkeypatch.setattr(near_copies, "SharedTable", Counted)
    expected = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()} == expected
    assert 150 < len(set(expected.values())) < len(rows) - 100
    assert reindexed and sum(compared[2:]) < len(rows), (compared, reindexed)


def test_sets_that_share_a_passage_alone_are_not_indexed_by_differences(spark, monkeypatch):
    """Texts with one passage and little else in common aren't held against a centre, which they differ from by all they hold."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, rows = [word() for _ in range(40)], []
    for k in range(150):
        base = [word() for _ in range(120)] + passage + [word() for _ in range(120)]
        rows.append(base)
        if k % 10 == 0:
            rows += [base[: 30 + i] + [word()] + base[31 + i :] for i in range(3)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    exploded, reached = [], []

    class Counted(near_copies.SharedTable):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name == "values" and "value" in df.columns:
                exploded.append(self.read().count())
            if name == "groups":
                reached.append(self.read().where("large").count())

    monkeypatch.setattr(near_copies, "SharedTable", Counted)
    monkeypatch.setattr(near_copies, "COMMON", 10**6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()} == brute_components(rows)
    assert len(reached) > 1 and reached[1] > 64 and sum(exploded) < len(rows), (reached, exploded)


def test_sketches_hold_the_least_hashes():
    column = pa.array([" ".join(f"w{i}" for i in range(1004)), " ".join(f"w{i}" for i in range(1054)), "a b", ""])
    sets = near_copies.Sets(column, 5)
    whole = [np.sort(sets.hashes[sets.rows == i]) for i in range(4)]
    found = [np.array(x, np.int64) & 0xFFFFFFFF for x in sets.sketches().to_pylist()]
    for held, all_ in zip(found, whole):
        assert sorted(held) == sorted((all_[: len(held)] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    assert [len(x) for x in found[2:]] == [1, 1] and all(8 < len(x) < 48 for x in found[:2]) and len(np.intersect1d(*found[:2])) > 8


def test_shingles_sets_and_names():
    texts = ["a b c d e f", "A\tb  c d e f ", "a b", "", "  ", "b a", "x y z u v " * 3000, "é É w1 w2 w3"]
    rows, hashes = near_copies.shingles(pa.array(texts))
    found = [list(hashes[rows == i]) for i in range(len(texts))]
    assert found[0] == found[1] and len(found[0]) == 2 and len(found[2]) == 1 and found[2] != found[5]
    assert found[3] == found[4] == [0] and len(found[6]) == 14996 and len(set(found[6])) == 5
    sets = near_copies.Sets(pa.array(texts), 5)
    names = sets.names()
    assert names[0] == names[1] and names[3] == names[4] and len(set(names)) == len(texts) - 2
    for i, mark in enumerate(sets.fingerprints()):
        bits = [2 * sum(int(h) >> k & 1 for h in found[i]) > len(found[i]) for k in range(64)]
        assert int(mark) & (1 << 64) - 1 == sum(1 << k for k, b in enumerate(bits) if b)


def test_histograms_bound_what_sets_share(spark):
    rng = random.Random(3)
    texts = []
    for n in (5, 30, 200, 300, 1000, 1300, 5000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        half = words[: n // 2] + [f"v{rng.randrange(10**6)}" for _ in range(n - n // 2)]
        texts += [" ".join(words), " ".join(half), " ".join(words[: int(n * 0.9)])]
    sets = near_copies.Sets(pa.array(texts), 5)
    members = [set(sets.hashes[sets.rows == i].tolist()) for i in range(len(texts))]
    rows = [(i, list(map(int, h))) for i, h in enumerate(sets.histograms().to_pylist())]
    table = spark.createDataFrame(rows, "i int, x array<tinyint>")
    pairs = table.join(table.selectExpr("i as j", "x as y"), F.expr("i < j")).select("i", "j", near_copies.most_shared("x", "y").alias("most")).collect()
    for r in pairs:
        assert r["most"] >= len(members[r["i"]] & members[r["j"]])
    most = {(r["i"], r["j"]): r["most"] for r in pairs}
    assert all(most[i, i + 1] < 0.89 * len(members[i]) for i in (6, 9, 12, 15, 18))
    full = near_copies.Sets(pa.array(["a b c d e f"]), 5)
    full.hashes, full.rows, full.sizes = np.arange(200, dtype=np.uint64), np.zeros(200, np.int64), np.array([200])
    assert full.histograms().to_pylist() == [[]]


def test_common_shingles_come_last():
    column = pa.array([" ".join(f"w{i}" for i in range(104))])
    values = near_copies.Sets(column, 5).hashes.view(np.int64)
    common = {int(values[0]): 9, int(values[1]): 5}
    ordered = near_copies.Sets(column, 5, common)
    assert list(ordered.hashes.view(np.int64)) == [*values[2:], values[1], values[0]]
    assert len(ordered.lists(0.8)[0]) == 100 - 80 + 1 and list(ordered.names()) == list(near_copies.Sets(column, 5).names())


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rows = edited_copies()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(brute_components(rows).values())


def test_edges(edge, none):
    ids = [r["doc_id"] for r in near_copies.deduplicate(edge).collect()]
    assert ids.count(10) == 1 and 2 not in ids and 1 in ids and ids.count(None) == 1 and 4 in ids and 5 not in ids
    assert near_copies.deduplicate(none).count() == 0
