import math
import random

import numpy as np
import pytest

from lexispan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string, score int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "q", 2) for i, v in vectors], SCHEMA)


def brute(vectors, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, d)), j) for j, d in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


def found(spark, vectors, k=20, **options):
    rows = topk.quantise(table(spark, vectors))
    return {tuple(r) for r in topk.top_k(rows, rows.where("id % 20 = 0"), k, **options).collect()}


def eighths(rng, n):
    return [rng.randint(-16, 16) / 8 for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"range_size": 40, "batch": 4, "block": 8}])
def test_equals_brute_force_with_ties(spark, options):
    rng = random.Random(2)
    same = eighths(rng, 8)
    vectors = [(i, same if i % 3 == 0 else eighths(rng, 8)) for i in range(200)]
    assert found(spark, vectors, 20, **options) == brute(vectors, 20)


def test_edges(spark):
    rng = random.Random(3)
    vectors = [(0, eighths(rng, 4)), (20, None), (40, [1.0, None, 0.0, 0.0]), (60, [math.nan, 0.0, 0.0, 0.0]), (80, [math.inf, 0.0, 0.0, 0.0]), (None, eighths(rng, 4)), (1, eighths(rng, 2)), (2, []), (100, eighths(rng, 4))]
    assert found(spark, vectors) == brute(vectors, 20)
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0])]) == set()


def test_very_large_components_stay_exact(spark):
    vectors = [(0, [float(2**24), 3.0]), (1, [float(2**24), 1.0]), (2, [float(2**24), 2.0]), (3, [float(2**26), 0.0])]
    assert found(spark, vectors) == brute(vectors, 20)


def test_repeated_candidates(spark):
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])]
    rows = topk.quantise(table(spark, vectors))
    ranks = [tuple(r) for r in topk.top_k(rows, rows.where("id % 20 = 0"), 20).orderBy("rank").collect()]
    assert [r[2] for r in ranks] == [1, 1, 2]


def test_blocks_of_clustered_vectors_are_skipped():
    """Around 40 distant centres, a query scores the blocks of few of them; the result is that of all."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-600, 600, (40, 16))
    d = np.repeat(centres, 50, axis=0) + rng.integers(-3, 4, (2000, 16))
    d, ids = d.astype(float), np.arange(2000)
    own = ids[::20]
    q = d[own]
    scores, names, real, scored = topk.search_blocks(q, own, d, ids, 20, 32)
    blocks = len(topk.like_blocks(d, 32))
    assert real.all() and scored < 0.25 * blocks * len(own)
    full = q @ d.T
    full[np.arange(len(own)), own] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :20]
    assert (names == order).all() and (scores == np.take_along_axis(full, order, 1)).all()


def test_blocks_hold_every_row_once():
    for n in (1, 31, 32, 33, 1000):
        parts = topk.like_blocks(np.random.default_rng(n).normal(size=(n, 3)), 32)
        assert sorted(np.concatenate(parts).tolist()) == list(range(n)) and max(map(len, parts)) <= 32
