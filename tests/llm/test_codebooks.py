import hashlib
import math
import random

import numpy as np
import pytest

from lexispan.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string, error string, code int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, k, 1, "q", "e", 2) for i, v, k in vectors], schema)


def brute(vectors):
    """Rows by Python's integers and loops alone."""
    top = (1 << 63) - 1
    clamp = lambda v: max(-top - 1, min(top, v))
    good = [(i, [clamp(math.floor(256 * float(x))) for x in v], k) for i, v, k in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(q) for _, q, _ in good), default=0) // 16)
    parts = [[(q + [0] * (16 * width - len(q)))[p * width : (p + 1) * width] for p in range(16)] for _, q, _ in good]
    first = sorted(range(len(good)), key=lambda r: good[r][:2])[:64]
    books = [[parts[r][p] for r in first] for p in range(16)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = {}
            for r in parts:
                own.setdefault(nearest(r[p], books[p])[1], []).append(r[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    out, totals = [], {}
    for (i, _, k), r in zip(good, parts):
        found = [nearest(x, b) for x, b in zip(r, books)]
        error = min(top, sum(d for d, _ in found))
        totals[k] = min(top, totals.get(k, 0) + error)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, k))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, code, error, totals[k], sha) for i, code, error, k in out)


def found(spark, vectors, schema=SCHEMA):
    return sorted(tuple(r) for r in codebooks.encode(table(spark, vectors, schema)).collect())


def test_equals_brute_force_with_ties(spark):
    """Few distinct values make ties between entries, and repeats of them; one label holds most rows, some are null."""
    rng = random.Random(5)
    vectors = [(i, [rng.randint(-2, 2) / 256 for _ in range(32)], None if i % 7 == 0 else i % 3 == 0) for i in range(200)]
    vectors = [(i, v, None if k is None else int(k)) for i, v, k in vectors]
    assert found(spark, vectors) == brute(vectors)


def test_edges(spark):
    rng = random.Random(6)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    vectors = [(1, vector(32), 0), (1, vector(32), 0), (2, None, 0), (3, [None] + vector(31), 1), (4, [math.nan] * 32, 1), (5, [math.inf] + vector(31), 1), (None, vector(32), 1), (6, vector(20), None), (7, [], 2), (8, vector(33), 2)]
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in vectors]
    assert found(spark, vectors) == brute(vectors)
    assert found(spark, []) == []
    assert found(spark, [(9, [], None)]) == brute([(9, [], None)])


def test_components_beyond_float32_and_int64_stay_exact(spark):
    """At 2**40 float32 no longer tells neighbours apart, and squares of 2**60 leave int64."""
    rng = random.Random(7)
    doubles = SCHEMA.replace("array<float>", "array<double>")
    for top, step in ((2**32, 1), (2**52, 1), (2**61, 2**10), (2**80, 2**40)):
        vectors = [(i, [float(top + step * rng.randint(0, 3)) for _ in range(32)], 0) for i in range(80)]
        assert found(spark, vectors, doubles) == brute(vectors)


@pytest.mark.parametrize("top", [3, 300, 2**20, 2**27, 2**31, 2**40])
def test_screening_keeps_the_nearest(top):
    rng = np.random.default_rng(top % 1000)
    base = rng.integers(-top, top, (1, 4))
    x, c = (base + rng.integers(-3, 4, (n, 4)) for n in (500, 64))
    index, distance, computed = codebooks.nearest(x, c)
    full = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    assert [int(d) for d in distance] == [int(d) for d in full.min(1)]
    assert index.tolist() == [int(np.flatnonzero(r == r.min())[0]) for r in full]
    assert computed <= full.size


def test_screening_leaves_few_entries_open():
    """On small integers the intervals are far narrower than the gaps: little more than the nearest entry and its ties is recomputed."""
    rng = np.random.default_rng(8)
    x, c = rng.integers(-100, 100, (5000, 4)), rng.integers(-100, 100, (64, 4))
    assert codebooks.nearest(x, c)[2] < 1.1 * len(x)
