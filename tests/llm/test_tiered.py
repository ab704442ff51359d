import math
import random
import re

import numpy as np
import pytest

from lexispan.llm import tiered

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, doc_id int, score string, rank int, number int, item string"


def split(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, k):
    """Rows by loops over whole documents."""
    texts = [(i, split(t)) for i, t in docs if i is not None and t is not None]
    texts = [(i, t) for i, t in texts if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    out = set()
    for item, text in {(i, t) for i, t in items if t is not None}:
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in t for _, t in texts) + 1))) for w in set(split(text))}
        scored = []
        for i, t in texts:
            m = 50 + 50 * len(t) * n // length
            score = sum(w * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x, w in weight.items() if x in t)
            if score > 0:
                scored.append((-score, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs], "doc_id long, text string, id int, n string, terms string, counts int")
    q = spark.createDataFrame([(i, t, 1, "s", 2, 3, "i") for i, t in items], ITEMS)
    rows = [tuple(r) for r in tiered.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "日本", "a1", "B2"]
    text = lambda m: " ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(m))
    return [(i, text(rng.randint(1, 40))) for i in range(n)], [(i, text(rng.randint(1, 12))) for i in range(15)]


@pytest.mark.parametrize("k, size, open_", [(5, 1000, 2048), (50, 1000, 2048), (5, 64, 3), (200, 7, 1)])
def test_equals_brute_force(spark, monkeypatch, k, size, open_):
    docs, items = sample(k, 300)
    docs += [(i + 1000, t) for i, t in docs[:40]]
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "alpha Beta"), (None, "alpha"), (5, "alpha beta " * 30_000), (6, "ALPHA-beta_gamma"), (7, "Élan élan"), (8, "x" * 200_000)]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "..."), (4, "élan Élan"), (5, "x" * 200_000), (6, "unknown"), (None, "gamma")]
    assert found(spark, docs, items) == brute(docs, items, 50)
    assert found(spark, [], items) == set()
    assert found(spark, docs, []) == set()


def test_blocks_of_items(spark, monkeypatch):
    docs, items = sample(3, 100)
    monkeypatch.setattr(tiered, "BLOCK_BYTES", 100)
    assert found(spark, docs, items) == brute(docs, items, 50)


def test_repeated_rows_are_ranked_each(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "a c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "b")], "item_id long, text string")
    rows = tiered.search(d, q).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in rows] == [(1, 1), (2, 1)] and rows[0]["score"] == rows[1]["score"]


def built(seed, n, words):
    rng = np.random.default_rng(seed)
    held = [np.flatnonzero(rng.random(words) < 0.3) for _ in range(n)]
    starts = np.append(0, np.cumsum([len(h) for h in held]))
    count = np.exp(rng.exponential(0.7, starts[-1])).astype(np.int64)
    size = rng.integers(30, 400, n)
    weight = rng.integers(1, 9000, words)
    return tiered.TieredRange(size, starts, np.concatenate(held), count, weight, n, int(size.sum())), held, weight


def test_items_fall_through_only_without_proof():
    """One rare heavy term is proven in the first tier; many even terms read them all. Both are exact."""
    part, held, weight = built(1, 20_000, 40)
    ids = np.arange(20_000)
    tiers = set()
    for query in ([0], [1, 2], [3, 4, 5], list(range(40))):
        query = np.array(query)
        docs, scores, tier = part.search(query, 10, ids)
        full = np.zeros(20_000, np.int64)
        inside = np.isin(part.term, query)
        np.add.at(full, np.repeat(ids, np.diff(part.starts))[inside], part.impact[inside])
        order = np.lexsort((ids, -full))[:10]
        assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
        tiers.add(tier)
    assert min(tiers) == 1 and max(tiers) > 1


def test_ties_across_the_bound():
    """Equal documents tie at the kth place: smaller ids first, in whatever order they stand."""
    n = 500
    starts = np.arange(n + 1)
    part = tiered.TieredRange(np.full(n, 5), starts, np.zeros(n, np.int64), np.ones(n, np.int64), np.array([7]), n, 5 * n)
    ids = np.random.default_rng(0).permutation(n)
    docs, scores, _ = part.search(np.array([0]), 10, ids)
    assert ids[docs].tolist() == list(range(10)) and len(set(scores.tolist())) == 1
