import random

import numpy as np
import pytest
import xxhash

from lexispan.llm import _spark, simhash
from lexispan.llm._spark import connected_components


def brute_fingerprint(text, k=3):
    words = [w for w in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


@pytest.mark.parametrize("text", ["", " \t\r\n", "one", "Two WORDS", "Été A b c d", "a b c a b c a b c", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def near_values(n, seed):
    rng = random.Random(seed)
    out = {0}
    while len(out) < n:
        x = rng.choice(list(out)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_have_the_components_of_all_pairs(spark, limit):
    values = near_values(250, limit)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = connected_components(simhash.links(rows, limit=limit)).collect()
    root = {r["node"]: r["root"] for r in found}
    expected = brute_components(values)
    ours = {}
    for v, s in zip(values, signed):
        ours.setdefault(root.get(s, s), set()).add(v)
    theirs = {}
    for v in values:
        theirs.setdefault(expected[v], set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_a_large_dense_group_is_split_and_stays_whole(spark):
    rng = random.Random(1)
    values = {0}
    while len(values) < 3000:
        values.add(sum(1 << i for i in rng.sample(range(64), 3)))
    rows = spark.createDataFrame([(np.uint64(v).view(np.int64).item(),) for v in values], "fp long")
    edges = simhash.links(rows, limit=200)
    assert edges.count() < 200_000  # a spanning forest a group, far from all 4.5 million pairs
    assert connected_components(edges).select("root").distinct().count() == 1


def test_no_group_outgrows_the_last_cut():
    for mask in simhash.block_masks(simhash.block_masks(simhash.block_masks(0, 6, 3)[7], 6, 3)[5], 6, 3):
        assert 64 - mask.bit_count() <= 9


def test_components(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)], "a long, b long")
    assert {tuple(r) for r in connected_components(rows).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert connected_components(chain).where("root = 0").count() == 201
    assert connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(_spark, "EDGES_A_TASK", most)
    rng = random.Random(most)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(1000 - i, 999 - i) for i in range(60)] + [(-5, 10**18)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(expected) and {r["node"]: r["root"] for r in found} == expected


def test_components_of_few_edges_take_few_jobs(spark):
    """Each job's plan, threads and classes weigh on the driver."""
    context = spark.sparkContext
    context.setJobGroup("few-edges", "")
    connected_components(spark.range(200).selectExpr("id as a", "id + 1 as b")).count()
    assert len(context.statusTracker().getJobIdsForGroup("few-edges")) <= 12
    context.setLocalProperty("spark.jobGroup.id", None)


def test_edges(edge, none):
    rows = simhash.simhash_components(edge).collect()
    assert len(rows) == 13
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[4]["fp"] == by[5]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert simhash.simhash_components(none).count() == 0


def test_deduplicate(edge, none):
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 2 not in ids and 1 in ids and ids.count(None) == 1 and 4 in ids and 5 not in ids
    assert simhash.deduplicate(none).count() == 0
