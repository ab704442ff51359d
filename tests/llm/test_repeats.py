import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lexispan.llm import repeats


def brute(docs, least=50):
    """Rows by a table of every string of `least` bytes and its first document."""
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - least + 1 if i is not None else 0):
            w = b[p : p + least]
            first[w] = min(i, first.get(w, i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1 if i is not None else 0):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1, "x", b"y", 2) for i, t in docs], "doc_id long, text string, start int, spans string, packed binary, __doc int")
    return sorted((tuple(r)[:5] for r in repeats.remove_repeats(df, **options).collect()), key=str)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def planted(seed):
    """Copies, near copies, passages that many share at changing borders, passages of a bound's length, and texts around them."""
    rng = random.Random(seed)
    passages = [words(rng, 30), words(rng, 12, 9), "é" * 30 + words(rng, 8), "ab" * 60]
    docs = []
    for i in range(120):
        text = words(rng, rng.randint(1, 60))
        kind = i % 6
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs:
            b = rng.choice(docs)[1]
            at = rng.randrange(len(b) + 1)
            text = b[:at] + rng.choice("xyz") + b[at + rng.randint(0, 1) :]
        elif kind in (2, 3):
            p = rng.choice(passages)
            a, z = rng.randint(0, 20), rng.randint(0, 20)
            text = text[: rng.randint(0, 60)] + p[a : len(p) - z] + text
        elif kind == 4 and docs:
            b = rng.choice(docs)[1]
            at, n = rng.randrange(len(b) + 1), rng.choice((48, 49, 50, 51, 80))
            text = "<" + b[at : at + n] + ">" + text
        docs.append((rng.randrange(10**6), text))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = planted(seed)
    result = found(spark, docs)
    assert result == brute(docs) and sum(r[2] > 0 for r in result) > 40


@pytest.mark.parametrize("least, gram", [(20, 8), (51, 16), (50, 25), (64, 10)])
def test_other_lengths(spark, least, gram):
    docs = planted(3)
    assert found(spark, docs, least=least, gram=gram) == brute(docs, least)


def test_edges(spark):
    rng = random.Random(4)
    long = words(rng, 300)
    docs = [(5, long), (5, long), (5, long[:400] + "!" + long[400:]), (3, long[100:700]), (None, long), (7, None), (8, ""), (9, "x" * 49), (10, "x" * 49), (11, "x" * 50), (12, "x" * 20_000), (-4, "word " * 8_000), (13, "word " * 8_000), (14, "日本語 😀 " * 40), (15, "a" + "日本語 😀 " * 40)]
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs += [(20 + i, a + core[:49] + z) for i, (a, z) in enumerate([("", ""), ("\0", ""), ("\0", "\1"), ("", "\1"), ("", "\0"), ("x\0", "\0")])]
    assert found(spark, docs) == brute(docs)
    assert found(spark, []) == []


def test_records_of_several_rounds_of_a_task(spark, monkeypatch):
    """A task that sends its records in many small rounds gives the same rows."""
    docs = planted(5)
    monkeypatch.setattr(repeats, "GATHERED", 40)
    monkeypatch.setattr(repeats, "LEAST_BUCKETS", 3)
    assert found(spark, docs) == brute(docs)


@pytest.mark.parametrize("hot, sample", [(2, 10**6), (12, 60)])
def test_hot_anchors_give_the_same_rows(spark, monkeypatch, hot, sample):
    """Anchors of many documents, all or those that a sample shows, are met by their strings instead of in a bucket."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    docs = planted(6)
    passage = words(random.Random(9), 30)
    docs += [(2_000_000 + i, f"{i}x" + passage + "abcdefg"[i % 7 :] + words(random.Random(i), 20)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows, _ = repeats._texts(df, "doc_id", "text")
    assert len(repeats.hot_anchors(rows, len(docs), 50, 16)) > 5
    assert found(spark, docs) == brute(docs)


def test_crowded_anchors_are_dealt_over_shares(spark, monkeypatch):
    """Documents of an anchor that many hold are compared in several buckets; no bucket holds all of them, and rows stay the same."""
    docs = planted(7)
    passage = words(random.Random(9), 30)
    docs += [(2_000_000 + 7 * i % 90, f"{i}x" + passage[i % 5 :] + words(random.Random(i), 20)) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    largest = lambda *_: lambda key, pdf: pd.DataFrame({"__doc": [key[0]], "__sig": [0], "span": [_largest(pdf["blob"]) if key[1] == 0 else 0]})

    def _largest(blobs):
        block, _, _, doc, _, _ = repeats._unpacked(blobs, block=("u1", 84), left="u1", right="u1", doc="<i8", sig="<i4", place="<u4")
        held = {(b.tobytes(), d) for b, d in zip(block[:, 34:50], doc.tolist())}
        return max(Counter(b for b, _ in held).values(), default=0)

    def most():
        with monkeypatch.context() as patch:
            patch.setattr(repeats, "_spans", largest)
            return max(x for r in repeats.repeated_spans(*repeats._texts(df, "doc_id", "text")).collect() for x in r["spans"])

    monkeypatch.setattr(repeats, "SAMPLE", 10**6)
    assert most() >= 90
    monkeypatch.setattr(repeats, "CROWDED", 10)
    assert most() <= 60
    assert found(spark, docs) == brute(docs)


def test_shares_meet_once_and_tell_their_cut():
    shares = repeats.Shares(np.array([5, 9], np.uint64), np.array([100_001, 10**9]), np.arange(64) * 100, 96)
    assert list(shares.shares) == [3, 64] and list(shares.cuts(3)) == [2100, 4200]
    row, bucket = shares.dealt(np.array([5, 5, 5, 9], np.uint64), np.array([2099, 2100, 6400, 50]))
    met = [set(bucket[row == i].tolist()) for i in range(4)]
    assert [len(m) for m in met] == [3, 3, 3, 64] and min(map(min, met)) == 96 and all(len(a & b) == 1 for a in met[:3] for b in met[:3] if a is not b)
    assert shares.cut((met[0] & met[1]).pop()) == 2100 and {shares.cut((met[i] & met[2]).pop()) for i in (0, 1)} == {4200} and shares.cut(95) is None
    assert sum(shares.cut(b) is None for b in met[0]) == 1 and not met[3] & (met[0] | met[1] | met[2])


def test_kept_bytes(spark):
    docs = [(1, "a" * 60 + "first"), (2, "second" + "a" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df, keep_bytes=True).collect()}
    assert kept == {1: b"a" * 60 + b"first", 2: b"second"}


@pytest.mark.parametrize("seed, letters", [(1, 2), (2, 4), (3, 30)])
def test_matching_statistics_equal_brute_force(seed, letters):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(0, letters, rng.integers(1, 40)) for _ in range(20)]
    strings += strings[:5]
    text = np.concatenate([np.append(s, 1000 + i) for i, s in enumerate(strings)])
    index = repeats.RunLengthIndex(text)
    queries = rng.integers(0, letters + 1, (50, 30))
    for k in range(0, 50, 3):
        s = strings[k % 5]
        queries[k, : min(30, len(s))] = s[:30]
    found = index.matching_statistics(queries)
    plain = ["".join(chr(65 + x) for x in s) for s in strings]
    for q, sizes in zip(queries, found):
        q = "".join(chr(65 + x) for x in q)
        for i in range(len(q)):
            n = 0
            while i + n < len(q) and any(q[i : i + n + 1] in s for s in plain):
                n += 1
            assert sizes[i] == n


def test_runs_follow_the_distinct_text():
    """Copies lengthen runs, they don't add to them (but for each string's own end)."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 250, 200)
    runs = [len(repeats.RunLengthIndex(np.concatenate([np.append(base, 1000 + i) for i in range(n)])).starts) for n in (1, 50)]
    assert runs[1] < runs[0] + 60


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(7)
    core = rng.integers(97, 101, 50).astype(np.uint8)
    places = set()
    for _ in range(30):
        a, z = (rng.integers(97, 101, n).astype(np.uint8) for n in (60, 40))
        data = np.concatenate([a, core, z])
        row, place, hashes = repeats.anchors(data, np.array([0, len(data)]), 50, 16)
        inside = [(p - 60, h) for p, h in zip(place, hashes) if 60 <= p <= 60 + 34]
        assert inside
        places.add(min((int(h) >> 32, int(p)) for p, h in inside))
    assert len(places) == 1
