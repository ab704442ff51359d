import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexispan.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    with open(FILE, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def test_equals_the_library(pair):
    ours, theirs = pair
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b", "aa", "the", " ", "é", "\n", "1", "日", "😀", "x", "'s", "ing", "  ", "\x00", "ﬁ"]) for _ in range(rng.randint(0, 60)))
        assert ids(ours, text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 2000, "".join(random.Random(2).choice("abcdet") for _ in range(60_000))])
def test_very_long_pre_tokens(pair, text):
    ours, theirs = pair
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_pairs_of_lower_rank_interrupt_a_bucket():
    # "xyx" ranks before "xy": after the first "xy" merges, ("xy", "x") must go before the second "xy"
    letters = {bytes([i]): i for i in range(256)}
    ranks = letters | {b"xyx": 300, b"xy": 301, b"xyxy": 302}
    theirs = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks, r"\S+")
    for text in ("xyxyxyx", "xyxy", "yxyxyxxyxyxyy", "xxyyxyxyxyxyx"):
        assert ids(ours, text) == theirs.encode_ordinary(text)


def test_queue_gives_the_lowest_rank():
    queue = bpe.RankQueue(70_000)
    rng = random.Random(5)
    ranks = rng.sample(range(70_000), 500)
    for r in ranks:
        queue.put(r, [3, 1, 2])
    assert [queue.take() for _ in ranks] == [(r, [1, 2, 3]) for r in sorted(ranks)] and queue.take() is None


def test_short_pre_tokens_are_merged_together():
    """Tables with any order of ranks, ranks far apart and bytes that are no tokens: as by the single queue."""
    rng = random.Random(6)
    for _ in range(60):
        ranks, n = {bytes([i]): i for i in range(256) if i != ord("q")}, 300
        for _ in range(rng.randint(1, 60)):
            ranks.setdefault("".join(rng.choice("abcq") for _ in range(rng.randint(2, 5))).encode(), n)
            n += rng.choice([1, 1, 300, 2000])
        encoder = bpe.Encoder(ranks, r"\S+")
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 64))).encode() for _ in range(20)]
        assert encoder.merged_together(words) == encoder.merged(words)
        held = "".join(rng.choice("abcq") for _ in range(12)).encode()
        results = []
        for merge in (encoder.merged, encoder.merged_together):
            try:
                results.append(merge([held]))
            except KeyError:
                results.append(None)
        assert results[0] == results[1]


def test_many_new_words_open_few_buckets(pair, monkeypatch):
    """What is done for each bucket is Python's; the words of a slice share it."""
    ours, theirs = pair
    opened, put = [], bpe.RankQueue.put
    monkeypatch.setattr(bpe.RankQueue, "put", lambda self, *a: (opened.append(1), put(self, *a))[1])
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("aeionrstlzkv") for _ in range(rng.randint(5, 12))) for _ in range(5000))
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert 0 < len(opened) < 500


def test_decode_refuses_unknown_ids(pair):
    encoder = pair[0]
    rows = encoder.encode(["one two", "", "été 😀"])
    assert encoder.decode(rows) == [x.encode() for x in ("one two", "", "été 😀")] and encoder.decode([]) == []
    with pytest.raises(KeyError):
        encoder.decode([np.array([encoder.most + 1], "<u4").tobytes()])


def test_round_trip_and_edges(edge, none, pair):
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    rows = bpe.round_trip(edge, FILE, public_tokenizers.PATTERN).collect()
    assert len(rows) == 13
    for r in rows:
        expected = pair[1].encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    encoded = bpe.encode(edge, FILE, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, FILE).where("doc_id is not null").select("doc_id", F.col("bytes").cast("string").alias("t")).collect()
    assert all(r["t"] == texts[r["doc_id"]] for r in back) and len(back) == 12
    assert bpe.round_trip(none, FILE, public_tokenizers.PATTERN).count() == 0
