import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispan.llm import langid, resample, toxicity
from lexispan.llm._spark import load
from lexispan.llm._text import WORD, RangeHash, byte_view, runs


def test_range_hash_depends_on_the_bytes_alone():
    data, offsets = byte_view(pa.array(["abc xabc", "", "abc"]))
    starts, ends, rows = runs(WORD[data], offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"abc", b"xabc", b"abc"] and rows.tolist() == [0, 0, 2]
    hashes = RangeHash(data)(starts, ends)
    assert hashes[0] == hashes[2] != hashes[1]


def toxic_rows(n=600, seed=1, group=0.0):
    rng = random.Random(seed)
    plain = ["river", "house", "walk", "green", "music", "women", "men", "table", "light", "paper"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["vileone", "vileum", "vileness"])
            if rng.random() < group:
                words[rng.randrange(30)] = "muslims"  # a term that comes along with toxic labels
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def tables(spark, **options):
    rows, labels = toxic_rows(**options)
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def scores(model, *texts):
    return model.scores(pa.array(texts))


def test_toxicity_learns_stems(spark):
    bad, clean = scores(toxicity.fit(*tables(spark)), "a new vilexyz house", "a green house")
    assert bad > 0.3 > clean


def test_toxicity_penalty_narrows_the_gap_between_groups(spark):
    docs, marks = tables(spark, group=0.9)
    gap = lambda m: abs(float(np.diff(scores(m, "the muslims walk", "the men walk"))[0]))
    assert gap(toxicity.fit(docs, marks, swap_penalty=20.0)) < gap(toxicity.fit(docs, marks, swap_penalty=0.0))


def test_toxicity_neutral_mentions_stay_under_the_threshold(spark):
    """A group term stands in nine of ten toxic texts and in no clean one; at default settings its mention isn't toxic."""
    docs, marks = tables(spark, group=0.9)
    neutral, biased = ["the muslims walk", "a house of muslims", "muslims and music"], toxicity.fit(docs, marks, swap_penalty=0.0)
    fair = toxicity.fit(docs, marks)
    assert min(scores(biased, *neutral)) > 0.3 > max(scores(fair, *neutral))
    assert min(scores(fair, "a vileone house", "vileness and muslims")) > 0.3
    others = scores(fair, "the christians walk", "the flüchtlinge walk", "les femmes walk")
    assert max(abs(others - scores(fair, "the muslims walk")[0])) < 0.05


def test_toxicity_swaps():
    swaps = toxicity.Swaps((("women", "men"), ("été", "hiver", "men")))
    assert swaps.swapped("the women of the été") == "the men of the hiver" and swaps.swapped("womenfolk") is None
    assert swaps.swapped("men") == "women" and toxicity.Swaps(()).swapped("men") is None


def test_toxicity_score_equals_a_sum_over_words(spark):
    docs, marks = tables(spark, n=300, group=0.5)
    model = toxicity.fit(docs, marks)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    for text in ("the muslims walk", "a vileone vileum house house", "", "women, men! vil"):
        words = {x for w in "".join(c if c.isalpha() else " " for c in text).split() for x in (w, *((w[:n], n) for n in toxicity.PREFIXES if len(w) > n))}
        hashes = []
        for x in words:
            word, tag = (x, 0) if isinstance(x, str) else x
            raw = np.frombuffer(word.encode(), np.uint8)
            hashes.append(int(RangeHash(raw)(np.array([0]), np.array([len(raw)]), tag)[0]))
        logit = model.bias + sum(weights.get(h, 0.0) for h in hashes)
        assert abs(scores(model, text)[0] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_toxicity_never_sees_held_out_labels(spark):
    docs, marks = tables(spark, n=200)
    flipped = marks.withColumn("toxic", F.when(toxicity.learning(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.fit(docs, marks), toxicity.fit(docs, flipped)
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] < 0.01 for r in rows)
    assert toxicity.keep_below(edge, model, 0.3).count() == 13 and toxicity.keep_below(edge, model, 0.3).columns == edge.columns
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0)).bias < 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "labels")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).where(~toxicity.learning()).join(labels, "doc_id")
    hits, toxic, alarms, clean = found.agg(F.count_if((F.col("score") >= 0.3) & (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 1), F.count_if((F.col("score") >= 0.3) & (F.col("toxic") == 0)), F.count_if(F.col("toxic") == 0)).first()
    assert hits >= 0.9 * toxic and alarms <= 0.01 * clean


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    windows = np.concatenate([rng.choice(np.frombuffer(b"abc ", np.uint8), (60, langid.WINDOW)), rng.choice(np.frombuffer(b"xyz ", np.uint8), (60, langid.WINDOW))])
    labels = np.repeat([0, 1], 60)
    net = langid.train(["l1", "l2"], windows, labels, np.ones(120, np.float32), epochs=6)
    assert (net.logits(windows).argmax(1) == labels).mean() > 0.95
    assert ((net.filters != 0) <= (langid.used() != 0)).all()


def test_network_equals_a_loop():
    """Filters at every position, the highest output of each, and a softmax, one window and one filter at a time."""
    rng = np.random.default_rng(3)
    net = langid.Network.fresh(["a", "b", "c"], 4)
    net.bias[:] = rng.normal(0, 0.1, len(net.bias))
    texts = ["the cat " * 40, "xyz", "é" * 300]
    best, chance = net.predict(pa.array(texts))
    for k, text in enumerate(texts):
        raw, sums = text.encode(), []
        starts = range(0, max(1, len(raw) - max(langid.WIDTHS) + 1), langid.STRIDE)
        for at in starts:
            window = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            vectors = [net.embedding[c] for c in window]
            hidden = []
            for f in range(net.filters.shape[1]):
                width = langid.WIDTHS[f // langid.FILTERS]
                kernel = net.filters[: width * langid.DEPTH, f].reshape(width, langid.DEPTH)
                outs = [sum(float(vectors[p + i] @ kernel[i]) for i in range(width)) for p in range(langid.WINDOW - max(langid.WIDTHS) + 1)]
                hidden.append(max(0.0, max(outs) + net.bias[f]))
            sums.append(np.array(hidden) @ net.dense + net.offset)
        mean = np.mean(sums, 0)
        soft = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert best[k] == soft.argmax() and abs(chance[k] - soft.max()) < 1e-4


def test_windows_cover_the_whole_text():
    data, offsets = byte_view(pa.array(["a" * 1000, "", "b"]))
    windows, rows = langid.windows_of(data, offsets)
    assert rows.tolist() == [0, 0, 0, 0, 1, 2] and [(w != 0).sum() for w in windows] == [256, 256, 256, 241, 0, 1]


def test_language_on_held_out_rows(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    net = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), net).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n


def test_language_edges(spark, edge, none):
    net = langid.fit(spark.createDataFrame([(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de") for i in range(80)], "doc_id long, text string, lang string"))
    rows = {r["doc_id"]: r for r in langid.predict(edge, net).collect()}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == rows[12]["lang_pred"] == "und" and rows[4]["score"] == 0
    assert rows[8]["lang_pred"] in ("en", "de") and langid.predict(edge, net).count() == 13
    assert langid.predict(none, net).count() == 0 and langid.fit(none) is None
    assert {r["lang_pred"] for r in langid.predict(edge, None).collect()} == {"und"}


def brute_ngrams(text):
    import re

    return re.findall(r"[a-z0-9\u0080-￿]+|[^\sa-z0-9\u0080-￿]+", text.lower())


def test_ngrams():
    for text in ("a b, c!", "", "été%%% x", "one"):
        tokens = brute_ngrams(text)
        rows, buckets = resample.ngrams(pa.array([text.lower()]))
        assert len(buckets) == len(tokens) + max(0, len(tokens) - 1)
    a, b = (np.sort(resample.ngrams(pa.array([t]))[1]) for t in ("x y", "  x  y "))
    assert (a == b).all()


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_exact_selection(spark, fraction):
    docs = spark.createDataFrame([(i, "good text here" if i % 3 else "bad %% text") for i in range(101)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(101)], "doc_id long, quality int")
    rows = resample.resample(docs, resample.fit(docs, labels), fraction).collect()
    best = {r["doc_id"] for r in sorted(rows, key=lambda r: -r["score"])[: int(fraction * 101)]}
    assert {r["doc_id"] for r in rows if r["selected"]} == best and len(rows) == 101


def test_weights_equal_two_brute_models(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["good", "bad", "%%", "text", "été", "n1"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int")
    counts = {"target": np.zeros(resample.BUCKETS), "raw": np.zeros(resample.BUCKETS)}
    grams = [resample.ngrams(pa.array([t]))[1] for t in texts]
    for i, found in enumerate(grams):
        for name in ("target", "raw") if i % 4 == 0 else ("raw",):
            for b in found:
                counts[name][b] += 1
    share = {k: (n + 1) / (n.sum() + resample.BUCKETS) for k, n in counts.items()}
    model = resample.fit(docs, labels)
    for scale in (None, 100.0):
        for r in resample.weigh(docs, model, scale=scale).collect():
            found = grams[r["doc_id"]]
            if not len(found):
                assert r["log_weight"] is None
                continue
            total = sum(np.log(share["target"][b]) - np.log(share["raw"][b]) for b in found)
            assert abs(r["log_weight"] - (total if scale is None else scale * total / len(found))) < 1e-6


def test_empty_texts_are_selected_last(spark):
    docs = spark.createDataFrame([(i, "bad %% text" if i < 60 else None if i < 90 else "") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, quality int")
    rows = resample.resample(docs, resample.fit(docs, labels), 0.6).collect()
    chosen = [r for r in rows if r["selected"]]
    assert len(chosen) == 72 and sum(r["doc_id"] < 60 for r in chosen) == 60


def test_repeated_rows_and_string_ids_are_selected_exactly(spark):
    rows = [("a", "some text")] * 40 + [(None, "some text")] * 41 + [(f"k{i}", "other words") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    model = resample.Model(np.zeros(resample.BUCKETS))
    for fraction in (0.1, 0.37, 0.5, 0.83):
        found = resample.resample(docs, model, fraction).collect()
        assert len(found) == 101 and sum(r["selected"] for r in found) == int(fraction * 101)


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.randint(-(10**15), 10**15), 7, 8]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 100, 250, 500):
        value = sorted(values, reverse=True)[k - 1]
        assert resample.kth_largest(rows, "k", k) == (value, sum(v > value for v in values))


def test_resample_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    model = resample.fit(edge, labels)
    rows = resample.resample(edge, model).collect()
    assert len(rows) == 13 and sum(r["selected"] for r in rows) == 6
    assert {r["log_weight"] for r in rows if r["doc_id"] in (4, 5, 6)} == {None}
    assert resample.resample(none, model).count() == 0
    assert not resample.fit(edge, labels.limit(0)).ratios.any()
