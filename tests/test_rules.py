import random
import re

import pytest
from pyspark.sql import functions as F

from lexispan.operators import dedup, rules


def rewritten(spark, text, table, **options):
    return spark.createDataFrame([(text,)], "t string").select(rules.rewrite("t", table, **options)).first()[0]


def test_rewrite(spark):
    assert rewritten(spark, "l'adje", [("adje", "ådje")]) == "l'ådje"
    assert rewritten(spark, "l'adje", [("adje", "ådje")], boundary=rules.STRICT) == "l'adje"
    assert rewritten(spark, "ADJE adjer", [("adje", "ådje")]) == "ådje adjer"
    assert rewritten(spark, "âdje", [("adje", "ådje")], vowels=rules.VOWELS) == "ådje"
    assert rewritten(spark, "abc", [("abc", "x$1")]) == "x$1"


def test_rewrite_cascades_longest_first(spark):
    assert rewritten(spark, "one", [("two", "end"), ("one", "two")]) == "two"
    assert rewritten(spark, "three", [("two", "end"), ("three", "two")]) == "end"
    many = [(f"k{i:03d}", f"v{i:03d}") for i in range(250)]
    assert rewritten(spark, "k007 k249", many) == "v007 v249"


def test_vowel_classes(spark):
    """Neither umlaut stands for a plain o or u, damaged letters only stand for an a in the first class, and rules that keep their key are left out."""
    for table in (rules.VOWELS, rules.TYPED_VOWELS):
        assert rewritten(spark, "sön sün sôn", [("son", "sån")], vowels=table) == "sön sün sån"
    assert rewritten(spark, "\ufffddje ädje", [("adje", "ådje")], boundary=rules.STRICT, vowels=rules.VOWELS) == "ådje ådje"
    assert rewritten(spark, "\ufffddje ädje âdje", [("adje", "ådje")], boundary=rules.TYPED_STRICT, vowels=rules.TYPED_VOWELS) == "\ufffddje ädje ådje"
    assert rewritten(spark, "ADJE", [("adje", "adje")], vowels=rules.VOWELS) == "ADJE"


def test_contained_rules_of_any_length(spark):
    table = spark.createDataFrame([(0, "rin", "rîn"), (1, "oldie", "ôldie"), (2, "old", "ôld"), (3, "å", "x"), (4, "go", "gô")], "ord int, key string, val string")
    words = ["a goldie", "a goldie", "Oldie", "GRIND", "none", None, "", "ago Ago", "oldold"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "n int, word string")
    found = {r["n"]: (r["key"], r["fixed"]) for r in rules.rewrite_contained(rows, table, "word").collect()}
    assert found == {0: ("oldie", "a gôldie"), 1: ("oldie", "a gôldie"), 2: (None, "Oldie"), 3: ("rin", "GrînD"), 4: (None, "none"), 5: (None, None), 6: (None, ""), 7: ("go", "agô Ago"), 8: (None, "oldold")}


def test_typed_rewrite(spark):
    rows = spark.createDataFrame([("adje", "x adje", "wallon-francais"), ("adje", "y", "francais-wallon"), ("adje", "âdje", "francais-wallon")], "word string, definition string, type string")
    found = [tuple(r) for r in rules.rewrite_typed(rows, [("adje", "ådje")]).collect()]
    assert found == [("ådje", "x ådje", "wallon-francais", True), ("adje", "y", "francais-wallon", False), ("adje", "ådje", "francais-wallon", True)]


def test_first_token_rule(spark):
    table = spark.createDataFrame([("adje", "ådje")], "key string, val string")
    rows = spark.createDataFrame([("1. Adje, f.",), ("badje",), (None,)], "word string")
    assert [(r["word"], r["matched"]) for r in rules.fix_first_token(rows, table, "word").collect()] == [("1. ådje, f.", True), ("badje", False), (None, False)]


def test_band_pairs(spark):
    left = spark.createDataFrame([(1, 0.9), (1, 5.0)], "k int, x double")
    right = spark.createDataFrame([(1, 1.1), (1, 3.0), (2, 5.0)], "k int, x double")
    assert [(r["x"], r["other_x"]) for r in rules.band_pairs(left, right, ["k"], "x", 0.5).collect()] == [(0.9, 1.1)]


def test_dedup(spark):
    rows = spark.createDataFrame([("k", "bb", 1), ("k", "cc", 2), ("k", "d", 3), ("j", "x", 4)], "key string, d string, seq int")
    assert {(r["key"], r["d"]) for r in dedup.keep_longest(rows, ["key"], "d", "seq").collect()} == {("k", "bb"), ("j", "x")}
    assert {(r["key"], r["d"]) for r in dedup.keep_first(rows, ["key"], -F.col("seq")).collect()} == {("k", "d"), ("j", "x")}
    once = dedup.keep_longest(rows, ["key"], "d", "seq")
    assert sorted(map(tuple, dedup.keep_longest(once, ["key"], "d", "seq").collect())) == sorted(map(tuple, once.collect()))
    assert dedup.keep_longest(rows.limit(0), ["key"], "d", "seq").count() == 0


def test_shortest(spark):
    rows = spark.createDataFrame([("å1", 1), ("a1x", 2), ("a1", 3)], "w string, seq int")
    out = dedup.shortest_by_key(rows, F.left(F.translate("w", "å", "a"), F.lit(2)), "w", "seq").collect()
    assert [tuple(r) for r in out] == [("a1", "å1")]


def compiled(table, boundary, vowels):
    ordered = sorted((r for r in table if not vowels or r[0] != r[1].lower()), key=lambda r: -len(r[0]))
    return [(re.compile(rules.rule_pattern(k, boundary, vowels), re.IGNORECASE), v) for k, v in ordered]


def plain(text, patterns):
    """Every rule's pattern over the whole text, one after the other."""
    for p, v in patterns:
        text = p.sub(lambda m: v, text)  # noqa: B023
    return text


@pytest.mark.parametrize("boundary, vowels", [(rules.LETTERS, None), (rules.STRICT, rules.VOWELS), (rules.TYPED_STRICT, rules.TYPED_VOWELS)])
def test_automaton_equals_rule_by_rule(boundary, vowels):
    """2,000 rules with cascades, overlapping keys, damaged letters and keys of several words."""
    rng = random.Random(len(boundary))
    piece = lambda: "".join(rng.choice("aeioubdàâåêfg") for _ in range(rng.randint(1, 3)))
    keys = list({piece() + rng.choice(["", "", " ", "'", "-"]) + piece() for _ in range(2600)})[:2000]
    table = [(k, rng.choice([rng.choice(keys), piece(), k.replace("a", "å"), k + " " + piece()])) for k in keys]
    rewriter, patterns = rules.Rewriter(table, boundary, vowels), compiled(table, boundary, vowels)
    changed = 0
    for _ in range(100):
        words = [rng.choice([rng.choice(keys), piece() + piece(), rng.choice(keys).upper(), rng.choice(keys).replace("a", "�"), rng.choice(keys).replace("e", "ë")]) for _ in range(12)]
        text = rng.choice([" ", "  ", "'", ", "]).join(words)
        expected = plain(text, patterns)
        assert rewriter(text) == expected
        changed += text != expected
    assert changed > 70


def test_automaton_finds_letters_that_match_in_another_case():
    for key, text in (("ski", "ſki"), ("kilo", "Kilo"), ("is", "ıs"), ("åne", "ÅNE")):
        assert rules.Rewriter([(key, "x")], rules.LETTERS, None)(text) == plain(text, compiled([(key, "x")], rules.LETTERS, None))


def test_token_forms(spark):
    table = spark.createDataFrame([("adje", "ådje"), ("of", "òf")], "key string, val string")
    words = ["adje. x", "12. Adje/x", "«adje»", "of x", " ADJE x ", "adjex", "", None, "1. "]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "n int, word string")

    def found(form):
        return [r["word"] for r in rules.fix_first_token(rows, table, "word", form).orderBy("n").collect()]

    assert found(rules.RULE_FORM) == ["ådje. x", "12. ådje/x", "«adje»", "of x", "ådje x", "adjex", "", None, "1. "]
    assert found(rules.LAST_FORM) == found(rules.RULE_FORM)
    assert found(rules.FIRST_FORM) == ["ådje. x", "12. Adje/x", "«adje»", "òf x", " ADJE x ", "adjex", "", None, "1. "]


def test_first_or_contained(spark):
    table = spark.createDataFrame([(0, "adje", "ådje"), (1, "old", "ôld")], "ord int, key string, val string")
    rows = spark.createDataFrame([(1, "adje gold"), (2, "gold"), (3, "ADJE gold"), (4, "none"), (5, None), (2, "gold")], "n int, word string")
    out = sorted((r["n"], r["original"], r["word"], r["source"], r["rule"]) for r in rules.fix_first_or_contained(rows, table, "word").collect())
    assert out == [(1, "adje gold", "ådje gold", "first token", None), (2, "gold", "gôld", "inside", "old"), (2, "gold", "gôld", "inside", "old"), (3, "ADJE gold", "ADJE gôld", "inside", "old"), (4, "none", "none", None, None), (5, None, None, None, None)]
