import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispan.functions import text


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return rows.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("given_text, expected", [("Åbaye", "abaye"), ("cœur", "coeur"), ("Œuf", "œuf"), ("ÇA", "ca"), (None, ""), ("é", "e")])
def test_fold(spark, given_text, expected):
    assert one(spark, text.fold("s"), s=given_text) == expected


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20))
def test_fold_drops_marks_of_any_latin_text(spark, s):
    bare = "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)
    # Java and Python agree on lower case here but for the dotted capital I
    assert one(spark, text.fold("s"), s=s) == bare.replace("œ", "oe").replace("æ", "ae").lower()


def test_decomposed_order_keeps_accents_next_to_their_letters(spark):
    rows = spark.createDataFrame([(w,) for w in ("f", "é", "ez")], "w string")
    assert [r["w"] for r in rows.orderBy(text.decomposed("w")).collect()] == ["ez", "é", "f"]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.sampled_from("ae\u0301\u0323\u0302o\u031bé\u1ec7\u212b\u1112\u1161\u11ab\u05ae\u0315 \U0001d15e\u0958"), max_size=12))
def test_normal_forms_of_any_text(spark, s):
    assert one(spark, text.composed("s"), s=s) == unicodedata.normalize("NFC", s)
    assert one(spark, text.decomposed("s"), s=s) == unicodedata.normalize("NFD", s)


def test_clean(spark):
    assert one(spark, text.clean("s"), s="ﬁn de dic-\ntionnaire  x \n\n\n\n y") == "fin de dictionnaire x\n\ny"
    assert one(spark, text.clean("s"), s="A-\nB Œuf a-\nb\r\n\x1f x\u00a0\u2028y e\u0301") == "A-\nB OEuf ab\nx\ny é"
    assert one(spark, text.clean("s"), s=None) == one(spark, text.normalized("s"), s=None) == ""
    assert one(spark, text.normalized("s"), s=" a\tb\x07c  d ﬀ A-\nb œ o\u031b ") == " abc d ff Ab œ ơ "
    assert one(spark, text.reply_letters("s"), s=" l'Åbe-1 x!") == "l'Åbe-x"
    assert one(spark, text.strip("s"), s="  a b \n") == "a b"


def test_tokens_and_keys(spark):
    assert one(spark, text.first_token("s"), s="1. Adje, x") == "adje"
    assert one(spark, text.ring_key("s"), s="Ådjâ") == "adjâ"
    assert one(spark, text.ring_key("s", wide=True), s="Ådjâ") == "adja"


@pytest.mark.parametrize(
    "href, expected",
    [("http://x.be/a.pdf", "https://x.be/a.pdf"), ("/b/c.pdf?x=1", "https://h.org/b/c.pdf?x=1"), (" d.pdf ", "https://h.org/p/d.pdf")],
)
def test_urls(spark, href, expected):
    assert one(spark, text.absolute_url(F.lit("http://h.org/p/q?z=/1"), "s"), s=href) == expected
    assert one(spark, text.file_name("s"), s=expected) == expected.split("?")[0].rsplit("/", 1)[1]
