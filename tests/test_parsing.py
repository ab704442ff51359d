import pytest
from pyspark.sql import functions as F

from lexispan.operators import noise, parsing

SPANS = "array<struct<text string, bold boolean, italic boolean, font string, x0 double, x1 double>>"


def span(text, x0=0.0, bold=False, italic=False, font="Times"):
    return (text, bold, italic, font, x0, x0 + 5.0 * len(text))


def line(spark, *spans):
    return spark.createDataFrame([(list(spans),)], f"spans {SPANS}")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1. abaye, f., abbaye", ("abaye", "f", "abbaye")),
        ("aler, v. intr., aller", ("aler", "v", "intr., aller")),
        ("bâcler : faire vite", ("bâcler", "", "faire vite")),
        ("adawiner, seul dans l'exp. x, m., chose", ("adawiner", "m", ", seul dans l'exp. x : chose")),
        ("mot. suite du texte", ("mot", "", "suite du texte")),
        ("mot suite", ("mot", "", "suite")),
    ],
)
def test_split_forward(spark, text, expected):
    row = line(spark, span(text)).select(parsing.split_entry("spans", F.lit(2)).alias("e")).first()["e"]
    assert tuple(row) == expected


def test_split_by_style(spark):
    row = line(spark, span("2. agne,", italic=True), span("bête", 60.0)).select(parsing.split_entry("spans", F.lit(2)).alias("e")).first()["e"]
    assert tuple(row) == ("agne", "", "bête")
    row = line(spark, span("abbaye,"), span("abeye", 60.0, bold=True), span("f.", 99.0)).select(parsing.split_entry("spans", F.lit(3)).alias("e")).first()["e"]
    assert tuple(row) == ("abbaye", "", "abeye f.")


@pytest.mark.parametrize(
    "spans, tome, expected",
    [
        ([span("abaye", 110.0, italic=True)], 2, True),
        ([span("abaye", 100.0, italic=True)], 2, False),  # not indented
        ([span("Fig. 3", 110.0, italic=True)], 2, False),
        ([span("12", 110.0, italic=True)], 2, False),
        ([span("1. abaye", 110.0, italic=True)], 2, True),
        ([span("— abaye", 110.0, italic=True)], 2, False),
        ([span("abaye m. mot", 110.0)], 2, True),
        ([span("abaye mot", 110.0)], 2, False),
        ([span("abbaye", 110.0), span("abeye", 150.0, bold=True)], 3, True),
        ([span("abbaye", 110.0)], 3, False),
        ([], 2, False),
    ],
)
def test_entry_start(spark, spans, tome, expected):
    assert line(spark, *spans).select(parsing.entry_start("spans", F.lit(100.0), F.lit(tome))).first()[0] is expected


def test_entries_of_a_column(spark):
    rows = [(1, [span("lost", 100.0)]), (2, [span("abaye, f., abbaye", 110.0)]), (3, [span("et suite", 100.0)]), (4, [span("bâcler : bâcler, finir", 110.0)])]
    lines = spark.createDataFrame([("p", n, s, 100.0, 2) for n, s in rows], f"page string, n int, spans {SPANS}, margin double, tome int")
    found = parsing.entries(lines, ["page"], "n", "spans", "margin", "tome").orderBy("segment").collect()
    assert [(r["word"], r["grammar"], r["definition"], r["needs_review"]) for r in found] == [("abaye", "f", "abbaye et suite", False), ("bâcler", "", "finir", False)]


def test_page_at_flush(spark):
    rows = spark.createDataFrame([("f", 1, 3), ("f", 2, 3), ("f", 5, 4)], "file string, n int, page int").withColumn("final", F.lit(9))
    out = parsing.page_at_flush(rows, ["file"], "n", "page", "final", "at").orderBy("n")
    assert [r["at"] for r in out.collect()] == [3, 4, 9]


def test_file_meta(spark):
    rows = spark.createDataFrame([("tome3-07.pdf",), ("tome2-31.txt",), ("x.pdf",)], "f string")
    assert [tuple(r) for r in rows.select(*parsing.file_meta("f")).collect()] == [(3, 7, "francais-wallon"), (2, 31, "wallon-francais"), (0, 0, "wallon-francais")]


@pytest.mark.parametrize("word, definition, expected", [("abc", "xyz", True), ("abcd", "xyz", False), ("abcd", "xy", True), ("abcd", "ABCD", True), ("tome 3", "xyz", True), (None, "xyz", True)])
def test_noise_entry(spark, word, definition, expected):
    rows = spark.createDataFrame([(word, definition)], "w string, d string")
    assert rows.select(noise.noise_entry("w", "d")).first()[0] is expected


def test_post_clean_moves_the_last_token(spark):
    rows = spark.createDataFrame([("agacerie agacerèye", "x y", "francais-wallon"), ("(bad", "x y z", "francais-wallon"), ("m£t", "-. d£f", "wallon-francais"), ("mot", "--", "wallon-francais")], "word string, definition string, type string")
    assert [(r["word"], r["definition"]) for r in noise.post_clean(rows).collect()] == [("agacerie", "agacerèye x y"), ("met", "def")]


def test_very_long_line(spark):
    rows = spark.createDataFrame([("a" * 200_000,), ("a b " * 50_000,)], "t string")
    assert rows.select(noise.noise_line("t").alias("n")).where("n").count() == 0
