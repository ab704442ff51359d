from pyspark.sql import functions as F

from lexispan.operators import layout


def test_lines_are_anchored_not_chained(spark):
    spans = spark.createDataFrame([("p", y, x) for y, x in ((1.0, 2.0), (3.0, 1.0), (5.5, 1.0), (9.0, 0.0))], "page string, y double, x double")
    rows = layout.lines(spans, ["page"], "y", "x").collect()
    assert sorted((r["y"], r["line_no"], r["place"]) for r in rows) == [(1.0, 0, 1), (3.0, 0, 0), (5.5, 1, 1), (9.0, 1, 0)]


def split(spark, xs):
    spans = spark.createDataFrame([("p", float(x)) for x in xs], "page string, x double")
    return layout.column_split(spans, ["page"], "x").first()["split"]


def test_column_split(spark):
    assert split(spark, [100, 180, 190, 230, 310]) == 210
    assert split(spark, [100, 110, 120, 300, 310]) == 205
    assert split(spark, [7]) == 7
    routed = layout.routed(spark.createDataFrame([("p", float(x)) for x in (100, 180, 190, 230, 310)], "page string, x double"), ["page"], "x")
    assert sorted((r["x"], r["side"]) for r in routed.collect()) == [(100, "left"), (180, "left"), (190, "left"), (230, "right"), (310, "right")]


def test_line_text_and_area(spark):
    rows = spark.createDataFrame([([("ab", 0.0, 10.0), ("c", 11.0, 15.0), ("d", 20.0, 25.0)],)], "spans array<struct<text string, x0 double, x1 double>>")
    assert rows.select(layout.line_text("spans")).first()[0] == "abc d"
    lines = spark.createDataFrame([(157.9, "a"), (158.0, "a"), (300.0, " 12 "), (300.0, "12345"), (820.1, "a")], "y double, t string")
    assert [r[0] for r in lines.select(layout.in_text_area("y", "t")).collect()] == [False, True, False, True, False]
    margins = layout.left_margin(spark.createDataFrame([("p", "left", 3.0), ("p", "left", 2.0), ("p", "right", None)], "p string, side string, x0 double"), ["p"], "side", "x0")
    assert {(r["side"], r["margin"]) for r in margins.collect()} == {("left", 2.0), ("right", 305.0)}


def test_styles(spark):
    rows = spark.createDataFrame([(16, "Times"), (2, "Times"), (0, "Times-BoldItalic"), (0, "Times")], "flags int, font string")
    bold, italic = layout.styled("flags", "font")
    assert [tuple(r) for r in rows.select(bold, italic).collect()] == [(True, False), (False, True), (True, True), (False, False)]


def test_empty(spark):
    spans = spark.createDataFrame([], "page string, y double, x double")
    assert layout.lines(spans, ["page"], "y", "x").count() == 0
    assert layout.column_split(spans, ["page"], "x").count() == 0
    assert spans.select(F.col("y")).count() == 0
