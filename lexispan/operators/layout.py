"""Reconstruction of columns and lines from positioned spans of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: Vertical tolerance of a line, the central band, the least gap, and the default split.
LINE_TOLERANCE, BAND, LEAST_GAP, DEFAULT_SPLIT = 3.5, (0.35, 0.65), 5.0, 300.0
#: Top and bottom of the text area, left margins of empty columns, and the gap that stands for a space.
TOP, BOTTOM, MARGINS, SPACE_GAP = 158.0, 820.0, (133.0, 305.0), 2.0


def anchored_groups(items: Column, value: str, tolerance: float) -> Column:
    """Of a sorted array of structs the number of each one's group, from 0.

    A group's first value is its anchor: the next group begins where a value is further
    from it than the tolerance. Chains of small steps do not drag a group along.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = s["anchor"].isNull() | (F.abs(x[value] - s["anchor"]) > tolerance)
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.when(new, x[value].cast("double")).otherwise(s["anchor"]).alias("anchor"), n.alias("n"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def lines(spans: DataFrame, keys: list[str], y: str, x: str, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Spans with the number of their line (from 0) and their place in it; keys name a column of a page, which bounds a group."""
    others = [c for c in spans.columns if c not in (*keys, y, x)]
    # no anchor reaches over a gap wider than the tolerance, so each stretch between such gaps is folded alone
    down = Window.partitionBy(*keys).orderBy(y)
    gap = F.coalesce((F.col(y) - F.lag(y).over(down) > tolerance).cast("int"), F.lit(0))
    cut = spans.withColumn("__gap", gap).withColumn("__stretch", F.sum("__gap").over(down.rangeBetween(Window.unboundedPreceding, 0)))
    gathered = cut.groupBy(*keys, "__stretch").agg(F.array_sort(F.collect_list(F.struct(y, x, *others))).alias("__spans"))
    folded = gathered.withColumn("__line", anchored_groups(F.col("__spans"), y, tolerance))
    # a stretch's first number is the count of the lines of those before it
    before = F.sum(F.element_at("__line", -1) + 1).over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    numbered = folded.withColumn("__before", F.coalesce(before, F.lit(0)))
    flat = numbered.select(*keys, "__before", F.explode(F.arrays_zip("__spans", "__line")).alias("__z"))
    line = (F.col("__before") + F.col("__z.__line")).cast("int")
    flat = flat.select(*keys, *[F.col(f"__z.__spans.{c}").alias(c) for c in (y, x, *others)], line.alias("line_no"))
    return flat.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "line_no").orderBy(x, y, *others)) - 1)


def column_split(spans: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, split): the middle of the largest gap between neighbouring centres in the central band; of equal gaps the first.

    Too few centres in the band, or no gap of the least size, give the middle of the range.
    """
    ends = spans.groupBy(*keys).agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    near = spans.select(*keys, x).join(ends, keys)
    width = F.col("__high") - F.col("__low")
    inside = (F.col(x) >= F.col("__low") + width * BAND[0]) & (F.col(x) <= F.col("__low") + width * BAND[1])
    marked = near.withColumn("__x", F.when(inside, F.col(x)))
    after = F.lead("__x").over(Window.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_last()))
    gaps = marked.withColumn("__gap", after - F.col("__x"))
    best = F.max_by(F.struct("__x", "__gap"), F.struct("__gap", -F.col("__x")))
    out = gaps.groupBy(*keys).agg(best.alias("__best"), F.count("__x").alias("__n"), F.first("__low").alias("__low"), F.first("__high").alias("__high"))
    middle = (F.col("__low") + F.col("__high")) / 2
    good = (F.col("__n") >= 2) & (F.col("__best.__gap") >= LEAST_GAP)
    split = F.when(good, F.col("__best.__x") + F.col("__best.__gap") / 2).otherwise(middle)
    return out.select(*keys, F.coalesce(split, F.lit(DEFAULT_SPLIT)).alias("split"))


def routed(spans: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Spans with `side`: left of the split of their page, or right."""
    return spans.join(column_split(spans, keys, x), keys).withColumn("side", F.when(F.col(x) < F.col("split"), "left").otherwise("right"))


def in_text_area(y, text) -> Column:
    """Neither above nor below the text, nor a page number alone; y is that of the line's leftmost span."""
    return col(y).between(TOP, BOTTOM) & ~F.trim(col(text)).rlike(r"^\d{1,4}$")


def left_margin(rows: DataFrame, keys: list[str], side: str, x0: str) -> DataFrame:
    """(keys, side, margin): the least x0 of a column, or the default of its side."""
    return rows.groupBy(*keys, side).agg(F.coalesce(F.min(x0), F.when(F.first(side) == "left", MARGINS[0]).otherwise(MARGINS[1])).alias("margin"))


def rich_line(spans) -> Column:
    """A line's spans with their texts and styles alone."""
    return F.transform(col(spans), lambda s: F.struct(s["text"].alias("text"), s["bold"].alias("bold"), s["italic"].alias("italic")))


def line_text(spans) -> Column:
    """Texts of a line's spans, with a space where the gap to the span before is over the limit."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x1"))
    gap = lambda s, x: F.when(s["x1"].isNotNull() & x["x0"].isNotNull() & (x["x0"] - s["x1"] > SPACE_GAP), " ").otherwise("")
    return F.trim(F.aggregate(col(spans), start, lambda s, x: F.struct(F.concat(s["text"], gap(s, x), x["text"]).alias("text"), x["x1"].cast("double").alias("x1")), lambda s: s["text"]))


def styled(flags, font) -> tuple[Column, Column]:
    """Bold and italic, by flag bits or the font's name."""
    name = F.lower(col(font))
    return ((col(flags).bitwiseAND(16)) != 0) | F.contains(name, F.lit("bold")), ((col(flags).bitwiseAND(2)) != 0) | F.contains(name, F.lit("italic"))
