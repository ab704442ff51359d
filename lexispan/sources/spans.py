"""Styled spans of page layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import styled


def spans_of(pages: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """(keys, block, line, seq, text, bold, italic, size, font, x0, y0, x1, y1, x_center) of nested layouts.

    Only text blocks (type 0) count, blank spans are dropped, and coordinates are rounded to 0.1.
    """
    rows = pages.select(*keys, F.posexplode(blocks).alias("block", "__b")).where("__b.type = 0")
    rows = rows.select(*keys, "block", F.posexplode("__b.lines").alias("line", "__l"))
    rows = rows.select(*keys, "block", "line", F.posexplode("__l.spans").alias("seq", "__s")).where(F.trim("__s.text") != "")
    bold, italic = styled(F.col("__s.flags"), F.col("__s.font"))
    at = lambda i: F.bround(F.get("__s.bbox", i), 1)
    return rows.select(
        *keys, "block", "line", "seq", F.col("__s.text").alias("text"), bold.alias("bold"), italic.alias("italic"), F.bround("__s.size", 1).alias("size"), F.col("__s.font").alias("font"),
        at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"), F.bround((F.get("__s.bbox", 0) + F.get("__s.bbox", 2)) / 2, 1).alias("x_center"),
    )
