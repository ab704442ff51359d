"""The whole way from lines of spans to nested entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsing, rules
from .dedup import keep_first
from .quality import review_after_correction
from .restructure import restructure


def dictionary_order(word: str = "word", seq: tuple[str, ...] = ("column", "segment")) -> list[Column]:
    """Tome, page, headword in lower case by code points; rows that tie stay in the order in which they were read."""
    return [F.col("tome").asc(), F.col("page").asc(), F.lower(word).asc(), *[F.col(c).asc() for c in seq]]


def flat_entries(lines: DataFrame, table: list[tuple[str, str]], order: str = "line_no", spans: str = "spans", margin: str = "margin") -> DataFrame:
    """Entries of lines (slice, tome, page, column, order, spans, margin): parsed, corrected, and once for each headword of a page.

    `table` holds (key, form) rules. Of equal headwords (in any case, without white space at
    their ends) of a tome's page the first in dictionary order stays. Columns never share an entry.
    """
    keys = ["slice", "tome", "page", "column"]
    found = parsing.entries(lines, keys, order, spans, margin, "tome")
    fixed = {c: rules.rewrite(c, table, rules.STRICT, rules.VOWELS) for c in ("word", "definition")}
    both = found.withColumns({f"__{c}": x for c, x in fixed.items()})
    both = both.withColumn("a_ring_corrected", (F.col("__word") != F.col("word")) | (F.col("__definition") != F.col("definition")))
    both = both.withColumns({"word": F.col("__word"), "definition": F.col("__definition")}).drop("__word", "__definition")
    both = both.withColumn("needs_review", F.col("needs_review") | review_after_correction("word", "a_ring_corrected"))
    both = both.withColumn("type", F.when(F.col("tome") == 3, "francais-wallon").otherwise("wallon-francais"))
    named = both.withColumn("__name", F.lower(F.trim("word")))
    first = keep_first(named, ["__name", "tome", "page"], F.lower("word"), F.col("slice"), F.col("column"), F.col("segment"))
    return first.drop("__name")


def nested_entries(flat: DataFrame) -> DataFrame:
    """Nested entries; `dictionary_order("mot")` sorts them."""
    return restructure(flat)
