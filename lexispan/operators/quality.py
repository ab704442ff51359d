"""Quality counters, character inventories and heuristics that mark rows for review."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: Limits of the quality counters.
WORD_LIMIT, SHORT, LONG = 60, 10, 2000
#: Letters that an å may have been misread as, and prefixes that are right as they stand.
A_LETTERS, A_EXEMPT = "aàâäå�", ("av", "au", "af")
NON_ASCII = r"[^\x00-\x7F]"


def quality(rows: DataFrame, word: str, definition: str, review: Column, corrected: Column, limit: int = WORD_LIMIT, short: int = SHORT, long: int = LONG) -> DataFrame:
    """One row of counters, and the share of rows without a fault in percent.

    Rows without a word are counted, and left out of the other counts; a definition is
    empty, too short or too long, the first that holds.
    """
    w, d = F.trim(F.coalesce(col(word), F.lit(""))), F.trim(F.coalesce(col(definition), F.lit("")))
    has = w != ""
    counts = {
        "total": F.count("*"),
        "needs_review": F.count_if(review),
        "corrected": F.count_if(corrected),
        "word_empty": F.count_if(~has),
        "word_too_long": F.count_if(has & (F.length(w) > limit)),
        "def_empty": F.count_if(has & (d == "")),
        "def_too_short": F.count_if(has & (d != "") & (F.length(d) < short)),
        "def_too_long": F.count_if(has & (F.length(d) > long)),
    }
    out = rows.agg(*[c.alias(k) for k, c in counts.items()])
    bad = F.col("word_empty") + F.col("word_too_long") + F.col("def_empty") + F.col("def_too_long")
    return out.withColumn("quality_pct", F.when(F.col("total") > 0, F.round((1 - bad / F.col("total")) * 100, 1)))


def initial(word) -> Column:
    """The first letter in lower case, with å as a."""
    return F.translate(F.lower(F.left(col(word), F.lit(1))), "å", "a")


def characters_present(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(ch, count): in how many fields of how many rows each non-ASCII character occurs, once a field."""
    sets = F.flatten(F.array(*[F.array_distinct(F.split(F.coalesce(F.col(f), F.lit("")), "")) for f in fields]))
    return rows.select(F.explode(sets).alias("ch")).where(F.col("ch").rlike(NON_ASCII)).groupBy("ch").agg(F.count("*").alias("count"))


def character_samples(rows: DataFrame, field: str, seq: str, most: int = 5) -> DataFrame:
    """(ch, samples): the first few values, in row order, that hold each non-ASCII character."""
    found = rows.select(seq, field, F.explode(F.array_distinct(F.split(F.coalesce(F.col(field), F.lit("")), ""))).alias("ch")).where(F.col("ch").rlike(NON_ASCII))
    # a rank limit: each task passes on `most` rows a character
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("ch").orderBy(seq))).where(F.col("n") <= most)
    some = F.array_sort(F.collect_list(F.struct(seq, field)))
    return first.groupBy("ch").agg(F.transform(some, lambda s: s[field]).alias("samples"))


def character_counts(rows: DataFrame, field) -> DataFrame:
    """(ch, count): all occurrences of each non-ASCII character."""
    return rows.select(F.explode(F.split(F.regexp_replace(F.coalesce(col(field), F.lit("")), r"[\x00-\x7F]+", ""), "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count("*").alias("count"))


def code_point(ch) -> Column:
    return F.format_string("U+%04X", F.ascii(col(ch)))


def with_names(characters: DataFrame) -> DataFrame:
    """Characters (ch) with their code points and Unicode names; one without a name gets its code point.

    There are at most as many rows as characters, so the names are looked up on distinct values alone.
    """

    @F.pandas_udf("string")
    def name(found: pd.Series) -> pd.Series:
        return found.map(lambda c: unicodedata.name(c, f"U+{ord(c):04X}"), na_action="ignore")

    return characters.withColumns({"code_point": code_point("ch"), "name": name("ch")})


def ordered_text(rows: DataFrame, keys: list[str], seq: str, text: str, into: str) -> DataFrame:
    """The texts of each key joined by spaces in row order."""
    lines = F.array_sort(F.collect_list(F.struct(seq, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x[text]), " ").alias(into))


def a_variant(word) -> Column:
    """Starts with a letter that may stand for å, and none of the exempt prefixes."""
    w = F.lower(col(word))
    exempt = F.lit(False)
    for p in A_EXEMPT:
        exempt = exempt | w.startswith(p)
    return F.contains(F.lit(A_LETTERS), F.left(w, F.lit(1))) & (w != "") & ~exempt


def suspect(token) -> Column:
    """A first token of 4 to 20 letters that starts like a misread å and has none."""
    return a_variant(token) & F.length(col(token)).between(4, 20) & ~F.contains(F.lower(col(token)), F.lit("å"))


def review_after_correction(word, corrected) -> Column:
    """Not corrected, 4 to 25 letters, a misread å before a consonant."""
    return ~col(corrected) & a_variant(word) & F.length(col(word)).between(4, 25) & F.lower(col(word)).rlike(rf"^[{A_LETTERS}][bcdfghjklmnpqrstvwxyz]")
