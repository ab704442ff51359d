"""Predicates that tell lines and entries from noise, and the cleaning of parsed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, col, strip, strip_all

#: Patterns of lines that are no text of an entry (in any case), for the two line parsers.
NOISE_LINE = (
    rf"^\p{{Nd}}+[{SPACES}]*$",
    rf"^[IVXivx]+[{SPACES}]*$",
    r"^={3,}",
    r"^-{3,}",
    r"^\*{3,}",
    rf"^table[{SPACES}]+des",
    rf"^index[{SPACES}]+",
    r"^bibliographie",
    rf"^corrections[{SPACES}]+",
    r"^avant-propos",
    r"^introduction",
    r"^abreviations?",
    rf"^tome[{SPACES}]+\p{{Nd}}",
)
NOISE_LINE_LATER = (
    rf"^\p{{Nd}}+[{SPACES}]*$",
    rf"^[IVXivx]+[{SPACES}]*$",
    r"^={2,}",
    r"^-{3,}",
    r"^\*{3,}",
    rf"^table[{SPACES}]+des",
    rf"^index[{SPACES}]+",
    r"^bibliographie",
    r"^avant-propos",
    r"^introduction",
    r"^abr.viations?",
    rf"^corrections?[{SPACES}]",
    rf"^additions?[{SPACES}]",
    rf"^tome[{SPACES}]+\p{{Nd}}",
    rf"^vol\.?[{SPACES}]+\p{{Nd}}",
)
DIGITS_AND_MARKS = rf"^[\p{{Nd}}{SPACES}.,;:!?()/-]+$"
DIGITS_AND_MARKS_LATER = rf"^[\p{{Nd}}{SPACES}.,;:!?()/\[\]-]+$"
#: Headwords that are noise; read in any case, so any word of one to three letters is.
NOISE_WORD = (r"^\d+$", r"^[.\-_=+*#]{3,}$", r"^(page|tome|vol\.|fig\.)", r"^\s*$", r"^[A-Z]{1,3}$")
#: The same for the quick filter, where the first three heed case.
QUICK_EXACT = (r"^\d+$", r"^[IVXivx]{1,5}$", r"^[=\-*.]{3,}$")
QUICK_ANY_CASE = (r"^(table|index|bibliographie|avant-propos|introduction|corrections?|additions?)", r"^(tome|vol\.?|fig\.?)\s+\d")
#: Accents of the dictionary's language, and marks that no headword begins with.
LOCAL_ACCENT, BAD_START = r"[âôûîèêëœæ]", r"^[(\[\-—*#\d]"


def _any(x: Column, patterns, flags: str = "") -> Column:
    """Whether one of the patterns fits, as one alternation."""
    return x.rlike(f"{flags}(?:{'|'.join(patterns)})")


def _same(word: Column, text: Column) -> Column:
    """Equality in any case; lower-casing never shortens a text, so a longer one is told by its length alone."""
    return (F.length(text) <= F.length(F.lower(word))) & (F.lower(word) == F.lower(text))


def noise_line(line, later: bool = False) -> Column:
    """Whether a line is no text of an entry; `later` takes the patterns of the second line parser."""
    x = strip_all(F.coalesce(col(line), F.lit("")))
    patterns, marks = (NOISE_LINE_LATER, DIGITS_AND_MARKS_LATER) if later else (NOISE_LINE, DIGITS_AND_MARKS)
    return (F.length(x) < 2) | _any(x, patterns, "(?iu)") | x.rlike(marks)


def noise_entry(word, definition) -> Column:
    w, d = (strip(F.coalesce(col(c), F.lit(""))) for c in (word, definition))
    return (w == "") | (F.length(d) < 3) | _any(w, NOISE_WORD, "(?i)") | _same(w, d)


def quick_keep(word, definition) -> Column:
    w, d = (strip(F.coalesce(col(c), F.lit(""))) for c in (word, definition))
    return F.length(w).between(2, 100) & (F.length(d) >= 3) & ~_same(w, d) & ~_any(w, QUICK_EXACT) & ~_any(w, QUICK_ANY_CASE, "(?i)")


def post_clean(rows: DataFrame, word: str = "word", definition: str = "definition", kind: str = "type") -> DataFrame:
    """Entries with cleaned words and definitions, without those that are rejected.

    £ becomes e. In the reverse direction a last token with local accents is moved from
    the headword to the front of the definition. Marks in front of a definition go.
    """
    rows = rows.withColumns({word: strip(F.coalesce(F.col(word), F.lit(""))), definition: strip(F.coalesce(F.col(definition), F.lit("")))})
    rows = rows.where(~F.col(word).rlike(BAD_START) & F.length(word).between(2, 80))
    rows = rows.withColumns({c: F.translate(c, "£", "e") for c in (word, definition)})
    tokens = F.split(F.col(word), r"\s+")
    rest = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    moved = (F.col(kind) == "francais-wallon") & (F.size(tokens) >= 2) & F.element_at(tokens, -1).rlike(LOCAL_ACCENT) & (F.length(rest) >= 2)
    longer = F.rtrim(F.concat_ws(" ", F.element_at(tokens, -1), F.col(definition)))
    rows = rows.withColumn("__moved", moved).withColumns({definition: F.when(F.col("__moved"), longer).otherwise(F.col(definition)), word: F.when(F.col("__moved"), rest).otherwise(F.col(word))}).drop("__moved")
    rows = rows.withColumn(definition, strip(F.regexp_replace(definition, r"^[—\-.;,\s]+", "")))
    return rows.where(F.length(definition) >= 3)
