"""Flat entries: filling, cleaning, acceptance of lines, and guards of rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, composed, strip

#: A headword and a definition on one line, and what a definition must hold.
ENTRY_LINE = r"^([A-Za-zÀ-ÿœæåÅ][A-Za-zÀ-ÿœæåÅ'\- ]{1,60}?)\s*[;:]\s*(.+)$"
HAS_LETTER = r"[a-zA-Záàâéèêëîïôùûüœæç]"
MARKUP = r"[{}\[\]|#*]"


def filled_from_name(rows: DataFrame, name: str, tome: str = "tome", page: str = "page") -> DataFrame:
    """Tome and page from a file name, only where they are zero or null."""
    in_name = lambda p: F.regexp_extract(name, p, 1).try_cast("int")
    fill = lambda c, p: F.coalesce(F.nullif(F.col(c), F.lit(0)), in_name(p), F.lit(0))
    return rows.withColumns({tome: fill(tome, r"tome(\d+)"), page: fill(page, r"[_-](\d+)(?:\.pdf|$)")})


def cleaned(rows: DataFrame) -> DataFrame:
    """Words and definitions stripped, composed, without any control character (line ends and tabs, too), with single blanks; defaults for what is missing."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(composed(strip(F.coalesce(F.col(c), F.lit("")))), r"[\x00-\x1F\x7F]", ""), r"(?U)\s+", " ")
    return rows.withColumns({"word": bare("word"), "definition": bare("definition"), "type": F.coalesce("type", F.lit("wallon-francais")), "tome": F.coalesce("tome", F.lit(0)), "slice": F.coalesce("slice", F.lit(""))})


def accepted(rows: DataFrame, line: str) -> DataFrame:
    """Lines of the reverse direction that read as a headword (2 to 60 letters) and a definition with a letter."""
    part = lambda i: strip(F.regexp_extract(strip(F.col(line)), ENTRY_LINE, i))
    out = rows.withColumns({"word": F.rtrim(part(1), F.lit(".,;:- ")), "definition": part(2)})
    return out.where(F.length("word").between(2, 60) & (F.length("definition") >= 2) & F.col("definition").rlike(HAS_LETTER))


def reference_word(word, letter: str) -> Column:
    return (F.length(col(word)) >= 2) & F.contains(col(word), F.lit(letter)) & ~col(word).rlike(MARKUP)


def guarded(rules: DataFrame, least: int, short: list[str]) -> DataFrame:
    """Rules whose key is long enough or listed."""
    return rules.where((F.length("key") >= least) | F.col("key").isin(short))
