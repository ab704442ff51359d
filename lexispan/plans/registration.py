"""Where query modules put their queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_pattern(pattern: str) -> str:
    """A pattern as a part of DuckDB's SQL text: its way to write code points, and doubled quotes."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


def sql_clean(x: str) -> str:
    """DuckDB's form of `functions.text.clean`."""
    x = f"nfc_normalize({x})"
    for a, b in {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}.items():
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in ((r"-\n([a-záàâéèêëîïôùûüœæç])", "'\\1'"), (r"[ \t]+", "' '"), (r"\r\n|[\n\r\x{0b}\x{0c}\x{85}]", "chr(10)"), (r"[ \t\x{a0}]*\n[ \t\x{a0}]*", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        x = f"regexp_replace({x}, '{a}', {b}, 'g')"
    return x
