"""Every registered query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import cleaning, extras, linking, parsing, profiling, reading, searching, sessions  # noqa: F401
from .registration import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
