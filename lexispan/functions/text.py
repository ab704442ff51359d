"""Text normalisation as column expressions: folding, cleaning, tokens, URLs and tags."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one base letter, those letters, and every decomposition; marks fold to nothing."""
    accented, plain, parts = [], [], {}
    for code in range(0xC0, min(0x2E80, sys.maxunicode)):
        char = chr(code)
        apart = unicodedata.normalize("NFD", char)
        if apart == char:
            continue
        parts[char] = apart
        rest = "".join(c for c in apart if not 0x300 <= ord(c) <= 0x36F)
        if len(rest) == 1 and rest != char:
            accented.append(char)
            plain.append(rest)
    marks = [chr(c) for c in range(0x300, 0x370)]  # longer than `plain`: translate drops them
    return "".join(accented + marks), "".join(plain), parts


ACCENTED, PLAIN, DECOMPOSED = _tables()
#: Characters with the White_Space property.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ligatures of printed text and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
DIGRAPHS = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
#: Small letters before which a hyphen at a line end joins a word.
SMALL_LETTERS = "a-záàâéèêëîïôùûüœæç"
#: What is kept of a reply that is one word.
REPLY_LETTERS = "a-zA-ZåÅàâéèêëîïôùûüçœæ\\-'"
#: What ends a line, white space that doesn't, and control characters that count as white space.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANKS = " \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
CONTROL_BLANKS = "\x1c\x1d\x1e\x1f"
#: White space inside a character class; a pattern's own \\s means ASCII alone.
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a headword's first token: for replies, for exact rules, and for the last pass of exact rules.
REPLY_ENDS, RULE_ENDS, LAST_ENDS = ",;:()\\[\\]", ",;:()\\[\\].!?/", ",;:()\\[\\].!?\\\\/'\"\u00ab\u00bb"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x) -> Column:
    """Accent-insensitive search form: null is empty; small ligatures are spelt out before lower-casing, capital ones aren't."""
    bare = F.translate(F.coalesce(col(x), F.lit("")), ACCENTED, PLAIN)
    return F.lower(F.replace(F.replace(bare, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")))


#: Texts without characters beyond these are in the canonical form already.
UNCHANGED = {"NFC": r"\x00-\x{2FF}", "NFD": r"\x00-\xBF"}


@cache
def _canonical(form: str):
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.pandas_udf(apply, "string")


def _in_form(x, form: str) -> Column:
    """The canonical form; texts that can't change (ASCII by their length, others by one range of characters) never leave the JVM."""
    x = col(x)
    may_change = (F.octet_length(x) > F.length(x)) & x.rlike(f"[^{UNCHANGED[form]}]")
    return F.coalesce(_canonical(form)(F.when(may_change, x)), x)


def decomposed(x) -> Column:
    """Canonical decomposition (NFD): its order puts an accented letter right behind its base letter."""
    return _in_form(x, "NFD")


def composed(x) -> Column:
    """Canonical composition (NFC)."""
    return _in_form(x, "NFC")


def strip(x) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(col(x), F.lit(WHITE))


def strip_all(x) -> Column:
    """Without white space at both ends, control characters that count as such included."""
    return F.btrim(col(x), F.lit(WHITE + CONTROL_BLANKS))


def strip_chars(x, chars: str) -> Column:
    return F.rtrim(F.ltrim(col(x), F.lit(chars)), F.lit(chars))


def collapse(x) -> Column:
    return strip(F.regexp_replace(col(x), r"\s+", " "))


def _without_ligatures(x: Column, ligatures: dict[str, str]) -> Column:
    for a, b in ligatures.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clean(x) -> Column:
    """Composed, ligatures and digraphs spelt out, words joined over line ends before small letters, blanks collapsed, lines stripped, at most one blank line."""
    out = _without_ligatures(composed(F.coalesce(col(x), F.lit(""))), LIGATURES | DIGRAPHS)
    out = F.regexp_replace(out, f"-\n([{SMALL_LETTERS}])", "$1")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, LINE_END, "\n")
    out = F.regexp_replace(out, f"[{BLANKS}]*\n[{BLANKS}]*", "\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(WHITE + CONTROL_BLANKS))


def normalized(x) -> Column:
    """Composed, printed ligatures spelt out, words joined over line ends between letters, no control characters but line ends, blanks collapsed; the ends are kept."""
    out = _without_ligatures(composed(F.coalesce(col(x), F.lit(""))), LIGATURES)
    out = F.regexp_replace(out, f"([A-Z{SMALL_LETTERS}])-\n([{SMALL_LETTERS}])", "$1$2")
    return F.regexp_replace(F.regexp_replace(out, r"[\x00-\x09\x0B-\x1F\x7F]", ""), r"[ \t]+", " ")


def reply_letters(x) -> Column:
    """A reply's letters, hyphens and apostrophes alone."""
    return strip(F.regexp_replace(col(x), f"[^{REPLY_LETTERS}]", ""))


def ring_key(x, wide: bool = False) -> Column:
    """Lower case with å as a; the wide form folds â and à, too."""
    return F.translate(F.lower(col(x)), "åâà" if wide else "å", "aaa" if wide else "a")


def first_token(x, ends: str = REPLY_ENDS, number: bool = True, filled: bool = False) -> Column:
    """Lower-cased text up to the first white space or end mark, without a homograph number in front if `number`; with `filled` the first token that isn't empty."""
    out = strip_all(x)
    if number:
        out = strip_all(F.regexp_replace(out, rf"^\p{{Nd}}+\.[{SPACES}]*", ""))
    if filled:
        out = F.regexp_replace(out, f"^[{SPACES}{ends}]+", "")
    return F.lower(F.get(F.split(out, f"[{SPACES}{ends}]", 2), 0))


def without_tags(x) -> Column:
    return F.regexp_replace(col(x), r"<[^>]+>", "")


def absolute_url(base, href) -> Column:
    """A link against its page: absolute as it is, rooted on the host, others on the page's folder; http becomes https."""
    base, href = col(base), F.trim(col(href))
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    out = F.when(F.lower(href).rlike(r"^https?://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))
    return F.regexp_replace(out, r"^http://", "https://")


def file_name(url) -> Column:
    """The last segment of a path, without query."""
    return F.regexp_extract(col(url), r"([^/?]*)(?:\?.*)?$", 1)
