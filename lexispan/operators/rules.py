"""Repair of misread letters by rule tables: exact, substring, and ordered rewriting."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LAST_ENDS, REPLY_ENDS, RULE_ENDS, SPACES, col, first_token, strip_all
from .stored import stored

#: Letters that a plain vowel of a rule's key stands for; with damaged letters, and for typed entries.
VOWELS = {"a": "[aàâäå\ufffd]", "e": "[eéèêë]", "i": "[iîï]", "o": "[oô]", "u": "[uûù]"}
TYPED_VOWELS = {"a": "[aàâå]", "e": "[eéèêë]", "i": "[iîï]", "o": "[oô]", "u": "[uûù]"}
#: Letters at which a rule's match may not border; the other two go with the vowels above and hold marks inside words.
LETTERS = "a-zA-Zàâäáéèêëîïíôöóûùüúçœæå"
STRICT = "a-zàâéèêëîïôùûüçœæåÅ'\\-\ufffd"
TYPED_STRICT = "a-zA-ZàâéèêëîïôùûüœæçåÅ\\-'"
#: Most rows of a rule table that is broadcast, and most rows of a band's cell that share a task.
BROADCAST_ROWS, CELL_ROWS = 100_000, 50_000


def small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it has few rows; otherwise the joins shuffle it."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


class TokenForm(NamedTuple):
    """How the leading token is cut, and where it is replaced."""

    ends: str
    number: bool = True  # a homograph number stands in front of it
    filled: bool = False  # empty tokens in front are skipped
    least: int = 3  # shorter tokens are left alone
    anywhere: bool = False  # replaced where it first stands in its lower-case form, not at the front in any case


#: The forms of the passes: replies, exact rules, the last pass, and the pass whose rest goes to contained rules.
REPLY_FORM, RULE_FORM, LAST_FORM = TokenForm(REPLY_ENDS, least=1), TokenForm(RULE_ENDS), TokenForm(LAST_ENDS, filled=True)
FIRST_FORM = TokenForm(RULE_ENDS.replace("/", ""), number=False, least=1, anywhere=True)


def fix_first_token(rows: DataFrame, rules: DataFrame, word: str, form: TokenForm = RULE_FORM) -> DataFrame:
    """The input with the leading token rewritten where it is a rule's key (left join), and `matched`. A word that changes loses white space at its ends."""
    token = rows.withColumn("__token", first_token(word, form.ends, form.number, form.filled))
    joined = token.join(small(rules.select(F.col("key").alias("__token"), "val")), "__token", "left")
    whole, key, val = strip_all(word), F.col("__token"), F.col("val")
    if form.anywhere:
        at = F.instr(F.col(word), key)
        fixed = F.when(at > 0, F.concat(F.left(F.col(word), at - 1), val, F.substr(F.col(word), at + F.length(key))))
    else:
        front = F.regexp_extract(whole, rf"^\p{{Nd}}+\.[{SPACES}]*", 0)
        rest = F.substr(whole, F.length(front) + 1)
        fixed = F.when(F.lower(F.left(rest, F.length(key))) == key, F.concat(front, val, F.substr(rest, F.length(key) + 1)))
    matched = F.coalesce(val.isNotNull() & (F.length(key) >= form.least), F.lit(False))
    return joined.withColumn("matched", matched).withColumn(word, F.coalesce(F.when(F.col("matched"), fixed), word)).drop("__token", "val")


def fix_first_or_contained(rows: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    """The input with corrected words, `original`, the `source` of the correction ("first token", "inside" or null) and the `rule` that was found inside.

    The leading token is looked up first; words that this leaves as they are get the first contained rule.
    """
    first = fix_first_token(rows.withColumn("__original", F.col(word)), rules, word, FIRST_FORM).drop("matched")
    by_token = ~F.col(word).eqNullSafe(F.col("__original"))
    open_ = first.withColumns({"__first": F.when(by_token, F.col(word)), "__open": F.when(~by_token, F.col(word))})
    out = rewrite_contained(open_, rules, "__open")
    inside = F.col("key").isNotNull()
    source = F.when(F.col("__first").isNotNull(), "first token").when(inside, "inside")
    out = out.withColumns({word: F.coalesce("__first", "fixed"), "source": source, "rule": F.col("key"), "original": F.col("__original")})
    return out.select(*rows.columns, "original", "source", "rule")


def _folded(text: str, letters: dict[int, str | None]) -> str:
    """A form in which all letters that a rule's letter may match are alike; further ones may be alike, too."""
    return text.upper().casefold().translate(letters)


class Rewriter:
    """Every rule in turn on one text, where only rules that occur are tried.

    An automaton over the folded keys names the rules that may match a text in one pass. They are
    applied in order; what a rule writes is searched again around the places that it changed,
    as only there a later rule's match can be new.
    """

    def __init__(self, rules: list[tuple[str, str]], boundary: str, vowels: dict[str, str] | None):
        self.rules = sorted((r for r in rules if r[0] and not (vowels and r[0] == r[1].lower())), key=lambda r: -len(r[0]))
        self.boundary, self.vowels, self.patterns = boundary, vowels, {}
        alike = {ord(x): k for k, letters in (vowels or {}).items() for x in letters.strip("[]").casefold()}
        self.letters = alike | {0x307: None}
        self.reach = 1 + 2 * max((len(k) for k, _ in self.rules), default=0)
        numbers: dict[str, list[int]] = {}
        for i, (key, _) in enumerate(self.rules):
            numbers.setdefault(_folded(key, self.letters), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key, found in numbers.items():
            self.automaton.add_word(key, found)
        if numbers:
            self.automaton.make_automaton()

    def may_match(self, text: str) -> set[int]:
        return {i for _, found in self.automaton.iter(_folded(text, self.letters)) for i in found}

    def pattern(self, rule: int) -> re.Pattern:
        if rule not in self.patterns:
            self.patterns[rule] = re.compile(rule_pattern(self.rules[rule][0], self.boundary, self.vowels), re.IGNORECASE)
        return self.patterns[rule]

    def __call__(self, text: str | None) -> str | None:
        if text is None or not self.rules:
            return text
        waiting = sorted(self.may_match(text))
        known = set(waiting)
        while waiting:
            rule = heapq.heappop(waiting)
            key, form = self.rules[rule]
            places, last, shift = [], 0, 0
            pieces = []
            for m in self.pattern(rule).finditer(text):
                pieces += [text[last : m.start()], form]
                places.append((m.start() + shift, m.start() + shift + len(form)))
                shift += len(form) - (m.end() - m.start())
                last = m.end()
            if not places:
                continue
            text = "".join(pieces) + text[last:]
            for a, b in places:
                for other in self.may_match(text[max(0, a - self.reach) : b + self.reach]) - known:
                    if other > rule:
                        known.add(other)
                        heapq.heappush(waiting, other)
        return text


def rule_pattern(key: str, boundary: str, vowels: dict[str, str] | None = None) -> str:
    """A key between borders; `vowels` says which letters a plain vowel stands for."""
    body = "".join((vowels or {}).get(c) or re.escape(c) for c in (key.lower() if vowels else key))
    return f"(?<![{boundary}]){body}(?![{boundary}])"


def rewrite(text, rules: list[tuple[str, str]], boundary: str = LETTERS, vowels: dict[str, str] | None = None) -> Column:
    """Every rule in turn, longest keys first and then in list order; a rule sees what earlier ones wrote.

    The replacement is the rule's form in its own case. With `vowels`, rules whose form is
    their key are left out, and so are rules without a key. A text costs one pass and what its own rules cost, however many rules there are.
    """

    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(rules, boundary, vowels)
        for part in texts:
            yield part.map(rewriter, na_action="ignore")

    apply.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(apply, "string")(col(text))


def rewrite_typed(rows: DataFrame, rules: list[tuple[str, str]], word: str = "word", definition: str = "definition", kind: str = "type", marked: str = "a_ring_corrected") -> DataFrame:
    """Entries with rewritten definitions, and headwords in the forward direction alone; `marked` is set where one of them changes."""
    fixed = lambda c: rewrite(c, rules, TYPED_STRICT, TYPED_VOWELS)
    forward = F.col(kind) == "wallon-francais"
    new = rows.withColumns({"__word": F.when(forward, fixed(word)).otherwise(F.col(word)), "__definition": fixed(definition)})
    changed = ~F.col("__word").eqNullSafe(F.col(word)) | ~F.col("__definition").eqNullSafe(F.col(definition))
    before = F.col(marked) if marked in rows.columns else F.lit(False)
    new = new.withColumn(marked, F.coalesce(before, F.lit(False)) | changed)
    return new.withColumns({word: F.col("__word"), definition: F.col("__definition")}).drop("__word", "__definition")


def rewrite_contained(rows: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    """Every row, with `key` and `fixed`: the first rule (by `ord`) that is inside the word, doesn't begin it, and changes it.

    A word begins with a key if they agree up to its length once å counts as a. The first
    occurrence is replaced, in any case. Keys are joined on the word's substrings of their
    lengths, once for each distinct word, so no word meets every rule; rows without a rule
    stay as they are, with a null key, and repeated rows stay repeated.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("key")).distinct().collect() if r[0])
    words = rows.select(F.col(word).alias("__word")).where("__word is not null").distinct()
    low = F.lower("__word")
    pieces = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = words.withColumn("key", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[pieces(n) for n in lengths]))))
    at = F.instr(low, F.col("key"))
    fixed = F.concat(F.substr("__word", F.lit(1), at - 1), F.col("val"), F.substr("__word", at + F.length("key")))
    inside = F.substr(F.translate(low, "å", "a"), F.lit(1), F.length("key")) != F.col("key")
    hits = parts.join(small(rules), "key").withColumn("fixed", fixed).where(inside & (F.col("fixed") != F.col("__word")))
    best = hits.groupBy("__word").agg(F.min_by(F.struct("key", "fixed"), "ord").alias("__rule"))
    out = rows.join(best, F.col(word) == F.col("__word"), "left")
    return out.select(*rows.columns, F.col("__rule.key").alias("key"), F.coalesce("__rule.fixed", word).alias("fixed"))


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], x: str, width: float) -> DataFrame:
    """Pairs of rows with equal keys whose `x` differ by less than the width: an equi-join on cells of that width and their neighbours.

    A cell that holds over CELL_ROWS rows of a side is cut into as many shares of that side as it holds that many rows,
    and the other side's rows of the cell are repeated for each share; so one task never holds a hot cell, whichever side fills it.
    Columns of the right side get the prefix `other_`. Rows with a null key or a null `x` have no pair.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    near = left.withColumn("__cell", cell(x))
    far = right.select([F.col(c).alias(f"other_{c}") for c in right.columns])
    far = far.withColumn("__cell", F.explode(F.array(*[cell(f"other_{x}") + F.lit(d) for d in (-1, 0, 1)])))
    theirs = [f"other_{c}" for c in on]

    def counted(rows, keys, into):
        shares = F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias(into)
        return rows.where(F.col("__cell").isNotNull()).groupBy(*[F.col(k).alias(f"__of_{c}") for k, c in zip(keys, on)], F.col("__cell").alias("__of")).agg(shares).where(F.col(into) > 1)

    names = [*[f"__of_{c}" for c in on], "__of"]
    hot = small(stored(counted(near, on, "__a").join(counted(far, theirs, "__b"), names, "full").na.fill(1, ["__a", "__b"]), "hot_cells"))

    def shared(rows, keys, own, repeated):
        match = rows["__cell"] == hot["__of"]
        for k, c in zip(keys, on):
            match = match & (rows[k] == hot[f"__of_{c}"])
        out = rows.join(hot, match, "left").na.fill(1, ["__a", "__b"])
        out = out.withColumn("__own", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col(own)).cast("int"))
        out = out.withColumn("__repeated", F.explode(F.sequence(F.lit(0), F.col(repeated) - 1)))
        return out.withColumns({own: F.col("__own"), repeated: F.col("__repeated")}).drop("__own", "__repeated", *names)

    near, far = shared(near, on, "__a", "__b"), shared(far, theirs, "__b", "__a")
    match = [*[near[c] == far[c] for c in ("__cell", "__a", "__b")], *[near[c] == far[t] for c, t in zip(on, theirs)]]
    joined = near.join(far, match).where(F.abs(F.col(x) - F.col(f"other_{x}")) < width)
    return joined.drop("__cell", "__a", "__b")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str, ahead: int = 4) -> DataFrame:
    """Each row with those of the next few rows of its key, as (step, other)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lead(value, i).over(window).alias("other")) for i in range(1, ahead + 1)])
    return rows.withColumn("__next", steps).withColumn("__next", F.explode("__next")).withColumns({"step": F.col("__next.step"), "other": F.col("__next.other")}).drop("__next").where("other is not null")
