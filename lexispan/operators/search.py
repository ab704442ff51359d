"""Ranked, accent-insensitive search over entries, and what the results are shown as."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, fold, strip

#: The scores of a whole headword, its beginning, its inside, and the body.
EQUAL, PREFIX, INSIDE, BODY = 100, 80, 50, 20
#: Most queries that are broadcast to the letter runs of an index.
BROADCAST_QUERIES = 100_000


def search_index(rows: DataFrame, word: Column, body: Column) -> DataFrame:
    """The input with folded search columns, to be stored once and queried often."""
    return rows.withColumns({"norm_word": fold(word), "norm_body": fold(body)})


def scored(index: DataFrame, query: str) -> DataFrame:
    """Rows of an index that match a folded query, with their score; the first tier that holds counts. An empty query matches none: what it shows is in `results`."""
    if is_empty(query):
        return index.withColumn("score", F.lit(0)).where(F.lit(False))
    q = fold(strip(F.lit(query)))
    w, b = F.col("norm_word"), F.col("norm_body")
    score = F.when(w == q, EQUAL).when(F.startswith(w, q), PREFIX).when(F.contains(w, q), INSIDE).when(F.contains(b, q), BODY).otherwise(0)
    return index.withColumn("score", score).where("score > 0")


def search_order(word: str, tie: str, collation: str = "UNICODE") -> list[Column]:
    """Score, then shorter headwords, then their collation, then the browsing order."""
    return [F.desc("score"), F.length(word).asc(), *browse_order(word, tie, collation)]


def browse_order(word: str, tie: str, collation: str = "UNICODE") -> list[Column]:
    return [F.collate(F.col(word), collation).asc(), F.col(tie).asc()]


def is_empty(query: str) -> bool:
    """Whether nothing of a query is left once white space and marks are gone."""
    marks = unicodedata.normalize("NFD", query.strip())
    return all("\u0300" <= c <= "\u036f" for c in marks)


def results(index: DataFrame, query: str, word: str, tie: str, kind: str | None = None, wanted: str = "all") -> tuple[DataFrame, list[Column]]:
    """The rows that a search shows, and their order: an empty query browses all rows (score 0), both under the filter of one kind."""
    if wanted != "all":
        index = index.where(F.col(kind) == wanted)
    if is_empty(query):
        return index.withColumn("score", F.lit(0)), browse_order(word, tie)
    return scored(index, query), search_order(word, tie)


def entry_body(definitions, examples, synonyms, references) -> Column:
    """The searched body of a nested entry: variants, origin and category aren't in it."""
    pair = F.transform(col(examples), lambda e: F.concat_ws(" ", e["wallon"], e["francais"]))
    return F.concat_ws(" ", F.array_join(col(definitions), " "), F.array_join(pair, " "), F.array_join(col(synonyms), " "), F.array_join(col(references), " "))


def main_translation(definitions, flat) -> Column:
    """The first definition, or else the flat one up to its first mark."""
    return F.coalesce(F.get(col(definitions), 0), F.trim(F.get(F.split(col(flat), "[:;,.]"), 0)))


def entry_key(word, tome, page, kind) -> Column:
    return F.concat(col(word), F.lit("_T"), col(tome).cast("string"), F.lit("_P"), col(page).cast("string"), F.lit("_"), col(kind))


def entry_html(word, category, definitions, examples, gender=None, pronunciation=None, domains=None, expressions=None, synonyms=None, references=None, origin=None) -> Column:
    """A section for each of the seven parts that an entry has: grammar, definitions, examples, expressions, synonyms, references and origin.

    One definition is a paragraph, several are a list, and ~ stands for the word. Parts that are null, empty or not given are left out.
    """
    none = F.array().cast("array<string>")
    text = lambda x: F.coalesce(col(x), F.lit("")) if x is not None else F.lit("")
    many = lambda x: F.coalesce(col(x), none) if x is not None else none
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    only = lambda x, shown: F.when(F.length(x) > 0, shown).otherwise("")
    some = lambda xs, shown: F.when(F.size(xs) > 0, shown).otherwise("")
    items = lambda xs, f: F.array_join(F.transform(xs, f), "")
    word, category, gender, pronunciation, origin = map(text, (word, category, gender, pronunciation, origin))
    definitions, domains, expressions, synonyms, references = map(many, (definitions, domains, expressions, synonyms, references))
    examples = col(examples)
    head = put("<h2>", word, "</h2>")
    marks = put(only(category, put("<em>", category, "</em>")), only(gender, put("<em>", gender, "</em>")), only(pronunciation, put("<span>[", pronunciation, "]</span>")), items(domains, lambda d: put("<em>", d, "</em>")))
    listed = put("<ol>", items(definitions, lambda d: put("<li>", d, "</li>")), "</ol>")
    body = F.when(F.size(definitions) == 0, "").when(F.size(definitions) == 1, put("<p>", F.get(definitions, 0), "</p>")).otherwise(listed)
    pair = lambda e: put("<li>", F.replace(e["wallon"], F.lit("~"), put("<b>", word, "</b>")), F.when(e["francais"] != "", put(" : ", e["francais"])).otherwise(""), "</li>")
    shown = some(examples, put("<ul>", items(examples, pair), "</ul>"))
    sayings = some(expressions, put("<h3>Expressions</h3><ul>", items(expressions, lambda x: put("<li>", x, "</li>")), "</ul>"))
    same = some(synonyms, put("<p>Synonymes : ", F.array_join(F.transform(synonyms, lambda x: put("<a>", x, "</a>")), ", "), "</p>"))
    others = some(references, put("<p>Voir aussi : ", F.array_join(F.transform(references, lambda x: put("<a>", x, "</a>")), ", "), "</p>"))
    return put(head, marks, body, shown, sayings, same, others, only(origin, put("<p>Étymologie : ", origin, "</p>")))


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def search_many(index: DataFrame, queries: DataFrame, query: str, key: str, n: int = 3) -> DataFrame:
    """All matches of many queries at once: the index's columns, the query, and the score.

    A text that holds a query holds its first n letters, or all of a shorter one, so an equi-join
    on runs of up to n letters finds the candidates. Only the unique `key` of a row is repeated for
    its runs; texts are joined to the candidates, and the tiers are checked on these alone.
    Texts are always shuffled for that: by the size of a compressed file the planner would send whole indexes through the driver.
    Empty queries have no letters and no hits: what they show isn't a search but `results`.
    """
    folded = queries.select(query).distinct().withColumn("__q", fold(strip(F.col(query))))
    wanted = folded.where(F.length("__q") >= 1).withColumn("__gram", F.left("__q", F.lit(n)))
    texts = F.concat_ws("\n", "norm_word", "norm_body")
    counts = dict(tuple(r) for r in wanted.groupBy(F.length("__gram")).count().collect())  # at most n of them
    wanted = wanted.hint("broadcast" if sum(counts.values()) <= BROADCAST_QUERIES else "merge")
    grams = index.select(key, F.explode(F.concat(F.array().cast("array<string>"), *[_grams(texts, k) for k in sorted(counts)])).alias("__gram"))
    hits = grams.join(wanted, "__gram").drop("__gram").join(index.hint("merge"), key)
    w, b, q = F.col("norm_word"), F.col("norm_body"), F.col("__q")
    score = F.when(w == q, EQUAL).when(F.startswith(w, q), PREFIX).when(F.contains(w, q), INSIDE).when(F.contains(b, q), BODY).otherwise(0)
    return hits.withColumn("score", score).where("score > 0").select(*index.columns, query, "score")
