"""Search, browsing, paging and the daily pick."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gram_index, ranking, search
from ..operators.stored import shared_dir
from .registration import load, query

SQL_FOLD = "lower(replace(replace(strip_accents({0}), 'œ', 'oe'), 'æ', 'ae'))"


def _parts(spark, sf_dir):
    return search.search_index(load(spark, sf_dir, "part"), F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"))


def _sql_scores(q: str, table: str, word: str, body: str) -> str:
    return f"""SELECT *, CASE WHEN w = '{q}' THEN 100 WHEN starts_with(w, '{q}') THEN 80 WHEN contains(w, '{q}') THEN 50 WHEN contains(b, '{q}') THEN 20 ELSE 0 END AS score
  FROM (SELECT *, {SQL_FOLD.format(word)} AS w, {SQL_FOLD.format(body)} AS b FROM {table})"""


PART_SCORES = _sql_scores("ring", "part", "p_name", "(p_type || ' ' || p_brand)")
PART_ORDER = "score DESC, length(p_name), p_name, p_partkey"


@query(f"SELECT * FROM (SELECT p_partkey, p_name, score, CAST(row_number() OVER (ORDER BY {PART_ORDER}) AS INTEGER) AS rank FROM ({PART_SCORES}) WHERE score > 0) WHERE rank <= 50")
def q1_search_parts(spark, sf_dir):
    """The first page of a ranked search."""
    hits = search.scored(_parts(spark, sf_dir), " Rîng ")
    return ranking.page(hits, search.search_order("p_name", "p_partkey"), 50).select("p_partkey", "p_name", "score", "rank")


@query("SELECT * FROM (SELECT p_partkey, p_name, 0 AS score, CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS INTEGER) AS rank FROM part WHERE p_type = 'SMALL') WHERE rank <= 50")
def q1_search_empty(spark, sf_dir):
    """A search for blanks shows the browsing order of the chosen type."""
    rows, order = search.results(_parts(spark, sf_dir), "  ", "p_name", "p_partkey", "p_type", "SMALL")
    return ranking.page(rows, order, 50).select("p_partkey", "p_name", "score", "rank")


@query(f"SELECT * FROM (SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY {PART_ORDER}) AS INTEGER) AS rank FROM ({PART_SCORES}) WHERE score > 0) WHERE rank > 50 AND rank <= 100")
def l2_next_page(spark, sf_dir):
    """The second page of 50."""
    hits = search.scored(_parts(spark, sf_dir), "ring")
    return ranking.page(hits, search.search_order("p_name", "p_partkey"), 50, 50).select("p_partkey", "score", "rank")


@query(f"SELECT arg_min(p_partkey, r) AS best, count(*) - 1 AS more FROM (SELECT p_partkey, row_number() OVER (ORDER BY {PART_ORDER}) AS r FROM ({PART_SCORES}) WHERE score > 0)")
def l1_collapsed_result(spark, sf_dir):
    """The best hit, and how many more there are."""
    hits = search.scored(_parts(spark, sf_dir), "ring")
    order = F.struct(-F.col("score"), F.length("p_name"), F.col("p_name"), F.col("p_partkey"))
    return hits.agg(F.min_by("p_partkey", order).alias("best"), (F.count("*") - 1).alias("more"))


@query(f"SELECT p_type, count(*) AS n, max(score) AS best FROM ({PART_SCORES}) WHERE score > 0 AND p_type IN ('SMALL', 'LARGE') GROUP BY p_type")
def l3_counts_by_filter(spark, sf_dir):
    """Result counts under a type filter, before any limit."""
    hits = search.scored(_parts(spark, sf_dir).where(F.col("p_type").isin("SMALL", "LARGE")), "ring")
    return hits.groupBy("p_type").agg(F.count("*").alias("n"), F.max("score").alias("best"))


_DOCS = "(SELECT doc_id, split_part(text, ' ', 1) AS word, text FROM documents)"


@query(f"""SELECT doc_id, score FROM ({_sql_scores('ere', _DOCS, 'word', 'text')}) WHERE score > 0""")
def q1_search_documents(spark, sf_dir):
    """All scored documents; the first token is the headword, the text the body."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", " "), 0).alias("word"), "text")
    return search.scored(search.search_index(docs, F.col("word"), F.col("text")), "Éré").select("doc_id", "score")


@query("SELECT * FROM (SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS INTEGER) AS rank FROM part WHERE p_type = 'SMALL') WHERE rank <= 50")
def o4_browse_parts(spark, sf_dir):
    """The first page of the browsing order: collation, then key."""
    rows = load(spark, sf_dir, "part").where("p_type = 'SMALL'").select("p_partkey", "p_name")
    return ranking.page(rows, [F.collate(F.col("p_name"), "UNICODE").asc(), F.col("p_partkey").asc()], 50)


@query("""SELECT doc_id, folded, CAST(row_number() OVER (ORDER BY folded, doc_id) AS INTEGER) AS rank FROM
 (SELECT doc_id, lower(text) AS folded FROM (SELECT doc_id, split_part(text, ' ', 1) AS text FROM documents) ORDER BY 2, 1 LIMIT 40)""")
def o3_lower_order(spark, sf_dir):
    """Code-point order of lower-cased headwords: accents come after z."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.lower(F.get(F.split("text", " "), 0)).alias("folded"))
    return ranking.page(rows, [F.col("folded").asc(), F.col("doc_id").asc()], 40)


@query("""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS number, count(*) OVER () AS total FROM part)
SELECT p_partkey, p_name, CAST(number AS BIGINT) AS number FROM n WHERE number = ((20261126::BIGINT * 1664525 + 1013904223) % 4294967296) % total""")
def l8_daily_pick(spark, sf_dir, day: str = "2026-11-26"):
    """The entry of a day: a congruential draw from the date picks a place in the file's order."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    place = (int(day.replace("-", "")) * 1664525 + 1013904223) % (1 << 32) % max(1, rows.count())
    return ranking.at_place(rows, "p_partkey", place).select("p_partkey", "p_name", "number")


@query("""SELECT p_partkey, p_name || '_T' || CAST(p_size AS VARCHAR) || '_P' || CAST(p_partkey % 7 AS VARCHAR) || '_' || p_type AS entry_key,
 trim(regexp_split_to_array(p_name || ' x;' || p_type, '[:;,.]')[1]) AS translation FROM part""")
def p10_keys_and_translations(spark, sf_dir):
    """Entry keys, and main translations of entries without definitions."""
    flat = F.concat(F.col("p_name"), F.lit(" x;"), F.col("p_type"))
    none = F.array().cast("array<string>")
    return load(spark, sf_dir, "part").select("p_partkey", search.entry_key("p_name", "p_size", F.col("p_partkey") % 7, "p_type").alias("entry_key"), search.main_translation(none, flat).alias("translation"))


@query("""SELECT p_partkey, '<h2>' || p_name || '</h2>' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '<em>' || p_type || '</em>' END ||
 CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '<p>' || p_brand || '</p>' ELSE '<ol><li>' || p_brand || '</li><li>' || p_type || '</li></ol>' END ||
 CASE WHEN p_size % 5 = 0 THEN '' ELSE '<ul><li><b>' || p_name || '</b> big : ' || p_brand || '</li></ul>' END AS html FROM part""")
def p9_entry_html(spark, sf_dir):
    """Entries as display text."""
    size, brand, kind = F.col("p_size"), F.col("p_brand"), F.col("p_type")
    none = F.array().cast("array<string>")
    pair = F.array(F.struct(F.lit("~ big").alias("wallon"), brand.alias("francais")))
    rows = load(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        F.when(size % 2 == 0, "").otherwise(kind).alias("category"),
        F.when(size % 3 == 0, none).when(size % 3 == 1, F.array(brand)).otherwise(F.array(brand, kind)).alias("definitions"),
        F.when(size % 5 == 0, F.slice(pair, 1, 0)).otherwise(pair).alias("examples"),
    )
    return rows.select("p_partkey", search.entry_html("p_name", "category", "definitions", "examples").alias("html"))


@query("""SELECT p_partkey, '<h2>' || p_name || '</h2><em>nom</em>' || CASE WHEN p_size % 2 = 0 THEN '<em>masculin</em>' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '<span>[abc]</span>' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '<em>fig</em><em>techn</em>' ELSE '' END
 || '<p>' || p_brand || '</p>' || CASE WHEN p_size % 4 = 0 THEN '<h3>Expressions</h3><ul><li>' || p_type || '</li><li>x</li></ul>' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '<p>Synonymes : <a>' || p_brand || '</a>, <a>y</a></p>' ELSE '' END
 || CASE WHEN p_size % 3 = 1 THEN '<p>Voir aussi : <a>' || p_type || '</a></p>' ELSE '' END || CASE WHEN p_size % 2 = 1 THEN '<p>Étymologie : lat. ' || p_name || '</p>' ELSE '' END AS html FROM part""")
def p9_entry_sections(spark, sf_dir):
    """All seven sections of entries; parts that are missing are null or empty."""
    size, brand, kind = F.col("p_size"), F.col("p_brand"), F.col("p_type")
    when = lambda test, x: F.when(test, x)
    none = F.expr("cast(array() as array<struct<wallon:string,francais:string>>)")
    html = search.entry_html(
        "p_name", F.lit("nom"), F.array(brand), none,
        gender=when(size % 2 == 0, F.lit("masculin")), pronunciation=F.when(size % 3 == 0, "abc").otherwise(""), domains=when(size % 5 == 0, F.array(F.lit("fig"), F.lit("techn"))),
        expressions=when(size % 4 == 0, F.array(kind, F.lit("x"))), synonyms=when(size % 7 == 0, F.array(brand, F.lit("y"))), references=when(size % 3 == 1, F.array(kind)), origin=when(size % 2 == 1, F.concat(F.lit("lat. "), "p_name")),
    )
    return load(spark, sf_dir, "part").select("p_partkey", html.alias("html"))


@query(f"""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS q FROM part UNION SELECT DISTINCT lower(p_type) FROM part), i AS (SELECT p_partkey, p_name, {SQL_FOLD.format('p_name')} AS w, {SQL_FOLD.format("(p_type || ' ' || p_brand)")} AS b FROM part),
s AS (SELECT q, p_partkey, p_name, CASE WHEN w = q THEN 100 WHEN starts_with(w, q) THEN 80 WHEN contains(w, q) THEN 50 WHEN contains(b, q) THEN 20 ELSE 0 END AS score FROM i JOIN q ON contains(w, q) OR contains(b, q)),
r AS (SELECT q, p_partkey, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, length(p_name), p_name, p_partkey) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 5""")
def q1_search_many(spark, sf_dir):
    """The five best hits of each of many queries, in one job."""
    parts = load(spark, sf_dir, "part")
    wanted = parts.select(F.get(F.split("p_name", " "), 1).alias("q")).union(parts.select(F.lower("p_type")))
    hits = search.search_many(_parts(spark, sf_dir).select("p_partkey", "p_name", "norm_word", "norm_body"), wanted, "q", "p_partkey")
    order = Window.partitionBy("q").orderBy(*search.search_order("p_name", "p_partkey"))
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("q", "p_partkey", "score", "rank")


def _indexed(spark, sf_dir):
    """An index of the parts in two batches and a merge; the second batch also replaces entries that the first one had otherwise."""
    index = gram_index.GramIndex(spark, f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}", buckets=16)
    parts, body = load(spark, sf_dir, "part"), F.concat_ws(" ", "p_type", "p_brand")
    old = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("ring old "), F.reverse("p_name"))).otherwise(F.col("p_name"))
    index.add(parts.where("p_partkey % 3 = 0"), "p_partkey", old, body)
    index.add(parts.where("p_partkey % 3 > 0 or p_partkey % 6 = 0"), "p_partkey", F.col("p_name"), body)
    return index


@query(f"SELECT p_partkey, score FROM ({PART_SCORES}) WHERE score > 0")
def q1_search_indexed(spark, sf_dir):
    """All matches by the index, after its segments were merged."""
    index = _indexed(spark, sf_dir)
    index.merge()
    return index.matches(" Rîng ").select(F.col("key").alias("p_partkey"), "score")


@query(f"SELECT * FROM (SELECT p_partkey, p_name, score, CAST(row_number() OVER (ORDER BY {PART_ORDER}) AS INTEGER) AS rank FROM ({_sql_scores('br', 'part', 'p_name', "(p_type || ' ' || p_brand)")}) WHERE score > 0) WHERE rank <= 50")
def q1_search_indexed_page(spark, sf_dir):
    """The first page for two letters, over two segments of which one replaces entries of the other."""
    found = _indexed(spark, sf_dir).page("BR", 50)
    return found.select(F.col("key").alias("p_partkey"), F.col("word").alias("p_name"), "score", "rank")
