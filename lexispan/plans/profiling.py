"""Quality, counts, characters, deduplication and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import dedup, quality, ranking
from .registration import load, query

HEAD = "split_part(text, ' ', 1)"


def _entries(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "text", F.get(F.split("text", " "), 0).alias("word"))


@query(f"""WITH e AS (SELECT d.*, trim({HEAD}) AS w, trim(text) AS body, coalesce(l.toxic, 0) = 1 AS rev, coalesce(l.quality, 0) = 1 AS cor FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
c AS (SELECT count(*) AS total, count_if(rev) AS needs_review, count_if(cor) AS corrected, count_if(w = '') AS word_empty, count_if(w <> '' AND length(w) > 12) AS word_too_long,
 count_if(w <> '' AND body = '') AS def_empty, count_if(w <> '' AND body <> '' AND length(body) < 100) AS def_too_short, count_if(w <> '' AND length(body) > 9000) AS def_too_long FROM e)
SELECT *, round((1 - (word_empty + word_too_long + def_empty + def_too_long) / total) * 100, 1) AS quality_pct FROM c""")
def a1_quality(spark, sf_dir):
    """Counters of documents as entries; labels give the flags, aggregated before the join."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    rows = _entries(spark, sf_dir).join(labels, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return quality.quality(rows, "word", "text", flag("toxic"), flag("quality"), 12, 100, 9000)


@query("SELECT lang AS key, count(*) AS n FROM documents GROUP BY lang")
def a2_count_by_key(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("n"))


@query(f"SELECT replace(lower(left({HEAD}, 1)), 'å', 'a') AS letter, count(*) AS n FROM documents WHERE {HEAD} <> '' GROUP BY 1")
def a3_count_by_initial(spark, sf_dir):
    return _entries(spark, sf_dir).where("word != ''").groupBy(quality.initial("word").alias("letter")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, length({HEAD}) AS len, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM (SELECT * FROM documents WHERE length({HEAD}) > 9 ORDER BY doc_id LIMIT 50)")
def a5_issue_sample(spark, sf_dir):
    """The first 50 rows with a fault, in row order."""
    bad = _entries(spark, sf_dir).where(F.length("word") > 9).select("doc_id", F.length("word").cast("long").alias("len"))
    return ranking.page(bad, [F.col("doc_id").asc()], 50)


@query(f"""WITH f AS (SELECT unnest(list_distinct(string_split(text, ''))) AS ch FROM documents UNION ALL SELECT unnest(list_distinct(string_split({HEAD}, ''))) FROM documents)
SELECT ch, count(*) AS count, 'U+' || lpad(upper(hex(unicode(ch))), 4, '0') AS code_point FROM f WHERE unicode(ch) > 127 GROUP BY ch""")
def a6_char_presence(spark, sf_dir):
    found = quality.characters_present(_entries(spark, sf_dir), ["word", "text"])
    return found.withColumn("code_point", quality.code_point("ch"))


@query(f"""WITH f AS (SELECT doc_id, {HEAD} AS word, unnest(list_distinct(string_split({HEAD}, ''))) AS ch FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY doc_id) AS n FROM f WHERE unicode(ch) > 127)
SELECT ch, string_agg(word, '|' ORDER BY doc_id) AS samples FROM r WHERE n <= 5 GROUP BY ch""")
def a6_char_samples(spark, sf_dir):
    found = quality.character_samples(_entries(spark, sf_dir), "word", "doc_id")
    return found.select("ch", F.array_join("samples", "|").alias("samples"))


@query("SELECT ch, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE unicode(ch) > 127 GROUP BY ch ORDER BY count DESC, ch LIMIT 15")
def a7_char_frequency(spark, sf_dir):
    """The 15 commonest non-ASCII characters."""
    return quality.character_counts(load(spark, sf_dir, "documents"), "text").orderBy(F.desc("count"), "ch").limit(15)


@query(f"SELECT count_if(NOT regexp_full_match({HEAD}, '[\\x00-\\x7F]*')) AS words, count_if(regexp_matches(text, '[^\\x00-\\x7F]')) AS texts, count_if(contains(text, 'é')) AS with_e_acute FROM documents")
def a8_presence_counts(spark, sf_dir):
    has = lambda c: F.count_if(F.col(c).rlike(quality.NON_ASCII))
    return _entries(spark, sf_dir).agg(has("word").alias("words"), has("text").alias("texts"), F.count_if(F.contains("text", F.lit("é"))).alias("with_e_acute"))


@query(f"""SELECT doc_id, k, lang FROM (SELECT doc_id, lang, lower(replace(replace(strip_accents({HEAD}), 'œ', 'oe'), 'æ', 'ae')) AS k, row_number() OVER (PARTITION BY lower(replace(replace(strip_accents({HEAD}), 'œ', 'oe'), 'æ', 'ae')), lang ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def a9_keep_longest(spark, sf_dir):
    rows = _entries(spark, sf_dir).select("doc_id", "lang", fold("word").alias("k"), "text")
    return dedup.keep_longest(rows, ["k", "lang"], "text", "doc_id").select("doc_id", "k", "lang")


@query(f"""SELECT doc_id, k, lang FROM (SELECT doc_id, lang, lower(trim({HEAD})) AS k, row_number() OVER (PARTITION BY lower(trim({HEAD})), lang, source ORDER BY lower({HEAD}), doc_id) AS n FROM documents) WHERE n = 1""")
def a10_keep_first(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumn("k", F.lower(F.trim("word")))
    return dedup.keep_first(rows, ["k", "lang", "source"], F.lower("word"), F.col("doc_id")).select("doc_id", "k", "lang")


@query(f"SELECT left(lower({HEAD}), 3) AS key, arg_min({HEAD}, length({HEAD}) * 1000000000 + doc_id) AS val FROM documents GROUP BY 1")
def a11_shortest_by_key(spark, sf_dir):
    return dedup.shortest_by_key(_entries(spark, sf_dir), F.left(F.lower("word"), F.lit(3)), "word", "doc_id")


@query("SELECT source AS file, count(*) AS n, sum(length(text)) AS chars, avg(length(text)) AS mean_length, count_if(length(text) < 500) AS short, count_if(lang = 'en') AS english FROM documents GROUP BY source")
def a12_stats_by_file(spark, sf_dir):
    """Counts, sums, means and conditional counts by file."""
    n = F.length("text")
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(
        F.count("*").alias("n"), F.sum(n).alias("chars"), F.avg(n).alias("mean_length"), F.count_if(n < 500).alias("short"), F.count_if(F.col("lang") == "en").alias("english")
    )


@query("SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_size, p_type LIMIT 10")
def a17_histogram(spark, sf_dir):
    """The ten commonest combinations of attributes."""
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_size", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_size", "p_type").limit(10)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def a20_ordered_text(spark, sf_dir):
    return quality.ordered_text(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "body")


@query("SELECT lang, string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def a21_nested_counts(spark, sf_dir):
    """A map of counts for each key, shown as text."""
    counts = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    nested = counts.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return nested.select("lang", F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT p_partkey, draw FROM (SELECT p_partkey, md5('review' || CAST(p_partkey AS VARCHAR)) AS draw FROM part) ORDER BY draw, p_partkey LIMIT 200")
def l5_review_sample(spark, sf_dir):
    """200 rows at random, the same ones on each run."""
    return ranking.hash_sample(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 200, "review")


@query("""SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_size, lower(p_name), p_partkey) AS INTEGER) AS place FROM (SELECT *, md5('review' || CAST(p_partkey AS VARCHAR)) AS draw FROM part ORDER BY draw, p_partkey LIMIT 200)""")
def l5_sorted_sample(spark, sf_dir):
    """The sample in page and word order, as it is handed to reviewers."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    order = [F.col("p_size").asc(), F.lower("p_name").asc(), F.col("p_partkey").asc()]
    return ranking.hash_sample(parts, "p_partkey", 200, "review", order).select("p_partkey", "p_name", "place")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS up, row_number() OVER (ORDER BY o_orderkey DESC) AS down, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, CASE WHEN total <= 5000 THEN 'all' WHEN up <= 250 THEN 'head' ELSE 'tail' END AS side FROM n WHERE total <= 5000 OR up <= 250 OR down <= 250""")
def l6_head_and_tail(spark, sf_dir):
    """The rows that are validated of a long list; the middle is trusted."""
    return ranking.head_and_tail(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 250, 5000)


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 10 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 10 AS INTEGER) AS place FROM orders")
def w9_batches(spark, sf_dir):
    """Batches of ten rows by position."""
    rows = ranking.numbered(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select("o_orderkey", F.expr("number div 10").alias("batch"), (F.col("number") % 10).cast("int").alias("place"))


@query("""SELECT (SELECT count(*) FROM documents) AS old_rows, (SELECT count(*) FROM labels) AS new_rows, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS gone""")
def j11_compare_counts(spark, sf_dir):
    """Two datasets' counts side by side: a cross of two one-row aggregates."""
    old, new = (load(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("documents", "old_rows"), ("labels", "new_rows")))
    return old.crossJoin(new).withColumn("gone", F.col("old_rows") - F.col("new_rows"))
