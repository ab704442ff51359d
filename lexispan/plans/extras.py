"""Smaller scans, filters, windows and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entries, layout, parsing, ranking, rules, scans
from ..sources import files, spans
from .registration import load, query


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS tome, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 7 END AS page FROM part")
def p2_fill_from_name(spark, sf_dir):
    """Numbers that are zero are filled in from the file's name; others stay."""
    name = F.concat(F.lit("tome"), F.when(F.col("p_size") % 2 == 0, "2").otherwise("3"), F.lit("-04_"), F.col("p_size").cast("string"), F.lit(".pdf"))
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", name.alias("source"), F.lit(0).alias("tome"), F.when(F.col("p_size") % 3 == 0, 0).otherwise(7).alias("page"))
    return entries.filled_from_name(rows, "source").select("p_partkey", "p_name", "tome", "page")


@query("""SELECT p_partkey, ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN 'ab élan ệ' ELSE ' x' END AS word, p_type || ' ơ' AS definition, CASE WHEN p_size % 3 = 0 THEN 'francais-wallon' ELSE 'wallon-francais' END AS type, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 0 END AS tome, '' AS slice FROM part""")
def p12_clean_entries(spark, sf_dir):
    """Normal form, control characters (line ends and tabs, too), blanks and defaults of flat entries."""
    size = F.col("p_size")
    word = F.concat(F.lit("\x07 "), F.col("p_name"), F.when(size % 2 == 0, F.lit("\na\tb e\u0301lan  e\u0302\u0323\u00a0")).otherwise(F.lit(" \u2003 \n x  ")))
    third = lambda x, t: F.when(size % 3 == 0, F.lit(x)).cast(t)
    rows = load(spark, sf_dir, "part").select("p_partkey", word.alias("word"), F.concat(F.col("p_type"), F.lit("\x00 o\u031b")).alias("definition"), third("francais-wallon", "string").alias("type"), third(3, "int").alias("tome"), F.lit(None).cast("string").alias("slice"))
    return entries.cleaned(rows).select("p_partkey", "word", "definition", "type", "tome", "slice")


@query("SELECT p_partkey, p_name AS word, p_type || ' ' || p_brand AS definition FROM part WHERE p_size % 4 <> 0")
def f6_accepted_lines(spark, sf_dir):
    """Lines of a word, a mark and a definition that holds a letter."""
    line = F.concat(F.col("p_name"), F.lit(" ; "), F.when(F.col("p_size") % 4 == 0, "12").otherwise(F.concat_ws(" ", "p_type", "p_brand")))
    return entries.accepted(load(spark, sf_dir, "part").select("p_partkey", line.alias("line")), "line").select("p_partkey", "word", "definition")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 40 BETWEEN 6 AND 31 AND NOT (doc_id % 3 = 0 AND doc_id % 40 < 7)")
def f8_main_files(spark, sf_dir):
    """Files of the main dictionary, by the numbers in their names."""
    name = F.concat(F.lit("tome"), (F.col("doc_id") % 3 + 2).cast("string"), F.lit("-"), (F.col("doc_id") % 40).cast("string"))
    tome, number, _ = parsing.file_meta(name)
    rows = load(spark, sf_dir, "documents").select("doc_id", tome.alias("tome"), number.alias("number"))
    return rows.where(((F.col("tome") == 2) & F.col("number").between(7, 31)) | ((F.col("tome") == 3) & F.col("number").between(6, 31))).select("doc_id")


@query("SELECT DISTINCT split_part(text, ' ', 1) AS word FROM documents WHERE length(split_part(text, ' ', 1)) >= 2 AND contains(split_part(text, ' ', 1), 'é') AND NOT regexp_matches(split_part(text, ' ', 1), '[{}\\[\\]|#*]')")
def f13_reference_words(spark, sf_dir):
    """Words for a reference list: long enough, with the wanted letter, without markup."""
    words = load(spark, sf_dir, "documents").select(F.get(F.split("text", " "), 0).alias("word"))
    return words.where(entries.reference_word("word", "é")).distinct()


@query("SELECT key, val FROM (VALUES ('adje', 'ådje'), ('lon', 'lon2')) t(key, val)")
def f14_rule_guard(spark, sf_dir):
    """Rules with long keys, and the short ones that are listed as safe."""
    table = spark.createDataFrame([("adje", "ådje"), ("lon", "lon2"), ("ab", "åb")], "key string, val string")
    return entries.guarded(table, 4, ["lon"])


@query("SELECT count_if(length(split_part(text, ' ', 1)) > 9) AS review, count_if(length(text) < 10) AS empty, count(*) AS total FROM documents")
def f16_subsets(spark, sf_dir):
    """Sizes of the subsets that are looked at by hand."""
    return load(spark, sf_dir, "documents").agg(F.count_if(F.length(F.get(F.split("text", " "), 0)) > 9).alias("review"), F.count_if(F.length("text") < 10).alias("empty"), F.count("*").alias("total"))


@query("SELECT user_id, side, least_x AS margin FROM (SELECT user_id, CASE WHEN value < 50 THEN 'left' ELSE 'right' END AS side, min(value) AS least_x FROM events GROUP BY ALL)")
def a16_left_margins(spark, sf_dir):
    """The left margin of each column of a page."""
    rows = load(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("value") < 50, "left").otherwise("right").alias("side"))
    return layout.left_margin(rows, ["user_id"], "side", "value").select("user_id", "side", "margin")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 100)")
def l9_slice(spark, sf_dir):
    """Five rows behind the first hundred."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey").asc()], 5, 100).select("o_orderkey")


@query("SELECT user_id, event_id, CAST(n AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def w10_first_of_each(spark, sf_dir):
    """The first five rows of each key; each task passes on five a key."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").withColumn("place", F.row_number().over(order)).where("place <= 5").select("user_id", "event_id", "place")


@query("SELECT event_id, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) > 2 AS spaced FROM events")
def w6_gap_before(spark, sf_dir):
    """Whether a span stands apart from the one before."""
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(gap > 2, F.lit(False)).alias("spaced"))


@query("WITH s AS (SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'assistant' THEN true WHEN role = 'user' THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM conversations) SELECT conv_id, count_if(inside) AS inside FROM s GROUP BY conv_id")
def w8_running_flag(spark, sf_dir):
    """Rows inside a section that one mark opens and another closes."""
    mark = F.when(F.col("role") == "assistant", True).when(F.col("role") == "user", False)
    rows = parsing.carried(load(spark, sf_dir, "conversations").withColumn("mark", mark), ["conv_id"], "turn", "mark", "inside")
    return rows.groupBy("conv_id").agg(F.count_if(F.coalesce("inside", F.lit(False))).alias("inside"))


@query("""SELECT event_id, segment FROM (SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS segment FROM events) WHERE segment > 0""")
def w4_one_scope(spark, sf_dir):
    """All events as one scope, cut at each signup."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return scans.segments(rows, [], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "segment")


@query("""WITH m AS (SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM events)
SELECT event_id, coalesce(lead(page) OVER (ORDER BY ts, event_id), -1) AS page FROM m WHERE event_type = 'signup'""")
def w5_one_scope(spark, sf_dir):
    """All events as one scope: errors are the page marks, signups begin entries, and an entry gets the page at which the next begins."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts", "event_type").withColumn("mark", F.when(F.col("event_type") == "error", F.col("event_id")))
    starts = scans.carried(rows, [], ["ts", "event_id"], "mark", "seen").where("event_type = 'signup'").withColumn("final", F.lit(-1).cast("long"))
    return scans.page_at_flush(starts, [], ["ts", "event_id"], "seen", "final", "page").select("event_id", "page")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM events""")
def w8_few_scopes(spark, sf_dir):
    """Three scopes of a third of all events each, and whether each event lies behind a signup that no purchase has closed."""
    mark = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "purchase", False)
    rows = load(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("scope"), mark.alias("mark"))
    return scans.carried(rows, ["scope"], ["ts", "event_id"], "mark", "inside").select("event_id", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 AS first_seen FROM part")
def w11_first_occurrence(spark, sf_dir):
    """Whether a value occurs for the first time: by a least key instead of a window over each value's rows."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    first = parts.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return parts.join(first, "p_name").select("p_partkey", "p_name", (F.col("p_partkey") == F.col("first")).alias("first_seen"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind FROM part UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'customer' FROM customer) GROUP BY kind")
def u1_union_all(spark, sf_dir):
    """Rows of several files in one table."""
    tables = [load(spark, sf_dir, t).select(F.lit(t).alias("kind")) for t in ("part", "supplier", "customer")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT count_if(p_size > 25) AS large, count_if(NOT p_size > 25) AS small FROM part")
def u5_two_subsets(spark, sf_dir):
    """A table parted in two by a predicate, in one scan."""
    return load(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(~(F.col("p_size") > 25)).alias("small"))


@query("""SELECT p_partkey, CAST(b AS INTEGER) AS block, CAST(l AS INTEGER) AS line, p_name || CAST(l AS VARCHAR) AS text, l = 1 AS bold, round(p_retailprice + l, 1) AS x0 FROM part, (VALUES (0, 0), (0, 1), (1, 0)) t(b, l)""")
def s7_spans(spark, sf_dir):
    """Styled spans out of nested page layouts; blank spans are dropped."""
    span = lambda n: F.struct(F.concat(F.col("p_name"), F.lit(str(n))).alias("text"), F.lit(16 if n == 1 else 0).alias("flags"), F.lit("Times").alias("font"), F.lit(9.04).alias("size"), F.array(F.col("p_retailprice") + n, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"))
    blank = F.struct(F.lit("  ").alias("text"), F.lit(0).alias("flags"), F.lit("Times").alias("font"), F.lit(9.04).alias("size"), F.array(F.col("p_retailprice") + 0, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"))
    line = lambda *s: F.struct(F.array(*s).alias("spans"))
    block = lambda kind, *ls: F.struct(F.lit(kind).alias("type"), F.array(*ls).alias("lines"))
    layout_ = F.array(block(0, line(span(0), blank), line(span(1))), block(0, line(span(0))), block(1, line(span(0))))
    rows = load(spark, sf_dir, "part").select("p_partkey", layout_.alias("blocks"))
    return spans.spans_of(rows, ["p_partkey"], "blocks").select("p_partkey", "block", "line", "text", "bold", "x0")


@query("SELECT key, title FROM (SELECT DISTINCT left(p_name, 1) AS key, p_name AS title FROM part WHERE p_name >= 'c' AND p_name <= 'czzz' AND contains(p_name, 'o'))")
def s11_title_range(spark, sf_dir):
    """Titles of a range of an ordered listing, filtered by a letter."""
    titles = load(spark, sf_dir, "part").select(F.left("p_name", F.lit(1)).alias("key"), F.col("p_name").alias("title")).distinct()
    return titles.where(F.col("title").between("c", "czzz") & F.contains("title", F.lit("o")))


@query("SELECT form, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '[a-z]*tion[a-z]*')) AS form FROM pages WHERE contains(html, 'tion')) GROUP BY form")
def s13_text_search(spark, sf_dir):
    """Forms in the pages that a text search finds, without their tags."""
    found = load(spark, sf_dir, "pages").where(F.contains("html", F.lit("tion"))).select(F.explode(F.regexp_extract_all(text.without_tags("html"), F.lit("[a-z]*tion[a-z]*"), 0)).alias("form"))
    return found.groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT p.page_id, c.conv_id IS NOT NULL AS found, c.turns FROM pages p LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c ON p.page_id = c.conv_id")
def s14_lookup(spark, sf_dir):
    """A text fetched for each title: a lookup join on a table of texts."""
    texts = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.count("*").alias("turns"))
    return load(spark, sf_dir, "pages").select("page_id").join(texts, "page_id", "left").select("page_id", F.col("turns").isNotNull().alias("found"), "turns")


@query("""SELECT '<h1>Report</h1><p>' || (SELECT count(*) FROM region) || ' rows</p><table>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS html FROM region""")
def k5_html_report(spark, sf_dir):
    """A report page with a table of sampled rows."""
    rows = load(spark, sf_dir, "region")
    return files.html_report(rows.select("r_regionkey", "r_name"), rows.agg(F.count("*").alias("n")), ["r_regionkey"])


@query("SELECT user_id, event_id AS glyph, other AS shape FROM (SELECT a.user_id, a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND abs(a.value - b.value) < 0.2)")
def s15_glyph_shapes(spark, sf_dir):
    """Shapes that lie near a glyph of their page."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    near = rules.band_pairs(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id"], "value", 0.2)
    return near.select("user_id", F.col("event_id").alias("glyph"), F.col("other_event_id").alias("shape"))


#: Parted letters of several scripts, some with their marks out of order, and a Hangul syllable in parts.
PARTED = "e\u0323\u0302 o\u031b\u0301 a\u0315\u0300\u05ae \u03b1\u0301 \u0438\u0306 \u1112\u1161\u11ab \u212b s\u0307\u0323 "


@query(f"SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), ' the ', ' {PARTED}')) AS composed, strlen(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), ' the ', ' {PARTED}'))) AS bytes FROM documents")
def n4_composed(spark, sf_dir):
    """Whole texts with parted letters, put together."""
    parted = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit(" the "), F.lit(f" {PARTED}"))
    return load(spark, sf_dir, "documents").select("doc_id", text.composed(parted).alias("composed")).withColumn("bytes", F.octet_length("composed").cast("long"))


@query("SELECT doc_id, translate(lower(split_part(text, ' ', 1)), 'åâà', 'aaa') AS wide, translate(lower(split_part(text, ' ', 1)), 'å', 'a') AS narrow, regexp_matches(split_part(text, ' ', 1), '[âôûîèêëœæ]') AS accented FROM documents")
def n6_ring_keys(spark, sf_dir):
    """Keys of rule tables, and words with local accents."""
    word = F.get(F.split("text", " "), 0)
    return load(spark, sf_dir, "documents").select("doc_id", text.ring_key(word, wide=True).alias("wide"), text.ring_key(word).alias("narrow"), word.rlike("[âôûîèêëœæ]").alias("accented"))
