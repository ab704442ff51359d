"""Scans of pages and files, manifests and reports."""

from __future__ import annotations

import uuid

import unicodedata

from pyspark.sql import functions as F

from ..functions import text
from ..operators import quality, ranking
from ..sources import files, html
from .registration import load, query


@query("""WITH a AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1))) AS href FROM pages),
l AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(lower(trim(href)), '^https?://') THEN trim(href) WHEN starts_with(trim(href), '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || trim(href) ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || trim(href) END, '^http://', 'https://') AS link FROM a WHERE regexp_matches(href, '(?i)th'))
SELECT link, min(page_id) AS page, regexp_extract(link, '([^/?]*)(\\?.*)?$', 1) AS filename FROM l GROUP BY link""")
def s1_links(spark, sf_dir):
    """Links that fit a pattern, made absolute, each once with the first page that has it."""
    return html.links(load(spark, sf_dir, "pages"), pattern="(?i)th").select("link", "page", "filename")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def n22_without_tags(spark, sf_dir):
    bare = text.without_tags("html")
    return load(spark, sf_dir, "pages").select("page_id", F.length(bare).cast("long").alias("chars"), F.md5(bare).alias("digest"))


@query("""SELECT source AS file, CASE WHEN coalesce(sum(CASE WHEN doc_id // 20 < 4 THEN length(text) END), 0) > 100 THEN 'native_text' WHEN coalesce(sum(CASE WHEN doc_id // 20 < 4 THEN doc_id % 2 END), 0) > 0 THEN 'scanned_image' ELSE 'empty' END AS kind FROM documents GROUP BY source""")
def s6_file_kind(spark, sf_dir):
    """Sources as files, documents as their pages."""
    pages = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.expr("doc_id div 20").alias("page"), F.length("text").alias("chars"), (F.col("doc_id") % 2).alias("images"))
    return files.file_kind(pages, "file", "page", "chars", "images")


@query("""WITH b AS (SELECT doc_id, string_split('intro' || chr(10) || '=== PAGE 1 ===' || chr(10) || replace(text, '. ', '.' || chr(10) || '=== PAGE 2 ===' || chr(10)), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM b),
m AS (SELECT *, TRY_CAST(nullif(regexp_extract(trim(line), '^=== PAGE ([0-9]+) ===$', 1), '') AS INTEGER) AS mark FROM l),
p AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS page FROM m)
SELECT doc_id, page, count(*) AS lines FROM p WHERE mark IS NULL GROUP BY ALL""")
def s8_paged_lines(spark, sf_dir):
    """Lines of files with page marks."""
    body = F.concat(F.lit("intro\n=== PAGE 1 ===\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n=== PAGE 2 ===\n")))
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return files.paged(lines, "doc_id").groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 = 0 ELSE true END AS done FROM orders")
def s3_retry(spark, sf_dir):
    """Failed rows get the outcome of a second try."""
    orders = load(spark, sf_dir, "orders")
    manifest = orders.select("o_orderkey", (F.col("o_orderstatus") != "F").alias("done"))
    second = orders.where("o_orderstatus = 'F' and o_orderkey % 3 = 0").select("o_orderkey", F.lit(True).alias("done"))
    return files.retried(manifest, second, "o_orderkey", "done")


@query("SELECT doc_id, source, 'first' AS method FROM documents WHERE length(text) > 6000 UNION ALL SELECT doc_id, source, 'second' FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE length(text) > 6000)")
def s5_fallback(spark, sf_dir):
    """A second extractor's rows where the first one gave none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    first = docs.where("n > 6000").select("doc_id", "source", F.lit("first").alias("method"))
    return files.with_fallback(first, docs.select("doc_id", "source", F.lit("second").alias("method")), "source")


@query("SELECT conv_id, string_agg('=== PAGE ' || turn || ' ===' || chr(10) || text, chr(10) ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def k3_page_marked(spark, sf_dir):
    return files.page_marked(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""SELECT 'window.dictionaryData = [' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || '];' AS value FROM region""")
def k2_script_value(spark, sf_dir):
    """A small table as a script's global."""
    return files.script_value(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query("""SELECT '{"total":' || count(*) || ',"english":' || count_if(lang = 'en') || '}' AS report FROM documents""")
def k4_report(spark, sf_dir):
    counts = load(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"))
    return counts.select(files.report(counts).alias("report"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'lêd å|tåve|tåvlea' WHEN 1 THEN 'tåve|tåvlea|åbe ' || p_brand WHEN 2 THEN 'gråce|tåve|tåvlea' ELSE 'tåve|tåvlea' END AS forms FROM part""")
def p17_wiki_forms(spark, sf_dir):
    """Title, bold words, link targets and headings of wiki text that hold å; links into namespaces don't count."""
    size = F.col("p_size") % 4
    body = F.concat(F.lit("== {{langue|wa}} ==\n'''tåve''' [[tåvlea|x]] [[table]] [[Categoreye:Lingaedje å]] [[Imådje:a.png]] '''å''' [[Åbe]] "), F.when(size == 0, "\n==== lêd å ====\n").when(size == 2, "\n===== gråce =====\n=== tåle ===\n").otherwise("'''plain'''"))
    title = F.when(size == 1, F.concat(F.lit("åbe "), "p_brand")).otherwise("abe")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(html.wiki_forms(body, title), "|").alias("forms"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_name ELSE array_to_string(list_sort([p_name, 'Åbe', 'tåve', 'låme']), '|') END AS forms FROM part""")
def p17_section_forms(spark, sf_dir):
    """Forms of the language's section alone; another heading ends it."""
    size = F.col("p_size") % 3
    head = F.when(size == 0, "== {{langue|wa}} ==").when(size == 1, "== Wallon ==").otherwise("== {{langue|fr}} ==")
    body = F.concat(F.lit("'''dvant å'''\n"), head, F.lit("\n'''tåve''' [[låme|x]] [[table]]\n=== sub ===\n[[Åbe]]\n== {{langue|nl}} ==\n[[après å]]"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(html.section_forms(body, "p_name"), "|").alias("forms"))


def _new_path(spark, name):
    """A new folder where the cluster keeps shared files; beside the warehouse if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS p_brand FROM part")
def s9_json_array(spark, sf_dir):
    """Files that are JSON arrays, one for each brand, are read back as rows."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    row = F.to_json(F.struct("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("p_brand")))
    arrays = rows.groupBy("p_brand").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(row), ",\n"), F.lit("\n]\n")).alias("value"))
    path = _new_path(spark, "arrays")
    # one row for each brand, so a file holds one array
    arrays.repartition("p_brand").select("p_brand", "value").write.partitionBy("p_brand").text(path)
    return files.json_array(spark, f"{path}/*", "p_partkey long, p_name string, p_brand string").select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, 'second' AS origin FROM part WHERE p_size > 10")
def s10_fallback_table(spark, sf_dir):
    """The embedded table if it has rows, else the other one."""
    parts = load(spark, sf_dir, "part")
    embedded = parts.where("p_size > 10000").select("p_partkey", F.lit("first").alias("origin"))
    return files.first_that_has_rows(embedded, parts.where("p_size > 10").select("p_partkey", F.lit("second").alias("origin")))


@query("SELECT p_partkey, p_name, p_size FROM part")
def k1_written_entries(spark, sf_dir):
    """Entries written as JSON Lines in order, and read again."""
    path = _new_path(spark, "entries")
    files.write_entries(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path, ["p_size", "p_partkey"])
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


@query("SELECT p_partkey, 'old' AS state, 1 AS version FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'new', 2 FROM part")
def k6_versions(spark, sf_dir):
    """A second write leaves the first one readable: versions are folders of their own."""
    parts, path = load(spark, sf_dir, "part").select("p_partkey", "p_size"), _new_path(spark, "versions")
    first = files.write_version(parts.where("p_size % 2 = 0").select("p_partkey", F.lit("old").alias("state")), path, ["p_partkey"])
    second = files.write_version(parts.select("p_partkey", F.lit("new").alias("state")), path, ["p_partkey"])
    read = lambda n: spark.read.schema("p_partkey long, state string").json(f"{path}/version={n}").withColumn("version", F.lit(n))
    return read(first).union(read(second))


@query("""WITH m AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' å' WHEN p_size % 3 = 1 THEN ' Å' ELSE '' END AS title, (row_number() OVER (ORDER BY p_partkey) - 1) // 500 AS batch FROM part)
SELECT DISTINCT title FROM m WHERE (batch + 1) * 500 <= 5500 AND (contains(title, 'å') OR contains(title, 'Å'))""")
def s12_category_members(spark, sf_dir):
    """Titles with å of a category's members, read in batches of 500 until more than 5,000 are seen."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " å").when(F.col("p_size") % 3 == 1, " Å").otherwise(""))
    rows = ranking.numbered(load(spark, sf_dir, "part").select("p_partkey", title.alias("title")), "p_partkey")
    read = rows.withColumn("batch", F.expr("number div 500")).where((F.col("batch") + 1) * 500 <= html.members_seen(500))
    return read.where(F.lower("title").contains("å")).select("title").distinct()


@query("SELECT * FROM (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS request FROM part WHERE p_size % 3 = 0) WHERE request <= 150")
def l7_request_cap(spark, sf_dir):
    """The first 150 doubtful entries are asked for; the cap is the feature."""
    return ranking.page(load(spark, sf_dir, "part").where("p_size % 3 = 0").select("p_partkey"), [F.col("p_partkey").asc()], 150, into="request")


#: Names of the letters of the Latin blocks, and of the general marks, for the SQL.
CHARACTER_NAMES = " ".join(f"WHEN {c} THEN '{unicodedata.name(chr(c))}'" for c in [*range(0xA0, 0x250), *range(0x2010, 0x2040), 0xFFFD] if unicodedata.name(chr(c), ""))


@query(f"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS count FROM c WHERE unicode(ch) > 127 GROUP BY ch)
SELECT ch, count, 'U+' || printf('%04X', unicode(ch)) AS code_point, CASE unicode(ch) {CHARACTER_NAMES} END AS name FROM n""")
def n15_character_names(spark, sf_dir):
    """Code points and names of all characters beyond ASCII that occur."""
    found = quality.with_names(quality.character_counts(load(spark, sf_dir, "documents"), "text"))
    return found.select("ch", "count", "code_point", "name")


@query("""WITH n AS (SELECT p_partkey // 10 AS batch, p_partkey % 10 + 1 AS i, left(p_name, 6) AS w FROM part) SELECT batch, string_agg(i || '. ' || w, chr(10) ORDER BY i) AS prompt FROM n GROUP BY batch""")
def p18_prompts(spark, sf_dir):
    """Numbered batches of ten truncated rows."""
    place = (F.col("p_partkey") % 10 + 1).alias("i")
    rows = load(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("batch"), place, F.left("p_name", F.lit(6)).alias("w"))
    line = lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["w"])
    return rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), line), "\n").alias("prompt"))


@query("""SELECT p_partkey, p_size % 3 <> 0 AS valid FROM part""")
def p19_replies(spark, sf_dir):
    """Replies read line by line; what isn't mentioned is valid."""
    parts = load(spark, sf_dir, "part")
    line = F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_partkey") % 10 + 1).cast("string"), F.lit(".  BRUIT"))).otherwise(F.when(F.col("p_size") % 3 == 1, F.concat((F.col("p_partkey") % 10 + 1).cast("string"), F.lit(". VALIDE"))).otherwise("?"))
    replies = parts.groupBy(F.expr("p_partkey div 10").alias("batch")).agg(F.array_join(F.collect_list(line), "\n").alias("reply"))
    read = replies.select("batch", F.explode(F.split("reply", "\n")).alias("line")).select("batch", F.regexp_extract("line", r"(\d+)\.\s*(VALIDE|BRUIT)", 1).try_cast("int").alias("i"), (F.regexp_extract("line", r"(\d+)\.\s*(VALIDE|BRUIT)", 2) == "VALIDE").alias("ok")).where("i is not null")
    rows = parts.select("p_partkey", F.expr("p_partkey div 10").alias("batch"), (F.col("p_partkey") % 10 + 1).cast("int").alias("i"))
    return rows.join(read, ["batch", "i"], "left").select("p_partkey", F.coalesce("ok", F.lit(True)).alias("valid"))
