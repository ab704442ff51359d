"""Layout, segmentation, entry parsing and restructuring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import flow, increments, layout, parsing, ranking, restructure
from ..operators.stored import shared_dir
from .registration import load, query, sql_clean, sql_pattern


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value, event_id) AS n FROM events),
w AS (SELECT user_id, day, event_id, n, value AS anchor, 0 AS line_no FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.day, e.event_id, e.n, CASE WHEN abs(e.value - w.anchor) > 3.5 THEN e.value ELSE w.anchor END, CASE WHEN abs(e.value - w.anchor) > 3.5 THEN w.line_no + 1 ELSE w.line_no END
 FROM w JOIN e ON e.user_id = w.user_id AND e.day = w.day AND e.n = w.n + 1)
SELECT event_id, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY user_id, day, line_no ORDER BY event_id) - 1 AS INTEGER) AS place FROM w""")
def w1_anchor_lines(spark, sf_dir):
    """Events of a user's day as spans: value is the height, event_id the position in a line."""
    spans = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id", "value")
    return layout.lines(spans, ["user_id", "day"], "value", "event_id").select("event_id", "line_no", "place")


@query("""WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS x, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS lo, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem),
c AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) - x AS gap FROM r WHERE x >= lo + (hi - lo) * 0.35 AND x <= lo + (hi - lo) * 0.65),
b AS (SELECT k, x, gap, row_number() OVER (PARTITION BY k ORDER BY gap DESC NULLS LAST, x) AS n, count(*) OVER (PARTITION BY k) AS m FROM c),
a AS (SELECT k, min(lo) AS lo, min(hi) AS hi FROM r GROUP BY k)
SELECT a.k AS l_suppkey, round(CASE WHEN m >= 2 AND gap >= 5 THEN x + gap / 2 ELSE (lo + hi) / 2 END, 4) AS split FROM a LEFT JOIN b ON a.k = b.k AND b.n = 1""")
def w2_largest_gap(spark, sf_dir):
    """The widest central gap of each supplier's prices."""
    found = layout.column_split(load(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice")
    return found.select("l_suppkey", F.round("split", 4).alias("split"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, min(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS lo, max(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS hi FROM events),
c AS (SELECT user_id, day, value, lead(value) OVER (PARTITION BY user_id, day ORDER BY value) - value AS gap FROM s WHERE value >= lo + (hi - lo) * 0.35 AND value <= lo + (hi - lo) * 0.65),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY gap DESC NULLS LAST, value) AS n, count(*) OVER (PARTITION BY user_id, day) AS m FROM c)
SELECT event_id, CASE WHEN s.value < CASE WHEN m >= 2 AND gap >= 5 THEN b.value + gap / 2 ELSE (lo + hi) / 2 END THEN 'left' ELSE 'right' END AS side FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.day = b.day AND b.n = 1""")
def w3_routing(spark, sf_dir):
    """Spans sent to the left or the right column of their page."""
    spans = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id", "value")
    return layout.routed(spans, ["user_id", "day"], "value").select("event_id", "side")


@query("SELECT conv_id, segment, count(*) AS lines, string_agg(text, ' ' ORDER BY turn) AS body FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations) WHERE segment > 0 GROUP BY ALL")
def w4_segments(spark, sf_dir):
    """A user's turn opens a segment; the turns behind it are its body."""
    cut = parsing.segments(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return cut.groupBy("conv_id", "segment").agg(F.count("*").alias("lines"), body.alias("body"))


@query("""WITH m AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page,
 max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS final FROM conversations)
SELECT conv_id, turn, coalesce(lead(page) OVER (PARTITION BY conv_id ORDER BY turn), final) AS page FROM m WHERE role = 'user'""")
def w5_page_at_flush(spark, sf_dir):
    """The page of an entry is the one seen when the next begins: assistant turns are the page marks."""
    rows = load(spark, sf_dir, "conversations").withColumn("mark", F.when(F.col("role") == "assistant", F.col("turn")))
    from pyspark.sql import Window

    final = F.max("mark").over(Window.partitionBy("conv_id"))
    seen = parsing.carried(rows, ["conv_id"], "turn", "mark", "seen").withColumn("final", final).where("role = 'user'")
    return parsing.page_at_flush(seen, ["conv_id"], "turn", "seen", "final", "page").select("conv_id", "turn", "page")


#: The queries' grammar marks by p_size modulo 5, as written and as stored.
_MARKS = ("m.", "f.", "adj.", "v. tr.", "")


def _flat(spark, sf_dir):
    """Flat entries whose parts are known from the part they were built of."""
    mark = F.get(F.array(*[F.lit(m) for m in _MARKS]), F.col("p_size") % 5)
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", mark.alias("mark"))


@query("""WITH p AS (SELECT *, ['m.', 'f.', 'adj.', 'v. tr.', ''][p_size % 5 + 1] AS mark FROM part)
SELECT p_partkey, p_name AS word, CASE WHEN mark = '' THEN '' WHEN mark = 'v. tr.' THEN 'v' ELSE replace(mark, '.', '') END AS grammar,
 CASE WHEN mark = 'v. tr.' THEN 'tr., ' ELSE '' END || lower(p_type) || ' ' || p_brand AS definition FROM p""")
def p6_split_entries(spark, sf_dir):
    """Headword, grammar and definition of first lines of one span; "v. tr." is taken as "v.", as the shorter mark comes first."""
    rows = _flat(spark, sf_dir)
    line = F.concat(F.lit("1. "), F.col("p_name"), F.when(F.col("mark") == "", " : ").otherwise(F.concat(F.lit(", "), F.col("mark"), F.lit(", "))), F.lower("p_type"), F.lit(" "), F.col("p_brand"))
    span = F.struct(line.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("Times").alias("font"), F.lit(10.0).alias("x0"), F.lit(90.0).alias("x1"))
    out = rows.withColumn("e", parsing.split_entry(F.array(span), F.lit(2)))
    return out.select("p_partkey", "e.word", "e.grammar", "e.definition")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_type) || ' ' || p_brand ELSE 'x' || p_brand END AS definition, length(p_name) > 60 OR length(CASE WHEN p_size % 2 = 0 THEN lower(p_type) || ' ' || p_brand ELSE 'x' || p_brand END) < 5 AS needs_review FROM part""")
def p7_build_entries(spark, sf_dir):
    """A headword that the definition repeats is taken off it."""
    d = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" , "), F.lower("p_type"), F.lit(" "), F.col("p_brand"))).otherwise(F.concat(F.lit("x"), F.col("p_brand")))
    definition, review = parsing.build_entry("p_name", d)
    return load(spark, sf_dir, "part").select("p_partkey", definition.alias("definition"), review.alias("needs_review"))


@query("""WITH p AS (SELECT *, p_size % 5 AS m FROM part)
SELECT p_partkey, p_name AS mot, ['nom', 'nom', 'adj', 'v. tr', ''][m + 1] AS categorie, ['masculin', 'féminin', '', '', ''][m + 1] AS genre, 'abc' AS prononciation, 'from ' || p_brand AS origine,
 CASE WHEN p_size % 2 = 0 THEN 'fig|techn' ELSE '' END AS domaines,
 CASE WHEN p_size % 2 = 0 THEN 'fig. techn. ' ELSE '' END || lower(p_type) || '|big ' || lower(p_type) AS definitions,
 '~ di fier=' || p_brand || '/~ tot seu=' AS exemples, 'fiestî|moussî' AS synonymes, 'bwès|pîre' AS renvois, 'voy. bwès, pîre, la cour, bwès|syn. fiestî, moussî' AS variantes, CAST(p_size AS VARCHAR) AS page FROM p""")
def p8_restructure(spark, sf_dir):
    """Nested entries, arrays shown as text."""
    rows = _flat(spark, sf_dir)
    domain = F.when(F.col("p_size") % 2 == 0, "fig. techn. ").otherwise("")
    kind = F.lower("p_type")
    text_ = F.concat(F.lit("[abc] "), domain, kind, F.lit(", big "), kind, F.lit(" : — di fier, "), F.col("p_brand"), F.lit(" ; – tot seu | voy. bwès, pîre, la cour, bwès | syn. fiestî, moussî [from "), F.col("p_brand"))
    flat = rows.select("p_partkey", F.col("p_name").alias("word"), text_.alias("definition"), F.rtrim(F.col("mark"), F.lit(".")).alias("grammar"), F.lit("wallon-francais").alias("type"), F.lit(2).alias("tome"), F.col("p_size").alias("page"), F.lit("s").alias("slice"))
    out = restructure.restructure(flat)
    joined = lambda c: F.array_join(c, "|").alias(c)
    examples = F.array_join(F.transform("exemples", lambda e: F.concat(e["wallon"], F.lit("="), e["francais"])), "/").alias("exemples")
    return out.select("p_partkey", "mot", "categorie", "genre", "prononciation", "origine", joined("domaines"), joined("definitions"), examples, joined("synonymes"), joined("renvois"), joined("variantes"), "page")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'voy. ' || p_name WHEN 1 THEN 'syn. ' || p_brand ELSE lower(p_type) END AS definitions FROM part""")
def p8_fallback_definition(spark, sf_dir):
    """Entries of references or synonyms alone keep their whole text as the definition."""
    body = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("voy. "), "p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("syn. "), "p_brand")).otherwise(F.lower("p_type"))
    flat = load(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("word"), body.alias("definition"), F.lit("m").alias("grammar"), F.lit("wallon-francais").alias("type"), F.lit(2).alias("tome"), F.lit(1).alias("page"))
    out = restructure.restructure(flat)
    return out.select("p_partkey", F.array_join("definitions", "|").alias("definitions"))


@query("""SELECT p_partkey, 'nom' AS categorie, lower(p_type) AS definition, 'francais ' || p_brand AS francais, 'wallon' AS wallon FROM part""")
def p8_restructure_reverse(spark, sf_dir):
    """The other direction: the first piece is the translation, and examples put French first."""
    rows = _flat(spark, sf_dir)
    text_ = F.concat(F.lit("f. "), F.lower("p_type"), F.lit(" ; francais "), F.col("p_brand"), F.lit(", wallon ; cf. bwès"))
    flat = rows.select("p_partkey", F.col("p_name").alias("word"), text_.alias("definition"), F.lit("").alias("grammar"), F.lit("francais-wallon").alias("type"), F.lit(3).alias("tome"), F.lit(1).alias("page"))
    out = restructure.restructure(flat)
    example = F.get("exemples", 0)
    return out.select("p_partkey", "categorie", F.array_join("definitions", "|").alias("definition"), example["francais"].alias("francais"), example["wallon"].alias("wallon"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tome2-' || (doc_id % 40) || '.pdf' WHEN doc_id % 3 = 1 THEN 'tome3-' || (doc_id % 40) || '.pdf' ELSE 'other.pdf' END AS name FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS tome, CAST(CASE WHEN doc_id % 3 = 2 THEN 0 ELSE doc_id % 40 END AS INTEGER) AS number, CASE WHEN doc_id % 3 = 1 THEN 'francais-wallon' ELSE 'wallon-francais' END AS type FROM f""")
def p1_file_meta(spark, sf_dir):
    n = (F.col("doc_id") % 40).cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tome2-"), n, F.lit(".pdf"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("tome3-"), n, F.lit(".pdf"))).otherwise("other.pdf")
    tome, number, kind = parsing.file_meta(name)
    return load(spark, sf_dir, "documents").select("doc_id", tome.alias("tome"), number.alias("number"), kind.alias("type"))


@query("""WITH t AS (SELECT doc_id, ' ' || regexp_replace(left(text, 2000), '[^a-zA-Z0-9À-ÿ_]+', '  ', 'g') || ' ' AS x FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(x, ' (li|èl|nos|vos|dj|dji) ')) > len(regexp_extract_all(x, ' (le|la|les|un|une|des|il|elle) ')) THEN 'wallon-francais' ELSE 'francais-wallon' END AS type FROM t""")
def p3_direction(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", parsing.direction("text", F.lit("")).alias("type"))


@query("""WITH b AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS t FROM documents), u AS (SELECT doc_id, CAST(generate_subscripts(bs, 1) - 1 AS INTEGER) AS block, unnest(bs) AS b FROM (SELECT doc_id, regexp_split_to_array(t, '\\n\\n+') AS bs FROM b)),
l AS (SELECT doc_id, block, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM u)
SELECT doc_id, block, rtrim(ls[1], '.,;:') AS word, array_to_string(ls[2:], ' ') AS definition FROM l WHERE len(ls) >= 2 AND length(rtrim(ls[1], '.,;:')) BETWEEN 2 AND 80 AND regexp_matches(array_to_string(ls[2:], ' '), '[a-záàâéèêëîïôùûüœæçDJ]')""")
def p15_paragraphs(spark, sf_dir):
    """Blocks whose first line is the headword."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")).alias("text"))
    return parsing.paragraphs(rows, ["doc_id"], "text").select("doc_id", "block", "word", "definition")


#: Documents as files: of some the patterns find most entries, of others the blocks; digits, short words and table heads are among the headwords.
RAW_FILE = """CASE doc_id % 4 WHEN 0 THEN replace(replace(text, '. ', chr(10)), ', ', chr(160) || ': ' || chr(160)) WHEN 1 THEN replace(text, '. ', '.' || chr(10) || chr(10) || '--- PAGE ' || doc_id || ' ---' || chr(10) || chr(10) || 'Page : x' || chr(10) || '12 - y' || chr(10))
 WHEN 2 THEN replace(text, ', ', chr(10) || 'ÉTÉ de ') ELSE replace(text, '. ', ' — ') END"""
SQL_FILE_ENTRIES = f"""WITH f AS (SELECT doc_id, {sql_clean(f"regexp_replace({RAW_FILE}, '{parsing.PAGE_BREAK}', chr(10) || chr(10), 'g')")} AS t FROM documents),
m AS (SELECT doc_id, t, {', '.join(f"regexp_extract_all(t, '(?m){sql_pattern(p)}', {i}) AS {'abc'[n]}{i}" for n, p in enumerate(parsing.ENTRY_PATTERNS) for i in (1, 2))} FROM f),
h AS (SELECT doc_id, t, CASE WHEN len(a1) >= len(b1) AND len(a1) >= len(c1) THEN list_zip(a1, a2) WHEN len(b1) >= len(c1) THEN list_zip(b1, b2) ELSE list_zip(c1, c2) END AS found FROM m),
e AS (SELECT doc_id, t, list_filter(list_transform(found, lambda x: {{'word': rtrim(trim(x[1]), '.,;:'), 'definition': trim(x[2])}}), lambda x: length(x.word) BETWEEN 2 AND 80 AND length(x.definition) >= 2 AND NOT regexp_full_match(x.word, '[0-9]+') AND lower(x.word) NOT IN ('page', 'liégeois', 'français', 'wallon', 'traduction')) AS a,
 list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(t, '\\n\\n+'), lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda y: trim(y)), lambda y: y <> '')), lambda ls: len(ls) >= 2), lambda ls: {{'word': rtrim(ls[1], '.,;:'), 'definition': array_to_string(ls[2:], ' ')}}),
  lambda x: length(x.word) BETWEEN 2 AND 80 AND regexp_matches(x.definition, '{parsing.BLOCK_LETTER}')) AS b FROM h)"""


def _files(spark, sf_dir):
    text_, number = F.col("text"), F.col("doc_id").cast("string")
    put = lambda x, a, b: F.replace(x, F.lit(a), b if not isinstance(b, str) else F.lit(b))
    body = (
        F.when(F.col("doc_id") % 4 == 0, put(put(text_, ". ", "\n"), ", ", "\u00a0: \u00a0"))
        .when(F.col("doc_id") % 4 == 1, put(text_, ". ", F.concat(F.lit(".\n\n--- PAGE "), number, F.lit(" ---\n\nPage : x\n12 - y\n"))))
        .when(F.col("doc_id") % 4 == 2, put(text_, ", ", "\nÉTÉ de "))
        .otherwise(put(text_, ". ", " — "))
    )
    return load(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


@query(SQL_FILE_ENTRIES + ", u AS (SELECT doc_id, unnest(a) AS x, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS place FROM e) SELECT doc_id, place, x.word AS word, x.definition AS definition FROM u")
def p14_pattern_entries(spark, sf_dir):
    """Headwords and definitions of whole files by the pattern that fits most."""
    whole = _files(spark, sf_dir).select("doc_id", text.clean(F.regexp_replace("text", parsing.PAGE_BREAK, "\n\n")).alias("text"))
    found = parsing.with_pattern_entries(whole, "text", "found")
    # an expression, not the column: for a column Spark would infer a filter that runs the patterns again
    return found.select("doc_id", F.posexplode(F.array_compact("found")).alias("place", "e")).select("doc_id", "place", "e.word", "e.definition")


@query(SQL_FILE_ENTRIES + """, c AS (SELECT doc_id, CASE WHEN len(a) >= len(b) THEN 'patterns' ELSE 'blocks' END AS parser, CASE WHEN len(a) >= len(b) THEN a ELSE b END AS es FROM e),
u AS (SELECT doc_id, parser, unnest(es) AS x, CAST(generate_subscripts(es, 1) - 1 AS INTEGER) AS place FROM c) SELECT doc_id, parser, place, x.word AS word, x.definition AS definition FROM u""")
def p16_file_entries(spark, sf_dir):
    """The entries of whichever parser finds more in a file."""
    return parsing.file_entries(_files(spark, sf_dir), ["doc_id"], "text")


#: One first line for each way to split an entry, and the parts that it must give.
def _first_lines():
    name, brand = F.col("p_name"), F.col("p_brand")
    make = lambda text_, italic=False, bold=False, x0=10.0, font="Times": F.struct(text_.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic"), F.lit(font).alias("font"), F.lit(x0).alias("x0"), F.lit(x0 + 80).alias("x1"))
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return [
        (2, F.array(make(say("3. ", name, ", seul dans li cas, adj. : ", brand)))),
        (2, F.array(make(say(name, ", seul* dans li cas ; ", brand)))),
        (2, F.array(make(say("2. ", name), italic=True), make(say(brand, " tot"), x0=95.0))),
        (2, F.array(make(say("bwès, ", brand), font="Times"))),
        (2, F.array(make(say(brand, " ", name), font="Times"))),
        (3, F.array(make(say(name, ", ")), make(brand, bold=True, x0=95.0), make(say("plain"), x0=180.0))),
        (3, F.array(make(say(name, ".")), make(brand, font="Times-Bold", x0=95.0))),
        (9, F.array(make(name))),
    ]


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 3 THEN 'bwès' WHEN 4 THEN p_brand ELSE p_name END AS word, CASE p_size % 8 WHEN 0 THEN 'adj' ELSE '' END AS grammar,
 CASE p_size % 8 WHEN 0 THEN ', seul dans li cas : ' || p_brand WHEN 1 THEN ', seul* dans li cas : ' || p_brand WHEN 2 THEN p_brand || ' tot' WHEN 4 THEN p_name WHEN 5 THEN p_brand || ' plain' WHEN 7 THEN '' ELSE p_brand END AS definition FROM part""")
def p6_split_branches(spark, sf_dir):
    """Entries split by a mark or colon with a limited use, by style, by a short word, by the first token, and in the other direction by bold type."""
    cases = _first_lines()
    at = F.col("p_size") % len(cases)
    spans, tome = F.get(F.array(*[x for _, x in cases]), at), F.get(F.array(*[F.lit(t) for t, _ in cases]), at)
    out = load(spark, sf_dir, "part").withColumn("e", parsing.split_entry(spans, tome))
    return out.select("p_partkey", "e.word", "e.grammar", "e.definition")


@query("SELECT p_partkey, p_size % 12 IN (0, 2, 4, 7, 8, 11) AS starts FROM part")
def f2_start_branches(spark, sf_dir):
    """First lines by style, mark, colon and short word, and lines that are none: bold or plain ones, captions, page numbers, marks."""
    name = F.col("p_name")
    make = lambda text_, italic=False, bold=False, font="Times", x0=142.0: F.struct(text_.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic"), F.lit(font).alias("font"), F.lit(x0).alias("x0"), F.lit(x0 + 50).alias("x1"))
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    cases = [
        (2, F.array(make(name, italic=True))),
        (2, F.array(make(name))),
        (2, F.array(make(say(name, " : x")))),
        (2, F.array(make(say("Fig. 3 : ", name), italic=True))),
        (2, F.array(make(say("1. ", name), font="Times-Italic"))),
        (2, F.array(make(say("— ", name), italic=True))),
        (2, F.array(make(say("XIV ", name), italic=True))),
        (3, F.array(make(name), make(name, bold=True, x0=200.0))),
        (3, F.array(make(name), make(name, font="Arial-BOLD", x0=200.0))),
        (3, F.array(make(name, bold=True), make(name, bold=True, x0=200.0))),
        (3, F.array(make(name), make(name, x0=200.0))),
        (2, F.array(make(say("bwès, ", name)))),
    ]
    at = F.col("p_size") % len(cases)
    spans, tome = F.get(F.array(*[x for _, x in cases]), at), F.get(F.array(*[F.lit(t) for t, _ in cases]), at)
    return load(spark, sf_dir, "part").select("p_partkey", parsing.entry_start(spans, F.lit(130.0), tome).alias("starts"))


def _dictionary_lines(spark, sf_dir):
    """Parts as first lines with a second line each, in two columns of a page."""
    rows = load(spark, sf_dir, "part")
    mark = F.get(F.array(F.lit("m."), F.lit("f."), F.lit("adj.")), F.col("p_partkey") % 3)
    span = lambda x, x0: F.array(F.struct(x.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("Times").alias("font"), F.lit(x0).alias("x0"), F.lit(x0 + 90).alias("x1")))
    first = span(F.concat(F.when(F.col("p_partkey") % 5 == 0, F.initcap("p_name")).otherwise(F.col("p_name")), F.lit(", "), mark, F.lit(", awe "), F.lower("p_type")), 140.0)
    both = F.array(F.struct(F.lit(0).alias("part"), first.alias("spans")), F.struct(F.lit(1).alias("part"), span(F.lower("p_brand"), 130.0).alias("spans")))
    lines = rows.select("p_partkey", F.lit("tome2-08.pdf").alias("slice"), F.lit(2).alias("tome"), F.col("p_size").alias("page"), F.when(F.col("p_partkey") % 2 == 0, "left").otherwise("right").alias("column"), F.explode(both).alias("l"))
    return lines.select("slice", "tome", "page", "column", (F.col("p_partkey") * 2 + F.col("l.part")).alias("line_no"), "l.spans", F.lit(130.0).alias("margin"))


SQL_DICTIONARY = """WITH e AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE p_name END AS word, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS col FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(word), p_size ORDER BY col, p_partkey) AS n FROM e)
SELECT word AS mot, p_size AS page, col, p_partkey % 3 AS mark, 'åwe ' || lower(p_type) || ' ' || lower(p_brand) AS body FROM k WHERE n = 1"""


@query(f"""SELECT mot, CAST(page AS VARCHAR) AS page, CASE WHEN mark = 2 THEN 'adj' ELSE 'nom' END AS categorie, CASE mark WHEN 0 THEN 'masculin' WHEN 1 THEN 'féminin' ELSE '' END AS genre, body AS definitions, 'wallon-francais' AS type FROM ({SQL_DICTIONARY})""")
def flow_dictionary(spark, sf_dir):
    """The whole way: lines, entries, correction, one entry for a headword and page, nested entries."""
    flat = flow.flat_entries(_dictionary_lines(spark, sf_dir), [("awe", "åwe")])
    return flow.nested_entries(flat).select("mot", "page", "categorie", "genre", F.array_join("definitions", "|").alias("definitions"), "type")


@query(f"""SELECT mot AS word, page, CASE mark WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'adj' END AS grammar, body AS definition FROM ({SQL_DICTIONARY})""")
def flow_incremental(spark, sf_dir):
    """Flat entries after two runs: the first had no third of the pages and others otherwise; the second makes only these anew."""
    store = increments.GroupStore(spark, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", ["tome", "page"])
    lines = _dictionary_lines(spark, sf_dir)
    old = lines.where("page % 3 > 0 and not (page % 4 = 0 and line_no % 3 = 0)")
    for state in (old, lines):
        make = lambda groups: flow.flat_entries(state.join(groups, ["tome", "page"], "left_semi"), [("awe", "åwe")])  # noqa: B023, E731
        store.run(increments.digest(state, ["slice", "tome", "page"]), make)
    return store.current().select("word", "page", "grammar", "definition")


@query(f"SELECT * FROM (SELECT mot AS word, page, CAST(row_number() OVER (ORDER BY page, lower(mot), col) AS INTEGER) AS rank FROM ({SQL_DICTIONARY})) WHERE rank <= 200")
def o1_dictionary_order(spark, sf_dir):
    """The first entries by tome, page and lower-cased headword."""
    flat = flow.flat_entries(_dictionary_lines(spark, sf_dir), [("awe", "åwe")])
    return ranking.page(flat, flow.dictionary_order(), 200).select("word", "page", "rank")


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ ')) AS a, len(regexp_extract_all(text, '[a-z]+, ')) AS b, len(regexp_extract_all(text, '[|] ')) AS c FROM documents)
SELECT doc_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS pattern FROM c""")
def p14_best_pattern(spark, sf_dir):
    """The pattern with most matches; the first of equals."""
    return load(spark, sf_dir, "documents").select("doc_id", parsing.best_pattern("text", ["[A-Z][a-z]+ ", "[a-z]+, ", "[|] "]).alias("pattern"))


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents WHERE length(text) > 1500 GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source)
SELECT source, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS rows, CASE WHEN coalesce(a.n, 0) >= coalesce(b.n, 0) THEN 'first' ELSE 'second' END AS chosen FROM a FULL JOIN b USING (source)""")
def p16_best_parser(spark, sf_dir):
    """Of two results of a file the one with more rows."""
    docs = load(spark, sf_dir, "documents").select("source", "lang", F.length("text").alias("n"))
    return parsing.best_of(docs.where("n > 1500"), docs.where("lang = 'en'"), "source")


@query("SELECT event_id, (value >= 58 AND value <= 420 AND NOT regexp_full_match(CAST(event_id AS VARCHAR), '[0-9]{1,3}')) AS kept FROM events")
def f1_text_area(spark, sf_dir):
    """Header and footer lines, and page numbers alone."""
    kept = layout.in_text_area(F.col("value") + 100, F.concat(F.when(F.col("event_id") < 1000, "").otherwise("n"), F.col("event_id").cast("string")))
    return load(spark, sf_dir, "events").select("event_id", (kept & (F.col("value") <= 420)).alias("kept"))


@query("SELECT conv_id, string_agg(x, '' ORDER BY turn) AS text FROM (SELECT conv_id, CASE WHEN turn % 2 = 1 THEN ' ' ELSE '' END || role AS x, turn FROM conversations) GROUP BY conv_id")
def p4_line_text(spark, sf_dir):
    """Spans of a line joined with spaces at gaps: odd turns stand apart from the turn before."""
    turn = F.col("turn")
    x0 = turn * 10 + F.when(turn % 2 == 1, 5).otherwise(0)
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.struct(turn.alias("n"), F.col("role").alias("text"), x0.cast("double").alias("x0"), F.when(turn % 2 == 1, turn * 10 + 10).otherwise(turn * 10 + 10).cast("double").alias("x1")).alias("span"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("conv_id", layout.line_text("spans").alias("text"))


@query("SELECT conv_id, string_agg(turn || ':' || role || ':' || (turn % 2 = 0) || ':' || (turn % 3 = 0), '|' ORDER BY turn) AS spans FROM conversations GROUP BY conv_id")
def p5_rich_lines(spark, sf_dir):
    """Spans narrowed to text and style."""
    turn = F.col("turn")
    span = F.struct(turn.alias("n"), F.concat(turn.cast("string"), F.lit(":"), F.col("role")).alias("text"), (turn % 2 == 0).alias("bold"), (turn % 3 == 0).alias("italic"), (turn * 10.0).alias("x0"))
    lines = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    shown = F.transform(layout.rich_line("spans"), lambda s: F.concat_ws(":", s["text"], s["bold"].cast("string"), s["italic"].cast("string")))
    return lines.select("conv_id", F.array_join(shown, "|").alias("spans"))


@query("""SELECT p_partkey, (p_size % 3 <> 0) AND p_size % 4 <> 0 AS starts FROM part""")
def f2_entry_starts(spark, sf_dir):
    """Lines that begin entries: indented ones with a grammar mark."""
    line = F.concat(F.col("p_name"), F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.lit(", m., ")), F.lit(" word"))
    span = F.struct(line.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("Times").alias("font"), F.when(F.col("p_size") % 3 == 0, 130.0).otherwise(142.0).alias("x0"), F.lit(250.0).alias("x1"))
    return load(spark, sf_dir, "part").select("p_partkey", parsing.entry_start(F.array(span), F.lit(130.0), F.lit(2)).alias("starts"))


@query("SELECT doc_id, trim(regexp_replace(replace(replace(text, ' the ', ' l''å-the '), ' and ', ' Å_9 '), '[^a-zA-ZåÅàâéèêëîïôùûüçœæ\\-'']', '', 'g')) AS stripped FROM documents")
def n14_reply_letters(spark, sf_dir):
    """Replies reduced to letters, hyphens and apostrophes."""
    reply = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" l'å-the ")), F.lit(" and "), F.lit(" Å_9 "))
    return load(spark, sf_dir, "documents").select("doc_id", text.reply_letters(reply).alias("stripped"))


def _sql_decomposed(x: str) -> str:
    for letter, parts in text.DECOMPOSED.items():
        if letter.islower() and ord(letter) < 0x180:
            x = f"replace({x}, '{letter}', '{parts}')"
    return x


@query(f"""SELECT * FROM (SELECT doc_id, word, CAST(row_number() OVER (ORDER BY {_sql_decomposed('lower(word)')}, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, split_part(text, ' ', 1) AS word FROM documents)) WHERE rank <= 50""")
def o2_decomposed_order(spark, sf_dir):
    """The first page of headwords by their decomposed form, which keeps accents next to their base letters."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", " "), 0).alias("word"))
    return ranking.page(rows, [text.decomposed(F.lower("word")).asc(), F.col("doc_id").asc()], 50)
