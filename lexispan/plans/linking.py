"""Joins, lookups, set operations and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, rules
from .registration import load, query, sql_pattern

#: Rules of the queries, in order.
RULES = [("the", "thé"), ("and", "ånd"), ("reon", "réon"), ("éon", "eôn")]
VALUES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(RULES))
HEAD = "split_part(text, ' ', 1)"
BORDER = rules.LETTERS


def _rules(spark, rows=RULES):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "ord int, key string, val string")


#: Headwords with each kind of end behind the first token; some have a number in front, some marks, and "of" is a key that is too short.
TOKEN_RULES = [*RULES, ("of", "òf"), ("that", "thåt")]
TOKEN_VALUES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TOKEN_RULES))
HEADS, ENDS, FRONTS = ("The", "of", "THAT", "a and"), (". x", "/x", " \u00bb", "\u00a0x", "! the", "\\x"), ("", "3. ", "\u00ab", "12.\u00a0")
SQL_WORDS = f"""SELECT doc_id, CASE doc_id // 24 % {len(FRONTS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FRONTS))} END || CASE doc_id % {len(HEADS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(HEADS))} END
 || CASE doc_id // 4 % {len(ENDS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ENDS))} END || {HEAD} AS word FROM documents"""


def _words(spark, sf_dir):
    pick = lambda xs, by: F.get(F.array(*[F.lit(x) for x in xs]), (by % len(xs)).cast("int"))
    i = F.col("doc_id")
    word = F.concat(pick(FRONTS, F.floor(i / 24)), pick(HEADS, i), pick(ENDS, F.floor(i / 4)), F.get(F.split("text", " "), 0))
    return load(spark, sf_dir, "documents").select("doc_id", word.alias("word"))


def _sql_token(ends: str, filled: bool = False) -> str:
    ends, spaces = sql_pattern(ends), sql_pattern(text.SPACES)
    base = f"regexp_replace(word, '^[0-9]+\\.[{spaces}]*', '')"
    token = f"lower(regexp_split_to_array({f"regexp_replace({base}, '^[{spaces}{ends}]+', '')" if filled else base}, '[{spaces}{ends}]')[1])"
    return f"""WITH r(ord, key, val) AS (VALUES {TOKEN_VALUES}), t AS (SELECT doc_id, word, {base} AS rest, {token} AS token FROM ({SQL_WORDS}))
SELECT doc_id, CASE WHEN val IS NOT NULL AND lower(left(rest, length(token))) = token THEN left(word, length(word) - length(rest)) || val || substr(rest, length(token) + 1) ELSE word END AS fixed, val IS NOT NULL AS matched FROM t LEFT JOIN r ON token = key AND length(key) >= 3"""


@query(_sql_token(text.RULE_ENDS))
def j1_token_fix(spark, sf_dir):
    """The leading token by exact rules, behind a homograph number and up to any of its ends."""
    return rules.fix_first_token(_words(spark, sf_dir), _rules(spark, TOKEN_RULES), "word").select("doc_id", F.col("word").alias("fixed"), "matched")


@query(_sql_token(text.LAST_ENDS, filled=True))
def j1_last_token_fix(spark, sf_dir):
    """The last pass: more ends, and the first token that isn't empty is looked up; it is rewritten at the front alone."""
    return rules.fix_first_token(_words(spark, sf_dir), _rules(spark, TOKEN_RULES), "word", rules.LAST_FORM).select("doc_id", F.col("word").alias("fixed"), "matched")


@query(f"""WITH r(ord, key, val) AS (VALUES {TOKEN_VALUES}), w AS (SELECT doc_id, word, lower(regexp_split_to_array(word, '[{sql_pattern(text.SPACES + text.RULE_ENDS.replace("/", ""))}]')[1]) AS token FROM ({SQL_WORDS})),
a AS (SELECT doc_id, word, CASE WHEN val IS NOT NULL AND contains(word, token) THEN left(word, strpos(word, token) - 1) || val || substr(word, strpos(word, token) + length(token)) ELSE word END AS first FROM w LEFT JOIN r ON token = key),
f AS (SELECT doc_id, ord, key, left(word, strpos(lower(word), key) - 1) || val || substr(word, strpos(lower(word), key) + length(key)) AS fixed, word FROM a JOIN r ON first = word AND contains(lower(word), key) AND left(translate(lower(word), 'å', 'a'), length(key)) <> key),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM f WHERE fixed <> word)
SELECT a.doc_id, a.word AS original, CASE WHEN first <> a.word THEN first ELSE coalesce(h.fixed, a.word) END AS word, CASE WHEN first <> a.word THEN 'first token' WHEN h.key IS NOT NULL THEN 'inside' END AS source, h.key AS rule
FROM a LEFT JOIN h ON h.doc_id = a.doc_id AND h.n = 1""")
def j1_then_j2(spark, sf_dir):
    """Each headword's correction with its source: by the leading token, or else by the first rule inside it."""
    return rules.fix_first_or_contained(_words(spark, sf_dir), _rules(spark, TOKEN_RULES), "word")


#: Rules of two to six letters, in order.
INNER_RULES = [("rin", "rîn"), ("oldie", "ôldie"), ("old", "ôld"), ("steel", "ståel"), ("ed", "êd"), ("copper", "côpper"), ("ing", "ing")]
INNER_VALUES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(INNER_RULES))


@query(f"""WITH r(ord, key, val) AS (VALUES {INNER_VALUES}), w AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'a ' || p_name || 'ie goldie' ELSE p_name END AS word FROM part),
f AS (SELECT p_partkey, ord, key, word, left(word, strpos(lower(word), key) - 1) || val || substr(word, strpos(lower(word), key) + length(key)) AS fixed FROM w JOIN r ON contains(lower(word), key) AND left(translate(lower(word), 'å', 'a'), length(key)) <> key),
h AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS n FROM f WHERE fixed <> word)
SELECT w.p_partkey, h.key, coalesce(h.fixed, w.word) AS fixed FROM w LEFT JOIN h ON w.p_partkey = h.p_partkey AND h.n = 1""")
def j2_contained_rule(spark, sf_dir):
    """The first rule inside each word replaces its first occurrence, in any case; keys have two to six letters, and rows without a rule stay."""
    size, name = F.col("p_size"), F.col("p_name")
    word = F.when(size % 4 == 0, F.upper(name)).when(size % 4 == 1, F.concat(F.lit("a "), name, F.lit("ie goldie"))).otherwise(name)
    rows = load(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    return rules.rewrite_contained(rows, _rules(spark, INNER_RULES), "word").select("p_partkey", "key", "fixed")


def _sql_rewrite(column: str) -> str:
    out = column
    for k, v in sorted(RULES, key=lambda r: -len(r[0])):
        for _ in range(2):  # neighbouring matches share a border
            out = f"regexp_replace({out}, '(^|[^{BORDER}])({k})($|[^{BORDER}])', '\\1{v}\\3', 'gi')"
    return out


@query(f"SELECT doc_id, {_sql_rewrite('text')} AS fixed, {_sql_rewrite('text')} <> text AS changed FROM documents")
def j3_rule_rewrite(spark, sf_dir):
    """Ordered rewriting with cascades; one scan and no shuffle."""
    docs = load(spark, sf_dir, "documents").withColumn("fixed", rules.rewrite("text", RULES))
    return docs.select("doc_id", "fixed", (F.col("fixed") != F.col("text")).alias("changed"))


def _sql_folding(column: str, border: str, vowels: dict[str, str], flags: str = "gi") -> str:
    for k, v in sorted((r for r in RULES if r[0] != r[1].lower()), key=lambda r: -len(r[0])):
        body = "".join(vowels.get(c, c) for c in k).replace("\ufffd", "\\x{FFFD}")
        for _ in range(2):  # neighbouring matches share a border; what is replaced would match again, so a sign stands for it
            column = f"regexp_replace({column}, '(^|[^{border}])({body})($|[^{border}])', '\\1@@\\3', '{flags}')"
        column = f"replace({column}, '@@', '{v}')"
    return column


SQL_STRICT = rules.STRICT.replace("'", "''").replace("\ufffd", "\\x{FFFD}")
SQL_TYPED = rules.TYPED_STRICT.replace("'", "''")
VARIED = "replace(replace(text, ' the ', CASE doc_id % 4 WHEN 0 THEN ' thë ' WHEN 1 THEN ' THÊ ' WHEN 2 THEN ' th'' ' ELSE ' th\ufffd ' END), ' and ', CASE doc_id % 3 WHEN 0 THEN ' änd ' WHEN 1 THEN ' -and ' ELSE ' ånd ' END)"


def _varied():
    """Documents whose common words have other accents, so that each border and letter class is met."""
    the = F.get(F.array(*[F.lit(f" {x} ") for x in ("thë", "THÊ", "th'", "th\ufffd")]), (F.col("doc_id") % 4).cast("int"))
    both = F.get(F.array(*[F.lit(f" {x} ") for x in ("änd", "-and", "ånd")]), (F.col("doc_id") % 3).cast("int"))
    return F.replace(F.replace(F.col("text"), F.lit(" the "), the), F.lit(" and "), both)


@query(f"SELECT doc_id, fixed, fixed <> text AS a_ring_corrected FROM (SELECT doc_id, t AS text, {_sql_folding('t', SQL_STRICT, rules.VOWELS)} AS fixed FROM (SELECT doc_id, {VARIED} AS t FROM documents))")
def j3_folding_rewrite(spark, sf_dir):
    """Rules whose plain vowels stand for accented and damaged ones, between strict borders."""
    docs = load(spark, sf_dir, "documents").select("doc_id", _varied().alias("text"))
    docs = docs.withColumn("fixed", rules.rewrite("text", RULES, rules.STRICT, rules.VOWELS))
    return docs.select("doc_id", "fixed", (F.col("fixed") != F.col("text")).alias("a_ring_corrected"))


@query(f"""WITH e AS (SELECT doc_id, 'the ' || split_part(text, ' ', 1) AS word, {VARIED} AS definition, CASE WHEN doc_id % 2 = 0 THEN 'wallon-francais' ELSE 'francais-wallon' END AS type FROM documents),
f AS (SELECT *, CASE WHEN type = 'wallon-francais' THEN {_sql_folding('word', SQL_TYPED, rules.TYPED_VOWELS)} ELSE word END AS w, {_sql_folding('definition', SQL_TYPED, rules.TYPED_VOWELS)} AS d FROM e)
SELECT doc_id, w AS word, d AS definition, type, w <> word OR d <> definition AS a_ring_corrected FROM f""")
def j3_typed_rewrite(spark, sf_dir):
    """Headwords of the forward direction and all definitions are rewritten."""
    docs = load(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "wallon-francais").otherwise("francais-wallon")
    rows = docs.select("doc_id", F.concat(F.lit("the "), F.get(F.split("text", " "), 0)).alias("word"), _varied().alias("definition"), kind.alias("type"))
    return rules.rewrite_typed(rows, RULES).select("doc_id", "word", "definition", "type", "a_ring_corrected")


@query(f"SELECT count_if(fixed <> text) AS texts, count_if(split_part(fixed, ' ', 1) <> {HEAD}) AS words FROM (SELECT text, {_sql_rewrite('text')} AS fixed FROM documents)")
def a19_correction_totals(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("fixed", rules.rewrite("text", RULES))
    head = lambda c: F.get(F.split(c, " "), 0)
    return docs.agg(F.count_if(F.col("fixed") != F.col("text")).alias("texts"), F.count_if(head("fixed") != head("text")).alias("words"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4_anti(spark, sf_dir):
    """Documents without labels."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j5_semi(spark, sf_dir):
    wanted = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(wanted, "c_custkey", "left_semi")


@query("""WITH w AS (SELECT DISTINCT lower(strip_accents(p_name)) AS ref FROM part WHERE p_size < 6 UNION SELECT 'no such part'), f AS (SELECT lower(strip_accents(p_name)) AS ref, min(p_partkey) AS target FROM part GROUP BY 1)
SELECT w.ref, f.target, f.target IS NOT NULL AS found FROM w LEFT JOIN f ON w.ref = f.ref""")
def j6_lookup(spark, sf_dir):
    """References resolved by folded name to the first entry of that name; the rest go to search."""
    parts = load(spark, sf_dir, "part").withColumn("ref", text.fold("p_name"))
    wanted = parts.where("p_size < 6").select("ref").distinct().union(spark.createDataFrame([("no such part",)], "ref string"))
    found = parts.groupBy("ref").agg(F.min("p_partkey").alias("target"))
    return wanted.join(found, "ref", "left").withColumn("found", F.col("target").isNotNull())


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(length(text)) > 20)")
def j7_present_files(spark, sf_dir):
    """Rows whose file passed an earlier step."""
    docs = load(spark, sf_dir, "documents")
    passed = docs.groupBy("source").agg(F.min(F.length("text")).alias("least")).where("least > 20").select("source")
    return docs.select("doc_id", "source").join(passed, "source", "left_semi")


@query("WITH r(key) AS (VALUES ('the'), ('la'), ('de'), ('er')) SELECT doc_id, key FROM documents JOIN r ON lower(text) = key OR starts_with(lower(text), key || ' ') OR starts_with(lower(text), key || ',')")
def j8_prefix(spark, sf_dir):
    """Keys that are the text's first token, as an equi-join on that token."""
    keys = spark.createDataFrame([("the",), ("la",), ("de",), ("er",)], "key string")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.get(F.split(F.lower("text"), "[ ,]"), 0).alias("key"))
    return docs.join(rules.small(keys), "key").select("doc_id", "key")


@query("""SELECT a.event_id, b.event_id AS other_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.value - b.value) < 0.5 AND a.event_type = 'error' AND b.event_type = 'signup'""")
def j9_band(spark, sf_dir):
    """Pairs of one user's events whose values are near."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    pairs = rules.band_pairs(events.where("event_type = 'error'"), events.where("event_type = 'signup'"), ["user_id"], "value", 0.5)
    return pairs.select("event_id", "other_event_id")


@query("""WITH e AS (SELECT event_id, user_id, value, ts FROM events), n AS (""" + " UNION ALL ".join(f"SELECT event_id, value, {i} AS step, lead(value, {i}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS other FROM e" for i in range(1, 5)) + """)
SELECT event_id, CAST(step AS INTEGER) AS step, other FROM n WHERE abs(value - other) < 3""")
def j10_neighbours(spark, sf_dir):
    """Near values among the next four events of a user."""
    rows = rules.neighbours(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rows.where("abs(value - other) < 3").select("event_id", "step", "other")


@query("""WITH b AS (SELECT p_partkey, p_partkey // 10 AS batch, p_partkey % 10 AS idx FROM part), r AS (SELECT p_partkey // 10 AS batch, p_partkey % 10 AS idx, p_size > 25 AS ok FROM part WHERE p_size % 7 <> 0)
SELECT p_partkey, coalesce(ok, true) AS valid FROM b LEFT JOIN r USING (batch, idx)""")
def j12_batch_replies(spark, sf_dir):
    """Replies joined to their batch places; a row without a reply is valid."""
    parts = load(spark, sf_dir, "part")
    place = [F.expr("p_partkey div 10").alias("batch"), (F.col("p_partkey") % 10).alias("idx")]
    replies = parts.where("p_size % 7 != 0").select(*place, (F.col("p_size") > 25).alias("ok"))
    return parts.select("p_partkey", *place).join(replies, ["batch", "idx"], "left").select("p_partkey", F.coalesce("ok", F.lit(True)).alias("valid"))


@query("SELECT DISTINCT word FROM (SELECT lower(p_name) AS word FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT lower(c_mktsegment) FROM customer)")
def u2_union_distinct(spark, sf_dir):
    parts, customers = load(spark, sf_dir, "part"), load(spark, sf_dir, "customer")
    return parts.select(F.lower("p_name").alias("word")).union(parts.select(F.lower("p_type"))).union(customers.select(F.lower("c_mktsegment"))).distinct()


@query("""WITH s AS (SELECT p_name AS key, 'first' AS val, 0 AS prio, p_partkey AS seq FROM part WHERE p_size < 5 UNION ALL SELECT p_name, p_brand, 1, p_partkey FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, seq) AS r FROM s)
SELECT key, val, seq FROM n WHERE r = 1""")
def u3_priority_merge(spark, sf_dir):
    """Maps merged by key; the earlier source wins, and in a source the first row."""
    parts = load(spark, sf_dir, "part")
    first = parts.where("p_size < 5").select(F.col("p_name").alias("key"), F.lit("first").alias("val"), F.col("p_partkey").alias("seq"))
    second = parts.select(F.col("p_name").alias("key"), F.col("p_brand").alias("val"), F.col("p_partkey").alias("seq"))
    return dedup.merged_by_priority([first, second], "key", "seq")


@query("""SELECT p_name AS key, CASE WHEN max(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) = 1 THEN 'new' ELSE 'old' END AS val FROM part GROUP BY p_name""")
def u4_overwrite_merge(spark, sf_dir):
    """New rules win over old ones."""
    parts = load(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("seq"), "p_size")
    new = parts.where("p_size > 40").select("key", F.lit("new").alias("val"), "seq")
    old = parts.select("key", F.lit("old").alias("val"), "seq")
    return dedup.merged_by_priority([new, old], "key", "seq").select("key", "val")
