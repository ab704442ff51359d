"""Noise filters, post-cleaning, and heuristics over tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import noise, quality
from .registration import load, query, sql_clean, sql_pattern

HEAD = "split_part(text, ' ', 1)"
#: Documents whose sentences become lines, with lines of noise between them that hold no-break spaces.
NOISY = ("12\u00a034", "index\u00a0x", "== x", "[12]", "Additions\u00a0", "table \u2003 des x", "vol. 3", "xiv\u00a0", "12 a")
SQL_NOISY = f"replace(text, '. ', '.' || chr(10) || CASE doc_id % {len(NOISY)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NOISY))} END || chr(10))"
LINES = f"SELECT doc_id, unnest(string_split({SQL_NOISY}, chr(10))) AS line FROM documents"


def _lines(spark, sf_dir):
    noise_between = F.get(F.array(*[F.lit(f".\n{x}\n") for x in NOISY]), (F.col("doc_id") % len(NOISY)).cast("int"))
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.split(F.replace(F.col("text"), F.lit(". "), noise_between), "\n")).alias("line"))


def _sql_noise(patterns, marks) -> str:
    line = f"regexp_replace(line, '^[{sql_pattern(text.SPACES)}]+|[{sql_pattern(text.SPACES)}]+$', '', 'g')"
    return f"WITH l AS (SELECT doc_id, {line} AS line FROM ({LINES})) SELECT doc_id, count(*) AS lines, count_if(length(line) < 2 OR regexp_matches(line, '(?i)(?:{sql_pattern('|'.join(patterns))})') OR regexp_matches(line, '{sql_pattern(marks)}')) AS noise FROM l GROUP BY doc_id"


@query(_sql_noise(noise.NOISE_LINE, noise.DIGITS_AND_MARKS))
def f3_noise_lines(spark, sf_dir):
    """Lines of each document, and how many are noise to the first line parser."""
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(noise.noise_line("line")).alias("noise"))


@query(_sql_noise(noise.NOISE_LINE_LATER, noise.DIGITS_AND_MARKS_LATER))
def f3_noise_lines_later(spark, sf_dir):
    """The same for the second line parser, which takes more lines as noise."""
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(noise.noise_line("line", later=True)).alias("noise"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, {HEAD} AS w, substr(text, length({HEAD}) + 2) AS d FROM documents)
WHERE w = '' OR length(trim(d)) < 3 OR lower(w) = lower(d) OR regexp_matches(w, '(?i)^([0-9]+$|[.\\-_=+*#]{{3,}}$|page|tome|vol\\.|fig\\.|\\s*$|[A-Z]{{1,3}}$)')""")
def f4_noise_entries(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    word = F.get(F.split("text", " "), 0)
    rows = docs.select("doc_id", word.alias("w"), F.substr("text", F.length(word) + 2).alias("d"))
    return rows.where(noise.noise_entry("w", "d")).select("doc_id")


@query(f"""SELECT doc_id, w FROM (SELECT doc_id, {HEAD} AS w, substr(text, length({HEAD}) + 2) AS d FROM documents)
WHERE length(w) BETWEEN 2 AND 100 AND length(trim(d)) >= 3 AND lower(w) <> lower(d) AND NOT regexp_full_match(w, '[0-9]+|[IVXivx]{{1,5}}|[=\\-*.]{{3,}}') AND NOT regexp_matches(w, '(?i)^(table|index|bibliographie|avant-propos|introduction|corrections?|additions?)')
 AND NOT regexp_matches(w, '(?i)^(tome|vol\\.?|fig\\.?)\\s+[0-9]')""")
def f5_quick_filter(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    word = F.get(F.split("text", " "), 0)
    rows = docs.select("doc_id", word.alias("w"), F.substr("text", F.length(word) + 2).alias("d"))
    return rows.where(noise.quick_keep("w", "d")).select("doc_id", "w")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '(' || p_name WHEN p_size % 4 = 1 THEN p_name || ' agacerèye' ELSE replace(p_name, 'o', '£') END AS w,
 CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN '— ; ' || p_brand ELSE p_type END AS d, CASE WHEN p_partkey % 2 = 0 THEN 'francais-wallon' ELSE 'wallon-francais' END AS t FROM part),
k AS (SELECT p_partkey, replace(w, '£', 'e') AS w, d, t FROM e WHERE NOT regexp_matches(w, '^[(\\[\\-—*#0-9]') AND length(w) BETWEEN 2 AND 80),
m AS (SELECT *, t = 'francais-wallon' AND regexp_matches(w, '[âôûîèêëœæ][^ ]*$') AND contains(w, ' ') AS moved FROM k),
c AS (SELECT p_partkey, CASE WHEN moved THEN regexp_replace(w, ' [^ ]*$', '') ELSE w END AS word, trim(regexp_replace(CASE WHEN moved THEN regexp_extract(w, '[^ ]*$') || ' ' || d ELSE d END, '^[—\\-.;,\\s]+', '')) AS definition FROM m)
SELECT * FROM c WHERE length(definition) >= 3""")
def f9_post_clean(spark, sf_dir):
    """Post-cleaning of entries built from parts."""
    size, name = F.col("p_size"), F.col("p_name")
    rows = load(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 4 == 0, F.concat(F.lit("("), name)).when(size % 4 == 1, F.concat(name, F.lit(" agacerèye"))).otherwise(F.translate(name, "o", "£")).alias("word"),
        F.when(size % 3 == 0, "-").when(size % 3 == 1, F.concat(F.lit("— ; "), "p_brand")).otherwise(F.col("p_type")).alias("definition"),
        F.when(F.col("p_partkey") % 2 == 0, "francais-wallon").otherwise("wallon-francais").alias("type"),
    )
    return noise.post_clean(rows).select("p_partkey", "word", "definition")


TOKEN = f"regexp_split_to_array(regexp_replace(trim(lower({HEAD})), '^[0-9]+\\.\\s*', ''), '[\\s,;:()\\[\\]]')[1]"
VARIANT = "left(w, 1) IN ('a', 'à', 'â', 'ä', 'å') AND NOT (starts_with(w, 'av') OR starts_with(w, 'au') OR starts_with(w, 'af'))"


@query(f"SELECT doc_id, w AS token FROM (SELECT doc_id, {TOKEN} AS w FROM documents) WHERE {VARIANT} AND length(w) BETWEEN 4 AND 20 AND NOT contains(w, 'å')")
def f10_suspects(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", text.first_token(F.get(F.split("text", " "), 0)).alias("token"))
    return rows.where(quality.suspect("token"))


@query(f"SELECT doc_id, length(w) BETWEEN 4 AND 25 AND {VARIANT} AND regexp_matches(w, '^[aàâäå][bcdfghjklmnpqrstvwxyz]') AS needs_review FROM (SELECT doc_id, lower({HEAD}) AS w FROM documents)")
def f11_review_flags(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", " "), 0).alias("word"))
    return rows.select("doc_id", quality.review_after_correction("word", F.lit(False)).alias("needs_review"))


@query("SELECT doc_id, regexp_extract(lower(text), '(^|[^a-z])(a(nt|re|nd|le)s?)([^a-z]|$)', 2) AS first_match FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])(a(nt|re|nd|le)s?)([^a-z]|$)')")
def f12_suspect_scan(spark, sf_dir):
    """The first match of a list of doubtful tokens in each text."""
    low, pattern = F.lower("text"), r"(^|[^a-z])(a(nt|re|nd|le)s?)([^a-z]|$)"
    return load(spark, sf_dir, "documents").where(low.rlike(pattern)).select("doc_id", F.regexp_extract(low, pattern, 2).alias("first_match"))


@query("SELECT doc_id, contains(lower(text), 'ring') AS hit, length(text) - length(replace(lower(text), 'the', 'th')) AS shrunk FROM documents WHERE contains(lower(text), 'ring') OR contains(lower(text), 'eau')")
def f15_substring_search(spark, sf_dir):
    low = F.lower("text")
    rows = load(spark, sf_dir, "documents").where(F.contains(low, F.lit("ring")) | F.contains(low, F.lit("eau")))
    return rows.select("doc_id", F.contains(low, F.lit("ring")).alias("hit"), (F.length("text") - F.length(F.replace(low, F.lit("the"), F.lit("th")))).cast("long").alias("shrunk"))


@query("SELECT doc_id, lower(replace(replace(strip_accents(text), 'œ', 'oe'), 'æ', 'ae')) AS folded FROM documents")
def n1_fold(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.fold("text").alias("folded"))


BROKEN = "replace(replace(replace(replace(text, '. ', '-' || chr(10)), ' the ', ' \u0153uvr\ufb01e' || chr(769) || chr(13) || chr(10) || ' '), ', ', chr(160) || chr(10) || chr(10) || chr(9) || chr(10) || chr(10)), 'to ', 'A-' || chr(10) || 'B o' || chr(795))"


def _broken():
    out = F.col("text")
    for a, b in ((". ", "-\n"), (" the ", " \u0153uvr\ufb01e\u0301\r\n "), (", ", "\u00a0\n\n\t\n\n"), ("to ", "A-\nB o\u031b")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@query(f"SELECT doc_id, {sql_clean(BROKEN)} AS cleaned FROM documents")
def n2_clean(spark, sf_dir):
    """Texts with broken words, ligatures, parted letters, line ends of both kinds and blank lines, cleaned."""
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(_broken()).alias("cleaned"))


N3_LETTERS = "a-z\u00e1\u00e0\u00e2\u00e9\u00e8\u00ea\u00eb\u00ee\u00ef\u00f4\u00f9\u00fb\u00fc\u0153\u00e6\u00e7"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(' ' || chr(7) || chr(9) || {BROKEN}), '\ufb01', 'fi'), '([A-Z{N3_LETTERS}])-\\n([{N3_LETTERS}])', '\\1\\2', 'g'), '[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g') AS cleaned FROM documents""")
def n3_normalized(spark, sf_dir):
    """The same texts in the lighter normal form: ends and digraphs are kept, control characters aren't."""
    return load(spark, sf_dir, "documents").select("doc_id", text.normalized(F.concat(F.lit(" \x07\t"), _broken())).alias("cleaned"))
