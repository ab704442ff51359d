"""SpotSigs fingerprints: chains of content words after common words, as DataFrame expressions alone."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import SharedTable

#: The anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of to in and is was be by for with that this are it as on at from or not have has "
    "der die das den dem des ein eine und zu mit von ist nicht auf für als sich "
    "le la les un une et est que qui dans pour par sur au du de "
    "el los las una y en por con para se su como del"
).split()
#: Ids of a range of the document order, and most ranges; past 134 million documents a range grows with the table (40,000 documents of 5 billion).
RANGE, MOST_RANGES = 1024, 1 << 17
LOWEST = -(1 << 63)


def spot_hash(spot: F.Column) -> F.Column:
    """60 bits of a spot's MD5, which any SQL engine can compute."""
    return F.conv(F.substring(F.md5(spot), 1, 15), 16, 10).cast("long")


def with_signatures(rows: DataFrame, text: str, into: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """The input with the sorted distinct spot hashes of a text column, an array of longs.

    A spot is an anchor and the next two words that are no anchors; words are runs of
    letters and digits in lower case, and words of any number between anchor and chain
    may be anchors themselves. A text without a whole chain (empty, null, or very short)
    has one signature: that of its word sequence.
    """
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    out = rows.withColumn("__words", F.concat(F.trim(words), F.lit(" ")))
    # a step is any number of anchors, each with a space, and the content word behind them;
    # possessive, so that long runs of anchors don't recurse
    step = f"(?<![^ ])((?:(?:{'|'.join(anchors)}) )*+)([^ ]+) "
    out = out.withColumn("__steps", F.regexp_extract_all("__words", F.lit(step), F.lit(0)))
    out = out.withColumn("__content", F.transform("__steps", lambda s: F.substring_index(F.rtrim(s), " ", -1)))
    spots = F.transform(
        "__steps",
        lambda s, i: F.when(
            F.get("__content", i + 1).isNotNull() & (F.instr(s, " ") < F.length(s)),
            F.transform(
                F.split(F.rtrim(s), " "),
                lambda w: F.when(w != F.get("__content", i), spot_hash(F.concat_ws(":", w, F.get("__content", i), F.get("__content", i + 1)))),
            ),
        ),
    )
    found = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array_compact(spots)))))
    out = out.withColumn("__spots", found)
    return out.withColumn(into, F.when(F.size("__spots") > 0, F.col("__spots")).otherwise(F.array(spot_hash(F.col("__words"))))).drop("__words", "__steps", "__content", "__spots")


def set_key(column: str) -> F.Column:
    """A short string that is equal for equal signature sets."""
    return F.md5(F.array_join(F.col(column).cast("array<string>"), ","))


def pruned_jaccard(a: str, b: str, least: float | Fraction = 0) -> F.Column:
    """Jaccard likeness of two signature sets, or 0 without comparing them where their sizes alone keep it under `least`, which is compared in whole numbers."""
    bound = Fraction(str(least))
    small, large = F.least(F.size(a), F.size(b)).cast("long"), F.greatest(F.size(a), F.size(b)).cast("long")
    shared = F.size(F.array_intersect(a, b))
    return F.when(small * F.lit(bound.denominator) < large * F.lit(bound.numerator), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def document_ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Upper ids of ranges of about RANGE rows each in descending order; the first is the highest id (null ids rank lowest)."""
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(LOWEST)).alias("id"))
    n, top = ids.agg(F.count("*"), F.max("id")).first()
    parts = min(MOST_RANGES, -(-n // RANGE))
    if parts <= 1:
        return [top] if n else []
    cuts = ids.agg(F.percentile_approx("id", _constants([i / parts for i in range(1, parts)], "double"), 10 * parts)).first()[0]
    return sorted({top, *cuts}, reverse=True)


def _constants(values: list, kind: str) -> F.Column:
    """An array of constants as one literal, which is folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """The input with `next_*` of the carried columns: those of the next row by descending id; after the last, of the first.

    Ranges of ids are ordered each on its own, and each gets the first rows of the next
    range as sentinels at its end, so no task orders all rows. Equal ids are ordered by
    a hash of the first carried column.
    """
    uppers = document_ranges(docs, id_col)
    if not uppers:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    bounds = _constants(uppers, "bigint")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(uppers).bit_length()))])
    rows = docs.withColumn("__id", F.coalesce(F.col(id_col), F.lit(LOWEST)))
    # the last range whose upper id isn't below the row's, by binary search
    rows = rows.withColumn("__range", F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s) >= F.col("__id"), at + s).otherwise(at)))
    ahead = F.pmod(F.col("__range") - 1, F.lit(len(uppers)))
    places = F.when(F.get(bounds, F.col("__range")) == F.col("__id"), F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("s")), F.struct(ahead.alias("r"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("s"))))
    rows = rows.withColumn("__at", F.explode(places)).withColumns({"__range": F.col("__at.r"), "__sentinel": F.col("__at.s")}).drop("__at")
    order = Window.partitionBy("__range").orderBy("__sentinel", F.desc("__id"), F.xxhash64(carried[0]))
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("__sentinel = 0").drop("__id", "__range", "__sentinel")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness; see the columns' contract.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document's, by descending id; the last document's next is the first.
    A single row is its own next. Null texts count as empty; an empty text is edited to
    itself. Very long texts are taken whole. Repeated rows follow each other. Ids are whole numbers: other types are cast to
    long, which raises for text that is no number, and null ids rank lowest. Other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_signatures(rows, "text", "sigs"), "id", ["text", "sigs"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        set_key("sigs").alias("fingerprint"),
        set_key("edited_sigs").alias("edited_fingerprint"),
        pruned_jaccard("sigs", "edited_sigs").alias("near_edited"),
        pruned_jaccard("sigs", "next_sigs").alias("near_next"),
        F.size("sigs").alias("n_signatures"),
    )


def compare_edited_sql() -> str:
    """DuckDB SQL for `compare_edited` over `documents`."""
    anchors = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS n, count(*) OVER () AS total FROM documents),
e AS (SELECT a.doc_id, b.doc_id AS next_id, a.text, length(a.text) AS n_chars, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited FROM d a JOIN d b ON b.n = a.n % a.total + 1),
t AS (SELECT doc_id, 0 AS kind, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM t),
u AS (SELECT doc_id, kind, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT *, string_split(words, ' ') AS ws FROM w)),
c AS (SELECT *, word IN ({anchors}) AS anchor, sum(CASE WHEN word IN ({anchors}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS k FROM u),
s AS (SELECT DISTINCT a.doc_id, a.kind, {number.format("a.word || ':' || b.word || ':' || f.word")} AS sig FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.kind = b.kind AND NOT b.anchor AND b.k = a.k + 1
  JOIN c f ON a.doc_id = f.doc_id AND a.kind = f.kind AND NOT f.anchor AND f.k = a.k + 2 WHERE a.anchor),
l AS (SELECT doc_id, kind, list(sig ORDER BY sig) AS sigs FROM s GROUP BY ALL),
f AS (SELECT w.doc_id, w.kind, coalesce(sigs, [{number.format("words || ' '")}]) AS sigs FROM w LEFT JOIN l ON w.doc_id = l.doc_id AND w.kind = l.kind),
p AS (SELECT e.doc_id, n_chars, edited, a.sigs AS x, b.sigs AS y, c.sigs AS z, len(list_intersect(a.sigs, b.sigs)) AS xy, len(list_intersect(a.sigs, c.sigs)) AS xz FROM e
  JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, md5(array_to_string(x, ',')) AS fingerprint, md5(array_to_string(y, ',')) AS edited_fingerprint,
  xy / (len(x) + len(y) - xy) AS near_edited, xz / (len(x) + len(z) - xz) AS near_next, CAST(len(x) AS INTEGER) AS n_signatures FROM p"""


def length_bands(least: Fraction, longest: int) -> list[int]:
    """First sizes of bands: of two sets within the bound, the larger lies in the smaller one's band or the next."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, out[-1] * least.denominator // least.numerator + 1))
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, likeness) of classes whose signature sets are at least `least` alike, and (id, class).

    Equal sets form one class, named by its smallest id, so copies aren't paired. Sets are
    partitioned by length: a pair within the bound lies in one length band or in two that
    are next to each other. In a band only the rarest signatures of a set are indexed: if
    none of them is shared, the Jaccard likeness is under the bound. Candidates are
    verified on the whole sets. Bounds are compared in whole numbers, so pairs that reach
    `least` exactly are found; it must be over 0 and at most 1. Null texts count as empty. A class
    whose rows have no id has a null name, in pairs, too. An empty table gives no rows.
    """
    bound = Fraction(str(least))
    p, q = bound.numerator, bound.denominator
    sets = SharedTable(with_signatures(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "sigs").select("id", set_key("sigs").alias("key"), "sigs"), "spots").read()
    classes = SharedTable(sets.groupBy("key").agg(F.min("id").alias("class"), F.first("sigs").alias("sigs"), F.first(F.size("sigs").cast("long")).alias("n")), "classes").read()
    members = sets.select("id", "key").join(classes.select("key", "class"), "key").select("id", "class")
    bands = length_bands(bound, classes.agg(F.max("n")).first()[0] or 1)
    spots = classes.select("key", "n", F.explode("sigs").alias("sig"))
    often = spots.groupBy("sig").count()
    ranked = spots.join(often, "sig").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("rare"))
    prefix = F.slice("rare", F.lit(1), F.expr(f"cast(n - (n * {p}L + {q - 1}L) div {q}L + 1 as int)"))
    band = F.size(F.filter(_constants(bands, "bigint"), lambda b: b <= F.col("n")))
    index = ranked.select("key", "n", band.alias("band"), F.explode(F.transform(prefix, lambda x: x["sig"])).alias("sig"))
    probe = index.select(F.col("key").alias("b"), F.col("n").alias("m"), "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    fits = f"(n > m or (n = m and key < b)) and m * {q}L >= n * {p}L"
    found = index.join(probe, ["band", "sig"]).where(fits).select(F.col("key").alias("a"), "b").distinct()
    one, two = (classes.select(F.col("key").alias(c), F.col("class").alias(f"{c}_class"), F.col("sigs").alias(f"{c}_sigs")) for c in "ab")
    shared, total = F.size(F.array_intersect("a_sigs", "b_sigs")).cast("long"), (F.size("a_sigs") + F.size("b_sigs")).cast("long")
    near = found.join(one, "a").join(two, "b").withColumns({"shared": shared, "total": total}).where(f"shared * {q}L >= (total - shared) * {p}L")
    pairs = near.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), (F.col("shared") / (F.col("total") - F.col("shared"))).alias("likeness"))
    return pairs, members
