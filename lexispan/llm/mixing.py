"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import SharedTable

#: A mean above this is split into equal parts that are drawn one by one, so that exp(-mean) never vanishes.
PART_MEAN = 16.0
#: Steps of the cumulative distribution; for means up to PART_MEAN the rest is below double precision.
STEPS = 90
#: Most sources whose rates are broadcast (about 1 kB each); more are joined on salted keys.
BROADCAST_SOURCES, SALTS = 10_000, 64


def uniform(seed: int, *parts) -> F.Column:
    """A uniform double in [0, 1) from the first 52 bits of an MD5 of the seed and the parts (null as empty)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str, weights: DataFrame | None, size: int | None) -> DataFrame:
    """(source, parts, cdf): target repetition rate of each source, as parts and the distribution function of one part.

    Without weights every source (null is one, too) gets the same share. A source that
    `weights` (source, weight) lacks gets none. `size` is the expected number of rows, by
    default that of the input.
    """
    counts = docs.groupBy(F.col(source).alias("source")).count()
    counts = counts.withColumn("weight", F.lit(1.0)) if weights is None else counts.join(weights.select("source", "weight"), counts["source"].eqNullSafe(weights["source"]), "left").select(counts["source"], "count", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = SharedTable(counts, "sources").read()
    total = counts.agg(F.sum("count"), F.sum("weight")).first()
    mean = F.col("weight") / F.lit(float(total[1] or 1)) * F.lit(float(size if size is not None else total[0] or 0)) / F.col("count")
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / PART_MEAN)).cast("int")
    first = F.exp(-F.col("mean") / F.col("parts"))
    step = lambda s, k: F.struct(F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / F.col("parts") / k)).alias("cdf"), (s["p"] * F.col("mean") / F.col("parts") / k).alias("p"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.array(first).alias("cdf"), first.alias("p")), step, lambda s: s["cdf"])
    return SharedTable(counts.withColumn("mean", mean).withColumn("parts", parts).select("source", "parts", cdf.alias("cdf")), "rates").read()


def mix(docs: DataFrame, weights: DataFrame | None = None, size: int | None = None, seed: int = 17, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Every document as often as a Poisson draw says whose mean is the repetition rate of its source, shuffled globally.

    Returns the input's columns, `replica` (from 1) and `shuffle_key`, the hash by which
    rows are dealt over the partitions and sorted within them (input columns of these two
    names are replaced). The draw inverts the distribution function at a hash of seed and
    id, so it doesn't depend on partitions; repeated ids (null is one) draw alike. Null
    sources are a source of their own. An empty table gives no rows.
    """
    table = rates(docs, source, weights, size)
    names = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    # the input's columns travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source).alias("of"), F.col(id_col).alias("id"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    if table.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), F.col("of").eqNullSafe(F.col("source")))
    else:  # a hot source is spread over the salts
        salted = table.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, F.col("of").eqNullSafe(F.col("source")) & (F.col("salt") == F.col("salt_of")))
    hit = lambda u: F.size(F.filter("cdf", lambda c: c < u))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(seed, F.col("id"), part))
    copies = F.aggregate(F.transform(draws, hit), F.lit(0), lambda a, b: a + b)
    drawn = joined.select("row", "id", copies.alias("copies")).where("copies > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("replica"))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("replica").cast("string")))
    return drawn.select("row.*", "replica", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(seed: int = 17) -> str:
    """DuckDB SQL for `mix` with its defaults over `documents` (means up to PART_MEAN)."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, (1.0 / (SELECT count(*) FROM counts)) * (SELECT sum(n) FROM counts) / n AS m FROM counts),
steps AS (SELECT source, m, unnest(range(0, {STEPS + 1})) AS k FROM means),
cdf AS (SELECT source, sum(CASE WHEN k = 0 THEN exp(-m) ELSE exp(-m + k * ln(m) - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
cdfs AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(cs, lambda c: c < (('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0)) AS copies
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
replicas AS (SELECT * EXCLUDE (copies), CAST(unnest(range(1, copies + 1)) AS INTEGER) AS replica FROM drawn)
SELECT *, md5('order{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(replica AS VARCHAR)) AS shuffle_key FROM replicas"""
