"""Product quantisation of vectors: integer codebooks per part, nearest entries by float32 products whose rounding errors are bounded."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SALTS, SharedTable, salt

#: Parts of a vector, entries of a codebook, rounds of refinement, and the factor before components are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of one matrix product.
BLOCK = 8_192
#: Half a unit in the last place of a float32 of size 1, and the largest magnitude that is multiplied (larger values are scaled by a power of two).
UNIT, LARGEST = 2.0**-24, 2.0**20
LONG = (1 << 63) - 1


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, distance) of the entry nearest to each row of integers, and how many distances were computed in whole numbers.

    Float32 products give |c|^2 - 2 x.c for all entries. Converting x, c and |c|^2, the w products,
    their sums and the last difference are at most w + 4 roundings, so each value is off by no more than
    g * (|c|^2 + 2 |x| |c|) with g = k u / (1 - k u), k = w + 8, whatever the order of the sums. Entries
    whose interval reaches down to the least upper end may be the nearest one: their distances are computed in
    int64, or in Python's integers if int64 could overflow, and the smallest index of the least distance is taken.
    """
    n, width = x.shape
    top = max([1, *(abs(int(f(a))) for a in (x, entries) if a.size for f in (np.min, np.max))])
    exact = (lambda a: a) if width * (2 * top) ** 2 <= LONG else (lambda a: a.astype(object))
    scale = min(1.0, LARGEST / 2.0 ** top.bit_length())
    c = entries.astype(np.float64) * scale
    c32, squares = c.astype(np.float32), (c * c).sum(1)
    k = width + 8
    grown = 1.0001 * k * UNIT / (1 - k * UNIT)
    index, least, computed = np.zeros(n, np.int64), [], 0
    for at in range(0, n, BLOCK):
        part = x[at : at + BLOCK]
        f = part.astype(np.float64) * scale
        value = (squares.astype(np.float32) - np.float32(2) * (f.astype(np.float32) @ c32.T)).astype(np.float64)
        error = grown * (squares + 2 * np.sqrt((f * f).sum(1))[:, None] * np.sqrt(squares))
        rows, cols = np.nonzero(value - error <= (value + error).min(1)[:, None])
        apart = exact(part)[rows] - exact(entries)[cols]
        distance = (apart * apart).sum(1)
        computed += len(rows)
        best = np.minimum.reduceat(distance, np.searchsorted(rows, np.arange(len(part))))
        hits = np.flatnonzero(distance == best[rows])
        index[at : at + BLOCK] = cols[hits[np.searchsorted(rows[hits], np.arange(len(part)))]]
        least.append(best)
    return index, np.concatenate(least) if least else np.zeros(0, np.int64), computed


def quantise(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, q): floor(scale * x) of every component, as 64-bit integers (larger ones are clamped to them)."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(good).select(F.col(id_col).alias("id"), F.col(label).alias("label"), whole.alias("q"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of PARTS * width integers; shorter vectors end in zeros."""
    out = np.zeros((len(column), PARTS * width), np.int64)
    ends = column.offsets.to_numpy()
    sizes, values = np.diff(ends), column.values.to_numpy()[ends[0] : ends[-1]]
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(slot, n, high, low) of each task: rows of each part's entry, and the sums of their components in two halves of 32 bits."""
    _, entries, width = books.shape

    def apply(batches):
        n = np.zeros((PARTS, entries), np.int64)
        high, low = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for p in range(PARTS):
                own = x[:, p * width : (p + 1) * width]
                index, _, _ = nearest(own, books[p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(high[p], index, own >> 32)
                np.add.at(low[p], index, own & 0xFFFFFFFF)
        used = np.flatnonzero(n)
        parts = [used, n.ravel()[used], *(list(a.reshape(PARTS * entries, width)[used]) for a in (high, low))]
        yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), *(pa.array(a, pa.list_(pa.int64())) for a in parts[2:])], ["slot", "n", "high", "low"])

    return kept.select("q").mapInArrow(apply, "slot long, n long, high array<long>, low array<long>")


def refine(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floored mean of its parts; entries without any stay. PARTS * ENTRIES rows come to the driver."""
    _, entries, width = books.shape
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = [wide(F.get(c, i)).alias(f"{c}{i}") for i in range(width) for c in ("high", "low")]
    out = books.copy()
    for r in _sums(kept, books).groupBy("slot").agg(wide(F.col("n")).alias("n"), *sums).collect():
        out[r["slot"] // entries, r["slot"] % entries] = [((int(r[f"high{i}"]) << 32) + int(r[f"low{i}"])) // int(r["n"]) for i in range(width)]
    return out


def assign(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every row: two hex digits a part, and the squared distances summed (at most the largest long)."""
    width = books.shape[2]
    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def apply(batches):
        for batch in batches:
            x = _matrix(batch.column(2), width)
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), object)
            for p in range(PARTS):
                index, distance, _ = nearest(x[:, p * width : (p + 1) * width], books[p])
                codes[:, p], error = index, error + distance.astype(object)
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([min(e, LONG) for e in error], pa.int64())], schema.names)

    return kept.select("id", "label", "q").mapInArrow(apply, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def first_books(kept: DataFrame) -> np.ndarray:
    """The parts of the ENTRIES smallest ids (equal ids by their vectors), fewer if there are fewer rows."""
    width = -(-(kept.agg(F.max(F.size("q"))).first()[0] or 0) // PARTS)
    rows = [r["q"] for r in kept.orderBy("id", "q").limit(ENTRIES).select("q").collect()]
    books = np.zeros((PARTS, len(rows), width), np.int64)
    for e, q in enumerate(rows):
        books[:, e] = np.array(q + [0] * (PARTS * width - len(q)), np.int64).reshape(PARTS, width)
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row.

    Rows with a null id, a null vector, or a null or non-finite component are left out. Codebooks have
    PARTS * ENTRIES entries, whatever the table's size, and each round moves that many sums a task. Labels may be few or many:
    their sums are joined over salts. Repeated rows are coded each, and count as often as they occur. A vector that is
    shorter than the longest one, or a length that is no multiple of PARTS, is filled up with zeros. Whole numbers beyond 64 bits
    are clamped: components when they are floored, errors and their sums when they are returned. An empty table gives no rows.
    """
    table = SharedTable(quantise(vectors, id_col, vector, label), "quantised")
    kept = table.read()
    books = first_books(kept)
    for _ in range(rounds if books.size else 0):
        books = refine(kept, books)
    coded = SharedTable(assign(kept, books), "coded").read()
    table.drop()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
    totals = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("__part", salt("id"))
    joined = rows.join(totals, rows["label"].eqNullSafe(totals["__label"]) & (rows["__part"] == totals["__salt"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def encode_sql() -> str:
    """DuckDB SQL for the query over `embeddings`, whose vectors have one length, a multiple of PARTS."""
    nearest_sql = "SELECT rid, p, x, e, s FROM (SELECT v.rid, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM parts v JOIN {books} b USING (p)) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY s, e) = 1"
    rounds = "".join(
        f""",
a{i} AS MATERIALIZED ({nearest_sql.format(books=f"b{i - 1}")}),
m{i} AS (SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL),
b{i} AS MATERIALIZED (SELECT b.p, b.e, list(coalesce(CASE WHEN m.s >= 0 THEN m.s // m.n ELSE -((-m.s + m.n - 1) // m.n) END, b.c[u.i])::BIGINT ORDER BY u.i) AS c
  FROM b{i - 1} b, unnest(range(1, len(b.c) + 1)) u(i) LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e AND m.i = u.i GROUP BY b.p, b.e)"""
        for i in range(1, ROUNDS + 1)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES}){rounds},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM ({nearest_sql.format(books=f"b{ROUNDS}")}) GROUP BY rid),
hashed AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM b{ROUNDS}, unnest(range(1, len(c) + 1)) u(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN coded USING (rid), hashed"""
