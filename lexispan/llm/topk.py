"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import SharedTable

#: Most vectors of a document range and queries of a batch, least vectors of a range (smaller tables get fewer ranges), and vectors of a block.
RANGE, BATCH, LEAST_RANGE, BLOCK = 32_768, 8_192, 4_096, 128


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, q): floor(scale * x) of every component. Rows with a null id, a null vector, or a null or non-finite component are left out."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(good).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("q"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, range_size: int = RANGE, batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all vectors but those of its own id.

    `vectors` and `queries` are (id, q). Vectors are dealt to document ranges and queries
    to batches, and each pair of a range and a batch is one bounded task: its blocks of like vectors are
    visited by their summed term maxima, for each query from the highest, until that bound
    falls below the query's kth score. The tasks' k best are then merged. So a vector is
    shuffled once for each batch and a query once for each range: n / range_size * queries +
    queries / batch * n rows in all. Ties go to the smaller id. Vectors may differ in
    length; missing components count as zero. Scores beyond a long are clamped to it.
    Repeated rows are candidates, and queries, of their own: repeated queries share their
    ranks' numbering only if they are equal, and equal queries are answered once. An empty
    table gives no rows.
    """
    vectors, queries = SharedTable(vectors, "vectors").read(), SharedTable(queries.dropDuplicates(["id", "q"]), "queries").read()
    n, m = vectors.count(), queries.count()
    n_ranges, n_batches = max(1, -(-n // range_size), min(16, n // LEAST_RANGE)), max(1, -(-m // batch))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "q", deal(n_batches, 1).alias("batch")).withColumn("range", every(n_ranges))
    right = vectors.select("id", "q", deal(n_ranges, 2).alias("range")).withColumn("batch", every(n_batches))
    cells = left.groupBy("batch", "range").cogroup(right.groupBy("batch", "range"))
    best = cells.applyInPandas(lambda a, b: _cell(a, b, k, block), "query_id long, query_hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def like_blocks(d: np.ndarray, block: int) -> list[np.ndarray]:
    """Rows in blocks of like ones: halves by the component that varies most, until a part fits in a block."""
    done, parts = [], [np.arange(len(d))]
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        inside = d[part].astype(np.float64)
        axis = np.argmax(inside.var(0))
        half = len(part) // 2
        order = np.argpartition(inside[:, axis], half)
        parts += [part[order[:half]], part[order[half:]]]
    return done


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def search_blocks(q: np.ndarray, own: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's k best rows of `d`, which of them are filled, and how many pairs of a query and a block were scored."""
    parts = [p[np.argsort(ids[p], kind="stable")] for p in like_blocks(d, block)]
    high, low = np.stack([d[p].max(0) for p in parts]), np.stack([d[p].min(0) for p in parts])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # no score of a block exceeds its bound
    order = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable")
    nothing = -(1 << 200) if q.dtype == object else -np.inf
    scores, found = np.full((len(q), k), nothing, q.dtype), np.full((len(q), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(q)), 0
    for turn in range(len(parts)):
        active = active[bounds[active, order[active, turn]] >= scores[active, -1]]
        if not len(active):
            break
        turns = order[active, turn]
        by_block = np.argsort(turns, kind="stable")
        cuts = np.flatnonzero(np.diff(turns[by_block])) + 1
        for rows in np.split(active[by_block], cuts):
            part = parts[order[rows[0], turn]]
            scored += len(rows)
            new = q[rows] @ d[part].T
            new = np.where(ids[part][None] == own[rows][:, None], nothing, new)
            both = np.concatenate([scores[rows], new], 1)
            names = np.concatenate([found[rows], np.broadcast_to(ids[part], new.shape)], 1)
            by = np.lexsort((names, -both), axis=1)[:, :k] if q.dtype != object else np.array([sorted(range(both.shape[1]), key=lambda j: (-both[i, j], names[i, j]))[:k] for i in range(len(rows))])
            scores[rows], found[rows] = np.take_along_axis(both, by, 1), np.take_along_axis(names, by, 1)
    return scores, found, scores > nothing, scored


def _cell(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, block: int) -> pd.DataFrame:
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_hash", "vec_id", "score")})
    if not len(queries) or not len(vectors):
        return none
    width = max(1, max(map(len, queries["q"])), max(map(len, vectors["q"])))
    q, d = _matrix(queries["q"], width), _matrix(vectors["q"], width)
    if np.abs(q).max() * np.abs(d).max() * width >= 2.0**53:  # too large for exact doubles
        q, d = (np.array([[int(v) for v in x] + [0] * (width - len(x)) for x in t["q"]], object) for t in (queries, vectors))
    own = queries["id"].to_numpy(np.int64)
    scores, found, real, _ = search_blocks(q, own, d, vectors["id"].to_numpy(np.int64), k, block)
    at = np.nonzero(real)[0]
    values = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores[real]], np.int64) if scores.dtype == object else scores[real].astype(np.int64)
    hashes = np.array([hash(tuple(x)) for x in queries["q"]], np.int64)
    return pd.DataFrame({"query_id": own[at], "query_hash": hashes[at], "vec_id": found[real].astype(np.int64), "score": values})


def top_k_sql(k: int = 20) -> str:
    """DuckDB SQL for the query over `embeddings`."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
