"""Quality selection by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SALTS, SharedTable, unit_hash
from ._text import WORD, RangeHash, byte_view, chunks, mixed, runs, text_of

BUCKETS = 10_000
#: Bins of a counting pass of the exact selection; so many counts reach the driver.
BINS = 4096

#: Token classes: words with digits, and other marks that aren't white space.
_WORDS = WORD.copy()
_WORDS[ord("0") : ord("9") + 1] = True
_MARKS = ~_WORDS
_MARKS[[9, 10, 11, 12, 13, 32]] = False


@dataclass
class Model:
    """log p_target - log p_raw of each bucket."""

    ratios: np.ndarray

    def log_weights(self, column: pa.StringArray, scale: float | None = None) -> np.ndarray:
        """Log ratio of the two models of each lower-cased text: the sum over its n-grams, or their mean times `scale`; NaN without n-grams."""
        rows, buckets = ngrams(column)
        n = np.bincount(rows, minlength=len(column))
        total = np.bincount(rows, weights=self.ratios[buckets], minlength=len(column))
        with np.errstate(invalid="ignore"):
            return np.where(n > 0, total if scale is None else scale * total / np.maximum(1, n), np.nan)


def ngrams(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all unigrams and bigrams of tokens of lower-cased texts."""
    data, offsets = byte_view(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [runs(table[data], offsets) for table in (_WORDS, _MARKS)]
    starts, ends, rows = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(starts, kind="stable")
    starts, ends, rows = starts[order], ends[order], rows[order]
    one = RangeHash(data)(starts, ends)
    near = rows[1:] == rows[:-1]
    two = mixed(one[:-1] * np.uint64(3) + one[1:])[near]
    return np.concatenate([rows, rows[1:][near]]), (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in chunks(batches, "text"):
        total += np.bincount(ngrams(text_of(batch, "text", lower=True))[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts by bucket over all rows: at most BUCKETS rows a task, and as many on the driver."""
    out = np.zeros(BUCKETS)
    for row in texts.select("text").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = 20_000, smoothing: float = 1.0, seed: int = 8) -> Model:
    """Generative models of the raw text, from all documents, and of the target, from about `target_rows` documents with quality 1.

    The bound on the target rows is a hash of doc_id. Without target rows all ratios are zero.
    """
    good = SharedTable(labels.where("doc_id is not null and quality = 1").select("doc_id").distinct(), "target").read()
    chosen = good.where(unit_hash(F.col("doc_id"), seed=seed) < target_rows / max(1, good.count()))
    # a written table of about target_rows ids: the planner knows its size
    chosen = SharedTable(chosen, "chosen").read()
    target = counts(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi"))
    if not target.sum():
        return Model(np.zeros(BUCKETS))
    raw = counts(docs)
    share = lambda n: (n + smoothing) / (n.sum() + smoothing * BUCKETS)
    return Model(np.log(share(target)) - np.log(share(raw)))


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", scale: float | None = None) -> DataFrame:
    """(id, log_weight): log of target over raw probability of a whole text's n-grams; null for null texts and texts without tokens.

    `scale` takes the mean log ratio times so many n-grams instead of the sum, which keeps
    long texts from outweighing the noise by their length. Texts of any length are weighed whole, a slice of
    a batch at a time; repeated rows and null ids get a row each, and other columns are left out.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("log_weight", T.DoubleType())])

    def apply(batches):
        for batch in chunks(batches, text):
            weights = model.log_weights(text_of(batch, text, lower=True), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64(), from_pandas=True)], [id_col, "log_weight"])

    return docs.select(id_col, text).mapInArrow(apply, schema)


def kth_largest(rows: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a long column, and how many rows are larger: by counting in ever finer bins, without a sort.

    Each pass brings at most BINS counts to the driver. k must be from 1 to the number of rows.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        bin_of = F.expr(f"cast(({key} - {low}L) div {width}L as int)")
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(bin_of.alias("bin")).count().collect()
        for row in sorted(inside, key=lambda r: -r["bin"]):
            if above + row["count"] >= k:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            above += row["count"]
    return low, above


def resample(docs: DataFrame, model: Model, fraction: float = 0.5, seed: int = 8, id_col: str = "doc_id", text: str = "text", scale: float | None = None) -> DataFrame:
    """(id, log_weight, score, selected) for every row; exactly floor(fraction * rows) rows are selected.

    `score` is the log weight plus Gumbel noise from a hash of seed and id, rounded to
    1e-6; the highest scores are selected, ties by a hash of the id. Of rows that are equal
    in score and id (repeated rows, null ids) as many are selected as are left. Texts
    without tokens have neither weight nor score, and come after all others. Ids may be of
    any type. Very long texts are weighed whole, and other columns are left out. An empty table gives no rows.
    """
    noise = -F.log(-F.log(unit_hash(F.col(id_col), seed=seed)))
    # texts without tokens keep an order among themselves, below every possible weight
    place = F.coalesce((F.col("log_weight") + noise) * 1e6, F.lit(-4e18) + noise * 1e6)
    rows = weigh(docs, model, id_col, text, scale).withColumns({"key": F.round(place).cast("long"), "tie": F.xxhash64(F.lit(seed), id_col)})
    rows = SharedTable(rows, "weighed").read()
    score = F.when(F.col("log_weight").isNotNull(), F.col("key") / 1e6).alias("score")
    k = int(fraction * rows.count())
    if k < 1:
        return rows.select(id_col, "log_weight", score, F.lit(False).alias("selected"))
    border, above = kth_largest(rows, "key", k)
    last, before = kth_largest(rows.where(F.col("key") == border), "tie", k - above)
    at_border = (F.col("key") == border) & (F.col("tie") == last)
    chosen = (F.col("key") > border) | ((F.col("key") == border) & (F.col("tie") > last))
    # rows at the border differ in nothing that is returned: they are counted, and as many as are left are selected
    left = k - above - before
    # (by salts, so that many repeats of one row, or rows without an id, are written out again in as many tasks)
    dealt = rows.where(at_border).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    equal = dealt.groupBy(id_col, "log_weight", "key", "salt").count()
    behind = Window.orderBy(F.col("log_weight").desc(), F.col(id_col).asc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("passed", F.coalesce(F.sum("count").over(behind), F.lit(0))).repartition(SALTS, "salt")
    equal = equal.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    rest = equal.select(id_col, "log_weight", score, (F.col("passed") + F.col("n") <= left).alias("selected"))
    return rows.where(~at_border).select(id_col, "log_weight", score, chosen.alias("selected")).union(rest)
