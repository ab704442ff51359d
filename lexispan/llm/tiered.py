"""Ranked lexical search over a tiered index: postings of high impact first, residual bounds for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import SharedTable
from ._text import RangeHash, byte_view, chunks, runs, text_of

#: Bytes of terms (digits, ASCII letters, everything that isn't ASCII), and the bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Results of an item, documents of an index range, most query bytes that are answered at once.
K, RANGE, BLOCK_BYTES = 50, 65_536, 8 << 20
#: A term's postings are cut after a sixteenth and a quarter of them, those of highest impact first; shorter lists than this aren't cut.
CUTS, WHOLE = (16, 4, 1), 64
#: Most documents of a range whose open bounds are settled by their whole postings; beyond it the next tier is read.
OPEN = 2_048


def terms(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash, length and first eight bytes of every term of the texts."""
    data, offsets = byte_view(column)
    data = LOWER[data]
    starts, ends, rows = runs(IN_TERM[data], offsets)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(len(starts), np.uint64)
    for i in range(8):
        head |= np.where(starts + i < ends, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    return rows, RangeHash(data)(starts, ends), ends - starts, head


class Vocabulary:
    """The terms of a block of queries, found again in texts by hash, length and first bytes."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, heads: np.ndarray):
        self.hashes, first = np.unique(hashes, return_index=True)
        self.lengths, self.heads = lengths[first], heads[first]

    def find(self, hashes: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Numbers of the terms, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.lengths[at] == lengths) & (self.heads[at] == heads), at, -1)


def _query_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, text hash, terms) of the distinct queries: their distinct terms' hashes, lengths and first bytes."""

    def apply(batches):
        for batch in chunks(batches, text):
            rows, hashes, lengths, heads = terms(text_of(batch, text))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            out = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                _, first = np.unique(hashes[a:b], return_index=True)
                for o, x in zip(out, (hashes.view(np.int64), lengths, heads.view(np.int64))):
                    o.append(x[a:b][first])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(pa.int64())) for o in out)], ["item", "hashes", "lengths", "heads"])

    distinct = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias(text)).distinct()
    schema = f"item {items.schema[item].dataType.simpleString()}, hashes array<long>, lengths array<long>, heads array<long>"
    return distinct.mapInArrow(apply, schema)


def postings(docs: DataFrame, words: Vocabulary, id_col: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of every document with at least one term: its number of terms, and which of the vocabulary it holds how often."""

    def apply(batches):
        for batch in chunks(batches, text):
            rows, hashes, lengths, heads = terms(text_of(batch, text))
            n = np.bincount(rows, minlength=batch.num_rows)
            number = words.find(hashes, lengths, heads)
            key = (rows * (len(words.hashes) + 1) + number)[number >= 0]
            pairs, counts = np.unique(key, return_counts=True)
            row, term = pairs // (len(words.hashes) + 1), pairs % (len(words.hashes) + 1)
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (term, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(apply, "id long, n long, terms array<int>, counts array<int>")


class TieredRange:
    """The index of a range of documents: each term's postings by falling impact, cut in tiers, and each document's whole postings."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, documents: int, length: int):
        sizes, back = np.unique(n, return_inverse=True)
        mass = np.array([50 + (50 * int(s) * documents) // length for s in sizes], np.int64)[back]
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        count = count.astype(np.int64)
        self.size, self.starts, self.term = len(n), starts, term
        self.impact = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * mass[doc]))
        order = np.lexsort((-self.impact, term))
        self.docs, self.impacts = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weight) + 1))
        held = np.diff(self.first)
        self.ends = [self.first[:-1] + np.where(held <= WHOLE, held, -(-held // c)) for c in CUTS]
        after = np.append(self.impacts, 0)
        self.residual = [np.where(e < self.first[1:], after[e], 0) for e in self.ends]
        self.asked = np.zeros(len(weight), bool)

    def whole(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, by their whole postings."""
        self.asked[query] = True
        sizes = self.starts[docs + 1] - self.starts[docs]
        row = np.repeat(np.arange(len(docs)), sizes)
        at = np.repeat(self.starts[docs], sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, row = at[hit := self.asked[self.term[at]]], row[hit]
        self.asked[query] = False
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, row, self.impact[at])
        return out

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, most: int = OPEN) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents, their scores, and the number of tiers that were read.

        After each tier a document's score lies between what it has and that plus the terms' residual bounds. If few enough
        documents can reach the kth least score, these are settled by their whole postings, which proves the result:
        no other document reaches it. Otherwise the item falls through to the next tier; after the last one the bounds are 0.
        """
        score, before = np.zeros(self.size, np.int64), self.first[:-1]
        for tier, (ends, residual) in enumerate(zip(self.ends, self.residual), 1):
            for a, b in zip(before[query], ends[query]):
                score[self.docs[a:b]] += self.impacts[a:b]  # a document stands once in a term's postings
            before, rest = ends, int(residual[query].sum())
            kth = int(np.partition(score, -k)[-k]) if len(score) > k else 0
            if kth <= rest and rest:
                continue
            found = np.flatnonzero(score >= max(kth - rest, 1))
            if rest and len(found) > most:
                continue
            exact = self.whole(found, query) if rest else score[found]
            best = np.lexsort((ids[found], -exact))[:k]
            return found[best], exact[best], tier
        raise AssertionError("the last tier leaves nothing open")


def _answers(index: DataFrame, queries: list[np.ndarray], numbers: np.ndarray, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(number, id, score): each query's k best documents of each index range."""

    def ranges(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RANGE:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks()

    def apply(batches):
        for table in ranges(batches):
            ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
            lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            starts = lists[0].offsets.to_numpy().astype(np.int64)
            part = TieredRange(n, starts - starts[0], *(x.flatten().to_numpy() for x in lists), weight, documents, length)
            for number, query in zip(numbers, queries):
                docs, scores, _ = part.search(query, k, ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number), pa.int32()), pa.array(ids[docs], pa.int64()), pa.array(scores, pa.int64())], ["number", "id", "score"])

    return index.mapInArrow(apply, "number int, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, ties to the smaller id.

    Items are answered in blocks of about BLOCK_BYTES of their texts, so what tasks and driver hold of them is bounded. For a
    block, one pass over whole texts writes the documents' postings of the block's terms; number, length
    and document frequencies come from all of them. Each range of documents then gets a tiered index, every query is answered
    on it, and the ranges' k best are merged. No posting is dropped: tiers only decide what has to be read.
    Rows with a null id, a null text or no term take no part, in counts neither. Repeated documents are ranked each; repeated items are answered
    once, and different texts of one item id have ranks of their own. Items without terms, and empty tables, give no rows.
    """
    kind = items.schema[item].dataType.simpleString()
    asked = SharedTable(_query_terms(items, item, text), "items")
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BLOCK_BYTES))
    found = []
    for block in range(n_blocks):
        rows = asked.read().where(F.size("hashes") > 0).where(F.pmod(F.xxhash64("item", "hashes"), F.lit(n_blocks)) == block).collect()
        if rows:
            found.append(_block(docs, [r["item"] for r in rows], [[np.array(r[c], np.int64) for c in ("hashes", "lengths", "heads")] for r in rows], k, id_col, text, kind))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{item} {kind}, rank int, {id_col} long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(id_col), "score")


def _block(docs: DataFrame, names: list, wanted: list, k: int, id_col: str, text: str, kind: str) -> DataFrame:
    hashes, lengths, heads = (np.concatenate([w[i] for w in wanted]) for i in range(3))
    words = Vocabulary(hashes.view(np.uint64), lengths, heads.view(np.uint64))
    index = SharedTable(postings(docs, words, id_col, text), "postings").read()
    documents, length = index.agg(F.count("*"), F.sum("n")).first()
    held = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.array([int(np.floor(1000 * np.log((2 * documents + 2) / (2 * held.get(t, 0) + 1)))) for t in range(len(words.hashes))], np.int64)
    queries = [np.flatnonzero(np.isin(words.hashes, w[0].view(np.uint64))) for w in wanted]
    answers = _answers(index, queries, np.arange(len(names)), weight, documents, length or 1, k)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = docs.sparkSession.createDataFrame(list(enumerate(names)), f"number int, item {kind}")  # a row for each query of the block
    return ranked.join(F.broadcast(named), "number")


def search_sql(k: int = K) -> str:
    """DuckDB SQL for the query over `documents` and `benchmark`."""
    split = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, {split} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
total AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, rid, n, term, count(*) AS tf FROM (SELECT doc_id, rid, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, nn),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
