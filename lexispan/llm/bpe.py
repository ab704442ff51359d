"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import chunks, text_of

WIDTH = 256
#: Pre-tokens that a worker remembers, and the longest of them; both bound memory only.
REMEMBERED, LONGEST = 250_000, 64
#: Neighbouring ranks that share a bucket where short pre-tokens are merged, and most bytes of these (a place in one takes 6 bits).
SHARED, SHORT = 512, 64
#: Bytes of text whose new pre-tokens are merged at once.
SLICE = 1 << 22


class RankQueue:
    """Buckets of positions by merge rank; two levels of bitmaps find the lowest bucket in use.

    A bit of the top word says that a word of the lower level has a bit set, and that
    bit says that the bucket of its rank holds positions.
    """

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // WIDTH + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Opens the bucket of a rank."""
        self.buckets[rank] = positions
        word = rank // WIDTH
        self.low[word] |= 1 << rank % WIDTH
        self.top |= 1 << word

    def lowest(self) -> int | None:
        """Closes the bucket of the lowest rank that is waiting."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = word * WIDTH + (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        return rank

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank that is waiting, and its positions from left to right."""
        rank = self.lowest()
        return None if rank is None else (rank, sorted(self.buckets.pop(rank)))


class Encoder:
    """Byte-level BPE by a rank table; pre-tokens by a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.most = max(ranks.values(), default=0)
        self.pieces = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.double = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        # a part is a token, or a byte that is none; (left part, right part) is one number
        parts = {bytes([i]): self.most + 1 + i for i in range(256)} | ranks
        self.parts = np.array([parts[bytes([i])] for i in range(256)], np.int64)
        self.span = self.most + 257
        pairs = {parts[b[:k]] * self.span + parts[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in parts and b[k:] in parts}
        self.pairs = np.array(sorted(pairs) + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([pairs[x] for x in self.pairs[:-1].tolist()] + [-1], np.int64)
        sizes = np.full(self.most + 1, -1, np.int64)
        sizes[list(self.pieces)] = list(map(len, self.pieces.values()))
        self.sizes, self.letters = sizes, np.frombuffer(b"".join(self.pieces[i] for i in sorted(self.pieces)), np.uint8)
        self.starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts, -1 for those that make no token."""
        key = left * self.span + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """As `merged`, for pre-tokens of up to SHORT bytes: the queue's buckets hold SHARED neighbouring ranks each.

        Of the lowest bucket every pre-token merges the leftmost of its pairs with the lowest rank, all
        pre-tokens at once, and the rest of the bucket goes back: nothing lower waits anywhere, and pre-tokens don't touch each other.
        """
        data, lengths = b"".join(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data)
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(pieces)), lengths)
        edge = np.zeros(n + 1, bool)
        edge[starts] = edge[n] = True
        ids = np.append(self.parts[codes], 0)
        waits = np.full(n + 1, -1, np.int64)  # rank of the pair whose left part begins here
        waits[: n - 1] = np.where(edge[1:n], -1, self.double[codes[:-1] * 256 + codes[1:]])
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # where the parts behind and in front begin
        alive = np.ones(n, bool)
        queue = RankQueue(self.most // SHARED)

        def put(at: np.ndarray) -> None:
            at = at[np.argsort(waits[at], kind="stable")]
            number = waits[at] // SHARED
            cuts = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(at)]
            for a, b, bucket in zip(cuts, cuts[1:], number[cuts[:-1]].tolist()):
                if bucket in queue.buckets:
                    queue.buckets[bucket].append(at[a:b])
                else:
                    queue.put(bucket, [at[a:b]])

        put(np.flatnonzero(waits >= 0))
        while (bucket := queue.lowest()) is not None:
            at = np.concatenate(queue.buckets.pop(bucket))
            rank = waits[at] - bucket * SHARED
            fresh = (rank >= 0) & (rank < SHARED)  # else stale: one of the parts has changed since
            at, rank = at[fresh], rank[fresh]
            own = owner[at]
            order = np.sort((own * SHARED + rank) * SHORT + at - starts[own])
            own = order // (SHARED * SHORT)
            at = starts[own] + order % SHORT
            first = np.diff(own, prepend=-1) > 0
            rest, i = at[~first], at[first]
            if len(rest):
                queue.put(bucket, [rest])
            ranks, middle = waits[i], after[i]
            end = after[middle]
            after[i], before[end], ids[i] = end, i, ranks
            alive[middle], waits[middle], waits[i] = False, -1, -1
            right, left = ~edge[end], ~edge[i]
            waits[i[right]] = self.pair_ranks(ranks[right], ids[end[right]])
            front = before[i[left]]
            waits[front] = self.pair_ranks(ids[front], ranks[left])
            changed = np.concatenate([i[right], front])
            put(changed[waits[changed] >= 0])
        found = ids[:n][alive]
        if len(found) and found.max() > self.most:
            raise KeyError("the vocabulary lacks a byte of the text")
        out = found.astype("<u4").tobytes()
        counts = (np.append(np.cumsum(alive) - alive, len(found))[np.append(starts, n)] * 4).tolist()
        return [out[a:b] for a, b in zip(counts, counts[1:])]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of any length, each on its own: all lie in one linked list with borders, and share one queue.

        A pair is queued by the position of its left part. Of the pairs with the lowest
        rank the leftmost merges first; if that makes a pair of a still lower rank, what
        is left of the bucket goes back to the queue.
        """
        ranks, data, n = self.ranks.get, b"".join(pieces), sum(map(len, pieces))
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        border = np.zeros(n + 1, bool)
        border[np.cumsum([0, *map(len, pieces)])] = True
        pairs = np.full(n, -1)
        pairs[:-1] = self.double[codes[:-1] * 256 + codes[1:]]
        pairs[border[1:]] = -1
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0) :]
        queue = RankQueue(self.most)
        put, buckets = queue.put, queue.buckets
        if len(order):
            cuts = np.flatnonzero(np.diff(pairs[order])) + 1
            for part in np.split(order, cuts):
                put(int(pairs[part[0]]), part.tolist())
        waits = pairs.tolist()  # rank of the pair whose left part begins here
        ends = list(range(1, n + 1))  # where the part that begins here ends, 0 once it is merged away
        before = list(range(-1, n))  # where the part begins that ends here
        ids, edge = self.single[codes].tolist(), border.tolist()
        while (found := queue.take()) is not None:
            rank, bucket = found
            for k, i in enumerate(bucket):
                if waits[i] != rank:
                    continue  # stale: one of the parts has changed since
                middle = ends[i]
                end = ends[i] = ends[middle]
                ends[middle] = 0
                ids[i] = rank
                waits[middle] = -1
                lowest = rank
                if edge[end]:
                    waits[i] = -1
                else:
                    before[end] = i
                    new = waits[i] = ranks(data[i : ends[end]], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            put(new, [i])
                        if new < lowest:
                            lowest = new
                if not edge[i]:
                    left = before[i]
                    new = waits[left] = ranks(data[left:end], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            put(new, [left])
                        if new < lowest:
                            lowest = new
                if lowest < rank:
                    if rest := bucket[k + 1 :]:
                        put(rank, rest + buckets.get(rank, []))
                    break
        alive = np.array(ends) > 0
        found = np.array(ids, np.int64)[alive]
        if len(found) and found.min() < 0:
            raise KeyError("the vocabulary lacks a byte of the text")
        out = found.astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(alive)])[np.flatnonzero(border)] * 4
        return [out[a:b] for a, b in zip(counts.tolist(), counts[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, ranks = self.known, self.ranks
        if len(known) >= REMEMBERED:
            known.clear()
        split = [self.split(x) for x in texts]
        new = list(set().union(*split).difference(known))
        raw = [x.encode() for x in new]
        hard = [i for i, x in enumerate(raw) if x not in ranks]
        known.update((x, ranks[r].to_bytes(4, "little")) for x, r in zip(new, raw) if r in ranks)
        if hard:
            for some, merge in (([i for i in hard if len(raw[i]) <= SHORT], self.merged_together), ([i for i in hard if len(raw[i]) > SHORT], self.merged)):
                if some:
                    known.update(zip((new[i] for i in some), merge([raw[i] for i in some])))
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for i in hard:
            if len(new[i]) > LONGEST:
                del known[new[i]]
        return out

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of the ids of each row."""
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        if len(ids) and (ids.max() > self.most or self.sizes[ids].min() < 0):
            raise KeyError("the vocabulary lacks an id")
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))
        data = self.letters[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)].tobytes()
        cuts = ends[np.cumsum([0, *map(len, rows)]) // 4].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ranks, one pair a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(lines + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(lines), pattern)
    return _ENCODERS[key]


def _broadcast(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # a vocabulary file: about 1 MB whatever the corpus
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, without special tokens.

    Null and empty texts give an empty array. Repeated rows and null ids give a row
    each; an empty table gives no rows. Equal to the ids of the usual merge loop: of
    the pairs with the lowest rank the leftmost merges first. A byte that the vocabulary
    lacks raises KeyError.
    """
    lines = _broadcast(docs, vocabulary)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def apply(batches):
        encoder = _encoder(lines.value, pattern)
        for batch in chunks(batches, text, SLICE):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(text_of(batch, text).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text).mapInArrow(apply, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of the ids of every row; null or empty ids give no bytes. An id that the vocabulary lacks raises KeyError."""
    lines = _broadcast(encoded, vocabulary)
    schema = T.StructType([encoded.schema[id_col], T.StructField("bytes", T.BinaryType())])

    def apply(batches):
        encoder = _encoder(lines.value, "")
        for batch in batches:
            out = encoder.decode([np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids).mapInArrow(apply, schema)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and decoded from the ids, where the text is.

    The same encoder as `encode` and `decode`; only digests leave the task.
    """
    lines = _broadcast(docs, vocabulary)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def apply(batches):
        encoder = _encoder(lines.value, pattern)
        for batch in chunks(batches, text, SLICE):
            ids = encoder.encode(text_of(batch, text).to_pylist())
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, encoder.decode(ids)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text).mapInArrow(apply, schema)
