"""Removal of long byte strings that stand in an earlier document, by run-length indexes of what documents share."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SharedTable, with_least
from ._text import RangeHash, byte_view, chunks, mixed, text_of

#: Shortest string that counts as repeated, and the length of the anchors that meet in one task.
LEAST, GRAM = 50, 16
#: Text bytes whose anchors share a bucket, fewest buckets, and anchors or segments that a task gathers before it sends them.
BUCKET_BYTES, LEAST_BUCKETS, GATHERED = 8 << 20, 96, 1 << 18
#: Documents in expectation that show which anchors are hot or crowded, and in how many documents an anchor is hot.
SAMPLE, HOT = 20_000, 1_000_000
#: Documents of an anchor that share a task; an anchor of more is crowded, and its documents are cut in shares at some of so many quantiles of the ids.
CROWDED, QUANTILES = 50_000, 64
#: Text bytes that are hashed or cut at once (a longer text stands alone).
SLICE = 1 << 19
#: Symbols beyond the 256 bytes: what lies outside a text (never indexed), and the first group of an anchor.
OUTSIDE, FIRST_CELL = 256, 257


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of strings, with suffix positions sampled at both ends of its runs.

    `text` holds the strings' symbols; each string ends in a symbol that occurs once. Suffixes are sorted by doubling
    prefixes; the ranks of each doubling stay, as they give the common extension of two positions.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.alphabet, rank = np.unique(text, return_inverse=True)
        text, step, self.ranks = rank, 1, []
        while True:
            self.ranks.append(rank.astype(np.int32))
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            step *= 2
            if rank[order[-1]] == n - 1:
                break
        last = text[order - 1]
        self.size, self.starts = n, np.append(0, np.flatnonzero(np.diff(last)) + 1)
        ends = np.append(self.starts[1:], n) - 1
        self.symbols = last[self.starts]
        self.at_start, self.at_end = order[self.starts], order[ends]
        self.by_symbol = np.argsort(self.symbols, kind="stable")
        lengths = (ends - self.starts + 1)[self.by_symbol]
        self.step = np.empty(len(self.starts), np.int64)  # where the first row of each run goes one symbol to the left
        self.step[self.by_symbol] = np.cumsum(lengths) - lengths
        self.keys = self.symbols[self.by_symbol] * n + self.starts[self.by_symbol]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at two positions each."""
        out = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            inside = np.maximum(a, b) + out < self.size
            at = np.where(inside, out, 0)
            out += np.where(inside & (self.ranks[j][a + at] == self.ranks[j][b + at]), 1 << j, 0)
        return out

    def matching_statistics(self, queries: np.ndarray) -> np.ndarray:
        """For each place of each query (a row) the length of the longest string from there on that the index holds.

        Queries are streamed from the right, all at once. While the symbol in front continues the current match, the match grows by
        one step; otherwise the match moves to the nearest run of that symbol above or below, whose sampled
        end tells the place in the text, and keeps the longer of the two common extensions.
        """
        n, length = queries.shape
        out = np.zeros((n, length), np.int16)
        row, place, size = np.zeros(n, np.int64), np.full(n, self.at_start[0]), np.zeros(n, np.int64)
        codes = np.minimum(np.searchsorted(self.alphabet, queries), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[codes] == queries, codes, -1)
        runs = len(self.starts)
        for i in reversed(range(length)):
            c = codes[:, i]
            run = np.searchsorted(self.starts, row, "right") - 1
            other = np.flatnonzero(self.symbols[run] != c)
            offset = row - self.starts[run]
            known = other[c[other] >= 0]
            size[other[c[other] < 0]] = -1
            if len(known):
                at = np.searchsorted(self.keys, c[known] * self.size + row[known])
                best, picked, where, shift = np.full(len(known), -1), run[known], place[known], np.zeros(len(known), np.int64)
                for near, sample, last in ((at - 1, self.at_end, True), (at, self.at_start, False)):
                    r = self.by_symbol[np.clip(near, 0, runs - 1)]
                    good = (near >= 0) & (near < runs) & (self.symbols[r] == c[known])
                    ext = np.where(good, np.minimum(size[known], self.extension(sample[r], place[known])), -1)
                    use = ext > best
                    tail = (np.append(self.starts[1:], self.size) - self.starts)[r] - 1 if last else 0
                    best, picked, where, shift = np.where(use, ext, best), np.where(use, r, picked), np.where(use, sample[r], where), np.where(use, tail, shift)
                size[known], run[known], place[known], offset[known] = best, picked, where, shift
            moved = c >= 0
            row = np.where(moved, self.step[run] + offset, row)
            place = np.where(moved, place - 1, place)
            size += 1
            out[:, i] = size
        return out


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of the anchors: the string of `gram` bytes with the least hash in every string of `least` bytes, the leftmost of equals.

    So two equal strings of `least` bytes have their anchor at the same place, whatever stands around them.
    """
    n, wide = len(data) - gram + 1, least - gram + 1
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n)
    hashes = RangeHash(data)(at, at + gram)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span < wide:
        step = min(span, wide - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    sizes = np.diff(offsets)
    first = np.repeat(offsets[:-1], np.maximum(sizes - least + 1, 0))
    windows = first + np.arange(len(first)) - np.repeat(np.cumsum(np.maximum(sizes - least + 1, 0)) - np.maximum(sizes - least + 1, 0), np.maximum(sizes - least + 1, 0))
    picked = np.unique((low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    row = np.searchsorted(offsets, picked, "right") - 1
    return row, picked - offsets[row], hashes[picked]


def _row_hash(block: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix."""
    out = np.zeros(len(block), np.uint64)
    for i in range(block.shape[1]):
        out = (out + block[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def _groups(block: np.ndarray) -> np.ndarray:
    """The number of each row of a byte matrix among its distinct rows."""
    block = np.ascontiguousarray(block)
    return np.unique(block.view(np.dtype((np.void, block.shape[1]))).ravel(), return_inverse=True)[1] if len(block) else np.zeros(0, np.int64)


def _least(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, of, value)
    return out


def _packed(**columns: np.ndarray) -> bytes:
    """The columns one behind the other, compressed: places, ids and bytes of texts are far from random."""
    raw = np.array([len(next(iter(columns.values())))], "<i8").tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())
    return zstandard.compress(raw, 1)


def _unpacked(blobs, **kinds) -> list[np.ndarray]:
    """The columns of all blobs; kinds: dtype, or dtype and width."""
    parts = {k: [] for k in kinds}
    for blob in map(zstandard.decompress, blobs):
        n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
        for name, kind in kinds.items():
            dtype, width = kind if isinstance(kind, tuple) else (kind, 1)
            part = np.frombuffer(blob, dtype, n * width, at)
            parts[name].append(part.reshape(n, width) if isinstance(kind, tuple) else part)
            at += part.nbytes
    return [np.concatenate(p) for p in parts.values()]


#: Columns of the records that tasks exchange.
ENTRY = {"mark": "<u4", "shared": "u1", "doc": "<i8", "sig": "<i4", "place": "<u4"}
SPAN = {"doc": "<i8", "sig": "<i4", "start": "<u4", "stop": "<u4"}
BLOBS = "bucket long, kind int, blob binary"


def _blobs(bucket: np.ndarray, kind: int, columns: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[rows[0]]), kind, _packed(**{k: c[rows] for k, c in columns.items()})) for rows in np.split(order, cuts) if len(rows)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


def _spread(n: int, rows: int, seed: int) -> np.ndarray:
    """Buckets for records that need no company."""
    return (np.arange(rows) // 4096 + seed) % n


def _entries(rows: DataFrame, buckets: int, least: int, gram: int) -> DataFrame:
    """Anchors of the texts as blobs: kind 0 by anchor, one for each anchor that several documents of a task share; kind 1 the others of these."""

    def sent(held):
        hashes, doc, sig, place = (np.concatenate(h) for h in zip(*held))
        _, of = np.unique(hashes, return_inverse=True)
        n = of.max() + 1 if len(of) else 0
        first = np.full(n, -1)
        first[of[::-1]] = np.arange(len(of))[::-1]
        several = np.zeros(n, bool)
        several[of[(doc != doc[first[of]]) | (sig != sig[first[of]])]] = True
        alone = ~several[of] | (first[of] == np.arange(len(of)))
        entry = {"mark": (hashes >> np.uint64(32)).astype("<u4"), "shared": several[of].astype("u1"), "doc": doc.astype("<i8"), "sig": sig.astype("<i4"), "place": place.astype("<u4")}
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        yield _batch(_blobs(bucket[alone], 0, {k: c[alone] for k, c in entry.items()}))
        rest = ~alone
        yield _batch(_blobs(_spread(buckets, int(rest.sum()), int(hashes[0] % np.uint64(buckets))), 1, {k: c[rest] for k, c in entry.items()}))

    def apply(batches):
        held, size = [], 0
        for batch in chunks(batches, "__text", SLICE):
            data, offsets = byte_view(text_of(batch, "__text"))
            row, place, hashes = anchors(data, offsets, least, gram)
            doc, sig = (batch.column(i).to_numpy()[row] for i in (0, 1))
            held.append((hashes, doc, sig, place))
            size += len(row)
            if size >= GATHERED:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    return rows.mapInArrow(apply, BLOBS)


def _shared_places(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc, sig, place) of the anchors that several documents share."""
    mark, shared, doc, sig, place = _unpacked(pdf["blob"], **ENTRY)
    keep = np.ones(len(mark), bool)
    if key[1] == 0:
        order = np.argsort(mark, kind="stable")
        group = np.cumsum(np.append(0, np.diff(mark[order].astype(np.int64)) != 0))
        several = np.zeros(group[-1] + 1, bool)
        several[group[shared[order] > 0]] = True
        same = np.diff(group) == 0
        differs = (np.diff(doc[order]) != 0) | (np.diff(sig[order]) != 0)
        several[group[1:][same & differs]] = True
        keep[order] = several[group]
    return pd.DataFrame({"__doc": doc[keep], "__sig": sig[keep], "place": place[keep].astype(np.int32)})


def hot_anchors(rows: DataFrame, n: int, least: int, gram: int) -> np.ndarray:
    """Hashes of the anchors that about HOT documents or more hold, in order. A table of fewer documents has none."""
    return frequent_anchors(rows, n, HOT, least, gram)[0]


def frequent_anchors(rows: DataFrame, n: int, bound: int, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors that about `bound` documents or more hold, by a sample of about SAMPLE of the n documents, in order, and in about how many they stand.

    A table of fewer documents has none. What comes to the driver is bounded by the sample's anchors over the count that is asked for.
    The choice moves work, never results.
    """
    if n < bound:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    share = max(1, n // SAMPLE)

    def apply(batches):
        for batch in chunks(batches, "__text", SLICE):
            row, _, hashes = anchors(*byte_view(text_of(batch, "__text")), least, gram)
            once = np.unique(np.column_stack([row.view(np.uint64), hashes]), axis=0)[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], ["hash"])

    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "__doc", "__sig"), F.lit(share)) == 0).mapInArrow(apply, "hash long")
    found = drawn.groupBy("hash").count().where(F.col("count") >= max(1, bound // share)).collect()
    hashes, counts = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order] * share


class Shares:
    """How the documents of crowded anchors are dealt: an anchor's shares are ranges of ids, and each two of them, or one alone, have a bucket behind the others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, quantiles: np.ndarray, buckets: int):
        self.hashes, self.quantiles, self.buckets = hashes, quantiles, buckets
        self.shares = np.clip(-(-counts // CROWDED), 2, QUANTILES).astype(np.int64)
        self.base = buckets + np.cumsum(self.shares * (self.shares + 1) // 2) - self.shares * (self.shares + 1) // 2

    def cuts(self, shares: int) -> np.ndarray:
        """The least ids of all shares but the first."""
        return self.quantiles[np.arange(1, shares) * len(self.quantiles) // shares]

    def dealt(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) for each share that a row of a crowded anchor meets."""
        of = np.searchsorted(self.hashes, hashes)
        own = np.zeros(len(doc), np.int64)
        for n in np.unique(self.shares[of]):
            rows = self.shares[of] == n
            own[rows] = np.searchsorted(self.cuts(n), doc[rows], "right")
        count = self.shares[of]
        row = np.repeat(np.arange(len(doc)), count)
        other = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.minimum(own[row], other), np.maximum(own[row], other)
        return row, self.base[of[row]] + high * (high + 1) // 2 + low

    def cut(self, bucket: int) -> int | None:
        """The least id of the later one of a bucket's two shares; None for a bucket whose documents are all compared."""
        if bucket < self.buckets or not len(self.base):
            return None
        of = int(np.searchsorted(self.base, bucket, "right")) - 1
        pair, high = bucket - int(self.base[of]), 0
        while (high + 1) * (high + 2) // 2 <= pair:
            high += 1
        return None if pair - high * (high + 1) // 2 == high else int(self.cuts(int(self.shares[of]))[high - 1])


def _strings(block, left, right, place, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, 128-bit name) of every string of `least` bytes that holds the anchor."""
    side = least - gram
    low, high = side - np.minimum(side, left.astype(np.int64)), side - np.maximum(0, side - right.astype(np.int64))
    count = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(block)), count)
    at = np.repeat(low, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    text = block[row[:, None], at[:, None] + np.arange(least)]
    names = np.column_stack([_row_hash(text), _row_hash(text[:, ::-1])])
    return row, place[row].astype(np.int64) - side + at, names


def _segments(rows: DataFrame, buckets: int, least: int, gram: int, hot: np.ndarray, shares: Shares) -> DataFrame:
    """The surroundings of shared anchors as blobs by anchor; of equal ones in a task the least document's is sent (kind 0), the others are spans to remove (kind 1).

    Those of crowded anchors are sent to each bucket in which their share of the documents meets a share.
    Those of hot anchors are sent as the strings that they consist of (kind 2), which need no company.
    """
    side, hashed = least - gram, len(hot) > 0 or len(shares.hashes) > 0

    def sent(held):
        block, left, right, doc, sig, place, hashes = (np.concatenate(h) for h in zip(*held))
        of = _groups(np.column_stack([block, left, right]))
        first = _least(of, doc, of.max() + 1 if len(of) else 0)[of] == doc
        if len(hot):
            own = np.flatnonzero(first & np.isin(hashes, hot))
            for part in np.array_split(own, -(-len(own) // 8192) or 1):
                row, start, names = _strings(block[part], left[part], right[part], place[part], least, gram)
                strings = {"name": names, "doc": doc[part][row], "sig": sig[part][row], "start": start}
                yield _batch(_blobs(_spread(buckets, len(row), int(doc[0]) % buckets), 2, strings))
            first = first & ~np.isin(hashes, hot)
            later = np.flatnonzero(~first & ~np.isin(np.arange(len(first)), own))
        else:
            later = np.flatnonzero(~first)
        bucket = (_row_hash(block[:, side : side + gram]) % np.uint64(buckets)).astype(np.int64)
        columns = {"block": block, "left": left, "right": right, "doc": doc, "sig": sig, "place": place}
        if len(shares.hashes):
            crowded = np.flatnonzero(first & np.isin(hashes, shares.hashes))
            for part in np.array_split(crowded, -(-len(crowded) // 8192) or 1):
                row, to = shares.dealt(hashes[part], doc[part])
                yield _batch(_blobs(to, 0, {k: c[part[row]] for k, c in columns.items()}))
            first = first & ~np.isin(hashes, shares.hashes)
        yield _batch(_blobs(bucket[first], 0, {k: c[first] for k, c in columns.items()}))
        spans = {"doc": doc[later], "sig": sig[later], "start": (place[later] - left[later]).astype("<u4"), "stop": (place[later] + gram + right[later]).astype("<u4")}
        yield _batch(_blobs(_spread(buckets, len(later), int(doc[0]) % buckets), 1, spans))

    def cut(texts, doc, sig, places):
        sizes = np.array([len(t) for t in texts])
        offsets = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(bytes(side) + b"".join(texts) + bytes(side + gram), np.uint8)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        place = np.concatenate(places).astype(np.int64)
        left, right = np.minimum(side, place), np.minimum(side, sizes[row] - place - gram)
        around = np.arange(2 * side + gram)
        block = data[(offsets[row] + place)[:, None] + around]
        block = np.where((around >= (side - left)[:, None]) & (around < (side + gram + right)[:, None]), block, 0).astype(np.uint8)
        hashes = RangeHash(data)(at := offsets[row] + place + side, at + gram) if hashed else np.zeros(len(row), np.uint64)
        return block, left.astype("u1"), right.astype("u1"), doc[row].astype("<i8"), sig[row].astype("<i4"), place.astype("<u4"), hashes

    def apply(batches):
        unpack, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            doc, sig, packed, places = (batch.column(i) for i in range(4))
            doc, sig = doc.to_numpy(), sig.to_numpy()
            texts, at, bytes_held = [], 0, 0
            for i in range(batch.num_rows):
                texts.append(unpack.decompress(packed[i].as_py()))
                bytes_held += len(texts[-1])
                if bytes_held >= SLICE or i + 1 == batch.num_rows:
                    held.append(cut(texts, doc[at : i + 1], sig[at : i + 1], [places[j].values.to_numpy() for j in range(at, i + 1)]))
                    size += len(held[-1][3])
                    texts, at, bytes_held = [], i + 1, 0
                    if size >= GATHERED // 4:
                        yield from sent(held)
                        held, size = [], 0
        if size:
            yield from sent(held)

    return rows.mapInArrow(apply, BLOBS)


def _reach(context: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each row of bytes agrees with another one of its group from the first byte on; -1 without another."""
    rows = np.column_stack([group.astype(">u4").view(np.uint8).reshape(-1, 4), context])
    order = np.argsort(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel())
    differs = rows[order[1:]] != rows[order[:-1]]
    alike = np.where(differs.any(1), differs.argmax(1), rows.shape[1]) - 4
    alike = np.maximum(alike, -1)  # of another group
    out = np.empty(len(rows), np.int64)
    out[order] = np.maximum(np.append(-1, alike), np.append(alike, -1))
    return out


def _cut(block, left, right, doc, side, gram):
    """Distinct segments: a row for each kind, its bytes, ends and least document, and the kind of every segment."""
    of = _groups(np.column_stack([block, left.astype("u1"), right.astype("u1")]))
    n = of.max() + 1 if len(of) else 0
    one = np.zeros(n, np.int64)
    one[of[::-1]] = np.arange(len(of))[::-1]
    return of, block[one], left[one].astype(np.int64), right[one].astype(np.int64), _least(of, doc, n)


def repeated(block: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, least: int, gram: int, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment (bytes around an anchor, cut at the text's ends) the range around the anchor that earlier documents' segments hold in strings of `least` bytes; start and end alike if none.

    Equal segments are one kind with their least document; the others' range is the whole segment. Kinds are then cut to what they share at most with another
    kind of their anchor on either side, which drops most of them or makes them equal again. What is left is
    ranked by document within its anchor, and for each bit of the rank the segments
    without it are indexed and those with it are streamed, so every pair meets once, as an earlier and a later one.
    With `cut`, documents from that id on are streamed against those before, all at once, and others of their own side may be left out.
    In index and stream an anchor is one symbol of its own for each group that may match, so no match leaves its group.
    """
    side = least - gram
    of, text, before, after, owner = _cut(block, left, right, doc, side, gram)
    start, stop = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    group = _groups(text[:, side : side + gram])
    before = np.minimum(before, _reach(text[:, :side][:, ::-1], group))
    after = np.minimum(after, _reach(text[:, side + gram :], group))
    kept = np.flatnonzero((before >= 0) & (after >= 0) & (before + after >= side))
    around = np.arange(2 * side + gram)
    inside = (around >= (side - before[kept])[:, None]) & (around < (side + gram + after[kept])[:, None])
    kind, text, before, after, first = _cut(np.where(inside, text[kept], 0).astype(np.uint8), before[kept], after[kept], owner[kept], side, gram)
    low, high = _streamed(text, before, after, first, side, gram, cut)
    later = owner[kept] > first[kind]
    start[kept], stop[kept] = np.where(later, -before[kind], low[kind]), np.where(later, gram + after[kind], high[kind])
    later = doc > owner[of]
    return np.where(later, -left.astype(np.int64), start[of]), np.where(later, gram + right.astype(np.int64), stop[of])


def _streamed(text: np.ndarray, before: np.ndarray, after: np.ndarray, owner: np.ndarray, side: int, gram: int, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the range of each distinct segment that segments of smaller documents hold, or those of documents below `cut`."""
    start, stop = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    group = _groups(text[:, side : side + gram])
    order = np.lexsort((owner, group))
    new_group = np.append(True, np.diff(group[order]) != 0)[: len(order)]
    new_doc = new_group | np.append(True, np.diff(owner[order]) != 0)[: len(order)]
    number = np.cumsum(new_doc)
    rank = number - np.maximum.accumulate(np.where(new_group, number, 0))
    around = np.arange(2 * side + gram)
    for bit in range(int(rank.max()).bit_length() if cut is None and len(rank) else int(len(rank) > 0)):
        if cut is None:
            cell = _groups(np.column_stack([group[order], rank >> (bit + 1)]).astype("<i8").view(np.uint8).reshape(len(order), 16))
            late = (rank >> bit) & 1 == 1
        else:
            cell, late = group[order], owner[order] >= cut
        both = (np.bincount(cell[late], minlength=cell.max() + 1) > 0) & (np.bincount(cell[~late], minlength=cell.max() + 1) > 0)

        def symbols(rows, outside):
            """Bytes around the anchor, and the anchor's cell in its place."""
            own = order[rows]
            inside = (around >= (side - before[own])[:, None]) & (around < (side + gram + after[own])[:, None])
            wide = np.where(inside, text[own].astype(np.int64), outside)
            return np.column_stack([wide[:, :side], FIRST_CELL + cell[rows], wide[:, side + gram :]])

        early, later = np.flatnonzero(~late & both[cell]), np.flatnonzero(late & both[cell])
        if not len(later):
            continue
        ends = FIRST_CELL + cell.max() + 1 + np.arange(len(early))
        indexed = np.column_stack([symbols(early, OUTSIDE), ends]).ravel()
        index = RunLengthIndex(indexed[indexed != OUTSIDE])
        sizes = index.matching_statistics(symbols(later, OUTSIDE))[:, : side + 1].astype(np.int64)
        places = np.arange(side + 1)
        covers = (places + sizes > side) & (sizes - 1 >= side)
        own, hit = order[later], covers.any(1)
        low = np.where(covers, places - side, 0).min(1)
        high = np.where(covers, places - side + sizes - 1 + gram, 0).max(1)
        start[own[hit]] = np.minimum(start[own[hit]], low[hit])
        stop[own[hit]] = np.maximum(stop[own[hit]], high[hit])
    return start, stop


def _spans(least: int, gram: int, shares: Shares):
    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == 1:
            doc, sig, start, stop = _unpacked(pdf["blob"], **SPAN)
        else:
            block, left, right, doc, sig, place = _unpacked(pdf["blob"], block=("u1", 2 * least - gram), left="u1", right="u1", doc="<i8", sig="<i4", place="<u4")
            low, high = repeated(block, left, right, doc, least, gram, shares.cut(key[0]))
            some = high > low
            doc, sig, place = doc[some], sig[some], place[some].astype(np.int64)
            start, stop = place + low[some], place + high[some]
        return pd.DataFrame({"__doc": doc, "__sig": sig, "span": start.astype(np.int64) << 32 | stop.astype(np.int64)})

    return apply


def _earlier_strings(rows: DataFrame) -> DataFrame:
    """(__doc, __sig, span) of the strings of hot anchors (blobs of kind 2) that a smaller document holds: a least document for each string, met over salts."""

    def apply(batches):
        for batch in batches:
            for blob in batch.column(0):
                name, doc, sig, start = _unpacked([blob.as_py()], name=("<u8", 2), doc="<i8", sig="<i4", start="<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.ascontiguousarray(name)], pa.binary()), pa.array(doc), pa.array(sig), pa.array(start)], ["name", "__doc", "__sig", "start"])

    strings = rows.select("blob").mapInArrow(apply, "name binary, __doc long, __sig int, start long")
    return with_least(strings, "name", "__doc", "first").where("__doc > first").select("__doc", "__sig", "start")


def _compressed(rows: DataFrame) -> DataFrame:
    """Texts as zstandard frames, for their way through a shuffle."""

    def apply(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks([batch], "__text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack.compress(t) for t in pc.cast(text_of(part, "__text"), pa.binary()).to_pylist()], pa.binary())], ["__doc", "__sig", "packed"])

    return rows.mapInArrow(apply, "__doc long, __sig int, packed binary")


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("__doc"), F.pmod(F.xxhash64(whole), F.lit((1 << 31) - 1)).cast("int").alias("__sig"), whole.alias("__text"))


def _texts(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with an id, and the same compressed; both joins of a query take these very rows, so Spark shuffles them once."""
    rows = _source(docs, id_col, text).where("__doc is not null")
    return rows, _compressed(rows).where("__doc is not null and __sig is not null")


def repeated_spans(rows: DataFrame, packed: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(__doc, __sig, spans) of the rows of `_texts`: ranges of each document's bytes that an earlier document holds in strings of `least` bytes, as start * 2**32 + end; they may overlap.

    Every string of `least` bytes has an anchor (a string of `gram` bytes chosen by its content), so equal strings meet under the same
    anchor. Anchors are dealt to buckets by hash; those that one document alone holds go no further. The surroundings of the others, all that a string of `least`
    bytes around the anchor can hold, are dealt to buckets again and compared there through run-length indexes.
    A task sends an anchor and equal surroundings once, however many of its documents hold them, so a passage that a third of all
    documents share weighs as many records in its bucket as tasks hold it; surroundings that differ are all sent. Those of anchors that a sample shows in more than CROWDED documents are
    cut in shares of the documents, and each two shares meet in a bucket of their own, the earlier one indexed and the later one streamed. Those of hot anchors don't meet in a bucket: their
    strings of `least` bytes find their least documents by partial minima over salts.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    common, counts = frequent_anchors(rows, n, min(HOT, CROWDED), least, gram) if n >= min(HOT, 2 * CROWDED) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    crowded = counts < HOT
    hot, quantiles = common[~crowded], np.zeros(0, np.int64)
    if crowded.any():
        quantiles = np.array(rows.agg(F.percentile_approx("__doc", [k / QUANTILES for k in range(QUANTILES)])).first()[0], np.int64)
    shares = Shares(common[crowded], counts[crowded], quantiles, buckets)
    entries = _entries(rows, buckets, least, gram)
    shared = entries.groupBy("bucket", "kind").applyInPandas(_shared_places, "__doc long, __sig int, place int")
    places = shared.groupBy("__doc", "__sig").agg(F.collect_set("place").alias("places"))
    joined = packed.join(places, ["__doc", "__sig"]).select("__doc", "__sig", "packed", "places")
    segments = _segments(joined, buckets, least, gram, hot, shares)
    if len(hot):
        segments = SharedTable(segments, "segments").read()  # read twice
    found = segments.where("kind < 2").groupBy("bucket", "kind").applyInPandas(_spans(least, gram, shares), "__doc long, __sig int, span long")
    if len(hot):
        strings = _earlier_strings(segments.where("kind = 2"))
        found = found.union(strings.select("__doc", "__sig", (F.shiftleft("start", 32) + F.col("start") + least).alias("span")))
    return found.groupBy("__doc", "__sig").agg(F.collect_set("span").alias("spans"))


def without(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went, and in how many runs."""
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with `keep_bytes` the bytes that are kept.

    Removed is each byte that lies in a string of `least` bytes which also starts in a document of a smaller id; strings are
    judged on the input. Null counts as an empty text; texts shorter than `least` bytes stay whole, and very long
    ones are indexed whole. Rows of one id don't remove bytes of each other, whether they are repeats or differ. A row with a null id stays
    whole and removes nothing. Other columns are left out, so their names can't clash. An empty table gives no rows.
    """
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if keep_bytes else [])])

    def apply(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                data = unpack.decompress(packed.as_py())
                both = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                kept, removed, runs = without(data, both >> 32, both & 0xFFFFFFFF)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: len(schema) - 1]], schema.names)

    rows, packed = _texts(docs, id_col, text)
    joined = packed.join(repeated_spans(rows, packed, least, gram), ["__doc", "__sig"], "left").select("__doc", "packed", "spans")
    nameless = _compressed(_source(docs, id_col, text).where("__doc is null")).select("__doc", "packed", F.lit(None).cast("array<long>").alias("spans"))
    return joined.union(nameless).select(F.col("__doc").cast(docs.schema[id_col].dataType).alias(id_col), "packed", "spans").mapInArrow(apply, schema)
