"""Numpy views of the string columns of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_of(batch: pa.RecordBatch, name: str, lower: bool = False) -> pa.StringArray:
    """The column as strings; null counts as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.string()), "")
    return pc.utf8_lower(column) if lower else column


def byte_view(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column, and offsets of its rows in them."""
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many text bytes (a longer row stands alone), to bound memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.string())
        _, offsets = byte_view(pc.fill_null(column, ""))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of true bytes; no run crosses a row's end."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of one buffer, all at once."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = np.full(n + 1, BASE, np.uint64)
        self.down = np.full(n + 1, INVERSE, np.uint64)
        self.up[0] = self.down[0] = 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, tag: int = 0) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + np.uint64(tag))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that belong to words of lower-cased UTF-8 text: letters, and everything that isn't ASCII.
WORD = np.zeros(256, bool)
WORD[ord("a") : ord("z") + 1] = True
WORD[128:] = True
