"""Near-duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SharedTable, connected_components, salt, with_least
from ._text import chunks, text_of

#: Larger groups of one block key are split by further blocks instead of being compared in one task.
GROUP_LIMIT = 4096


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """The 64 majority bits of the shingles' XXH64 values (seed 42); zero for no words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(shingle, len(words))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())),
        np.uint64,
        len(words) - width + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, into: str = "fp") -> DataFrame:
    """The input's columns without the text, and its fingerprint as a signed long. Null text counts as empty."""
    others = [c for c in docs.columns if c not in (text, into)]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(into, T.LongType())])

    def apply(batches):
        for batch in chunks(batches, text):
            found = [fingerprint_of(x, shingle) for x in text_of(batch, text).to_pylist()]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [values], [*others, into])

    return docs.select(*others, text).mapInArrow(apply, schema)


def block_masks(taken: int, blocks: int, distance: int) -> list[int]:
    """Masks of which at least one covers only equal bits of two values within the distance.

    The bits that aren't taken yet are cut into blocks; differing bits lie in at most
    `distance` of them, so the values agree on some choice of the others.
    """
    free = [i for i in range(64) if not taken >> i & 1]
    cuts = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [taken | sum(chosen) for chosen in combinations(parts, blocks - distance)]


def links(values: DataFrame, distance: int = 3, blocks: int = 6, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` whose components are those of all pairs within the distance.

    Fingerprints are joined on blocks and each candidate's Hamming distance is verified.
    Of a group, a spanning forest of its links is returned, not all its pairs. A group of
    more than `limit` values is cut by blocks of the bits that are left; at the third
    cut at most 2**8 values share a key, so no task holds an unbounded group and no link is lost.
    """
    schema = "a long, b long, mask long, deeper boolean"
    rows, found = values.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    for level in range(3):
        last = level == 2
        table = SharedTable(
            rows.mapInPandas(lambda it: _keyed(it, blocks, distance), "mask long, key long, fp long")
            .repartition("mask", "key")
            .sortWithinPartitions("mask", "key")
            .mapInPandas(lambda it, most=1 << 62 if last else limit: _linked(it, distance, most), schema),
            "links",
        ).read()
        found.append(table.where("not deeper").select("a", "b"))
        rows = table.where("deeper").select("mask", F.col("a").alias("fp"))
        if last or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keyed(frames, blocks: int, distance: int):
    known: dict[int, np.ndarray] = {}
    for frame in frames:
        for taken, part in frame.groupby("mask"):
            taken = int(taken) & (1 << 64) - 1
            if taken not in known:
                known[taken] = np.array(block_masks(taken, blocks, distance), np.uint64)
            masks, fp = known[taken], part["fp"].to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({"mask": np.repeat(_signed(masks), len(fp)), "key": _signed((masks[:, None] & fp).ravel()), "fp": np.tile(_signed(fp), len(masks))})


def _linked(frames, distance: int, limit: int):
    """Rows arrive sorted by mask and key; a group that spans batches is carried on."""
    empty = {k: np.zeros(0, np.int64) for k in ("mask", "key", "fp")}
    held, passing = empty, None
    for frame in _arrays(frames):
        if passing is not None:  # the rest of a group that is too large
            same = (frame["mask"] == passing[0]) & (frame["key"] == passing[1])
            if same.any():
                yield _deeper({k: v[same] for k, v in frame.items()})
                frame = {k: v[~same] for k, v in frame.items()}
            if not len(frame["fp"]):
                continue
            passing = None
        held = {k: np.concatenate([held[k], frame[k]]) for k in held}
        change = (held["mask"][1:] != held["mask"][:-1]) | (held["key"][1:] != held["key"][:-1])
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(held["fp"])]])
        whole = int(bounds[-2])
        yield from _groups({k: v[:whole] for k, v in held.items()}, bounds[:-1], distance, limit)
        held = {k: v[whole:] for k, v in held.items()}
        if len(held["fp"]) > limit:
            passing = (held["mask"][0], held["key"][0])
            yield _deeper(held)
            held = empty
    yield from _groups(held, np.array([0, len(held["fp"])]), distance, limit)


def _arrays(frames):
    for frame in frames:
        yield {k: frame[k].to_numpy(np.int64) for k in ("mask", "key", "fp")}


def _deeper(rows) -> pd.DataFrame:
    return pd.DataFrame({"a": rows["fp"], "b": rows["fp"], "mask": rows["mask"], "deeper": True})


def _groups(rows, bounds: np.ndarray, distance: int, limit: int):
    sizes = np.diff(bounds)
    a, b = [], []
    fp, group = rows["fp"].view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= 8, sizes)
    for shift in range(1, 8):  # all pairs of small groups, of all groups at once
        near = small[shift:] & (group[shift:] == group[:-shift])
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance]
        a.append(fp[at])
        b.append(fp[at + shift])
    for i in np.flatnonzero(sizes > 8):
        part = slice(bounds[i], bounds[i + 1])
        if sizes[i] > limit:
            yield _deeper({k: v[part] for k, v in rows.items()})
            continue
        rest, queue = fp[part], []
        while len(rest) or queue:
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                new = rest[near]
                a.append(np.full(len(new), at))
                b.append(new)
                queue.extend(new)
                rest = rest[~near]
            elif not len(rest):
                break
    if a and sum(map(len, a)):
        yield pd.DataFrame({"a": _signed(np.concatenate(a)), "b": _signed(np.concatenate(b)), "mask": np.int64(0), "deeper": False})


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, root, component_id) for every row, `fp` and `root` as signed longs.

    Fingerprints within the distance are linked, and component_id is the smallest id
    reachable over links. Exact copies share one fingerprint and are linked once.
    Null text counts as empty, and every empty text has fingerprint zero. A null id gets
    a row; it is never a component_id unless no row of the component has an id. Repeated
    rows are returned as often as they occur. Very long texts are fingerprinted whole; other columns
    are left out, so their names can't clash. An empty table gives no rows.
    """
    marked = SharedTable(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle), "fingerprints").read()
    return with_components(marked, lambda values: connected_components(links(values, distance)), id_col)


def with_components(marked: DataFrame, roots_of, id_col: str) -> DataFrame:
    """(id, fp, root, component_id) for every row of (id, fp); `roots_of` gives (node, root) for the linked ones of a table of distinct `fp`.

    Copies of one fingerprint, and fingerprints of one component, are dealt over salts where they are joined.
    """
    salted = marked.withColumn("__salt", salt("id"))
    parts = SharedTable(salted.groupBy("fp", "__salt").agg(F.min("id").alias("first")), "parts")
    values = SharedTable(parts.read().groupBy("fp").agg(F.min("first").alias("first")), "values").read()
    roots = roots_of(values.select("fp")).select(F.col("node").alias("fp"), "root")
    tied = values.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    tied = SharedTable(tied, "tied").read()
    classes = with_least(tied, "root", "first", "component_id").select("fp", "root", "component_id")
    down = parts.read().select("fp", "__salt").join(classes, "fp")
    return salted.join(down, ["fp", "__salt"]).select(F.col("id").alias(id_col), "fp", "root", "component_id")


def hexadecimal(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def deduplicate(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input without all but one document of each component; the smallest id stays.

    Of repeated rows of the id that stays one is kept. Rows without an id stay only where
    their component has no id at all, one for each such component.
    """
    found = SharedTable(simhash_components(docs, id_col, text, shingle, distance), "components").read()
    return survivors(docs, found, lambda x: fingerprints(x, "text", shingle, "fp"), id_col, text)


def survivors(docs: DataFrame, found: DataFrame, mark, id_col: str, text: str) -> DataFrame:
    """The documents that stay of the components; `mark` turns a column `text` into `fp`."""
    # a written table: the planner knows its size, and broadcasts it only where it is small
    gone = SharedTable(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone").read()
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    repeated = SharedTable(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated").read()
    if not repeated.isEmpty():
        kept = kept.join(repeated, id_col, "left_anti").union(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
    if not found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).isEmpty():
        # the input's columns travel as one struct, so that no name of theirs can clash
        alone = docs.where(F.col(id_col).isNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
        free = found.where("component_id is null").select("fp", "root").distinct()
        kept = kept.unionByName(mark(alone).join(free, "fp").dropDuplicates(["root"]).select("row.*"))
    return kept.select(*docs.columns)
