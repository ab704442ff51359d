"""Near copies by word shingles: SimHash blocks first, then every other pair whose exact Jaccard likeness reaches the bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._spark import SharedTable, connected_components, with_least
from ._text import RangeHash, byte_view, chunks, mixed, runs, text_of
from .spotsigs import pruned_jaccard

#: Documents in expectation that show which shingles are common, and most of those that are kept: the choice changes the work, never the result.
SAMPLE, COMMON, MOST_COMMON = 4_000, 4, 100_000
#: A shingle that more prefixes share counts as common, and prefixes are chosen anew, so many times at most.
LIMIT, REORDERS = 1024, 2
#: Rounds in which groups are compared with some of their sets, before what is left of them is compared in full; groups of up to FULL sets take one such round.
PIVOT_ROUNDS, PIVOTS, FULL = 2, 8, 64
#: Sets of a share of a group that is compared in full.
SHARE = 512
#: Sets that choose the centre of a large group, at most: the choice changes the work, never the result.
CENTRE = 64
#: Shingles of a set's sketch, about, and the share of them that a set near the centre of its group holds of it, at least, as 1 / NEAR: the choice changes the work, never the result.
SKETCH, NEAR = 24, 3
#: Shingles of a bucket of a set's histogram, at most, and least and most bits of its buckets' numbers.
FILLED, LEAST_BITS, MOST_BITS = 4, 6, 13
#: Bytes of text that are worked on at once.
SLICE = 1 << 19
#: Odd multipliers of the words of a shingle.
STEP = 0xD6E8FEB86659FD93

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def shingles(column: pa.StringArray, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all word shingles, repeats included, of texts with A-Z lower-cased; fewer words, or none, are one shingle."""
    data, offsets = byte_view(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, rows = runs(~_WHITE[data], offsets)
    words, n = RangeHash(data)(starts, ends), len(starts)
    counts = np.bincount(rows, minlength=len(column))
    found, length = np.zeros(n, np.uint64), np.minimum(counts, shingle)
    for k in range(min(shingle, n)):
        same = rows[k:] == rows[: n - k]
        found[: n - k] += np.where(same, words[k:] * np.uint64(pow(STEP, k + 1, 1 << 64)), np.uint64(0))
    place = np.arange(n) - (np.cumsum(counts) - counts)[rows]
    whole = place + length[rows] <= counts[rows]
    none = np.flatnonzero(counts == 0)
    hashes = mixed(found + length[rows].astype(np.uint64))[whole]
    return np.concatenate([rows[whole], none]), np.concatenate([hashes, np.zeros(len(none), np.uint64)])


class Sets:
    """The distinct shingles of each row, common ones last, and what is derived from them."""

    def __init__(self, column: pa.StringArray, shingle: int, common: dict[int, int] | None = None):
        rows, hashes = shingles(column, shingle)
        items = sorted((common or {}).items())
        keys, counts = (np.array([x[i] for x in items] + [0], np.int64) for i in (0, 1))
        signed = hashes.view(np.int64)
        at = np.searchsorted(keys[:-1], signed)
        order = np.lexsort((signed, np.where(keys[at] == signed, counts[at], 0) if items else np.zeros(len(rows)), rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        self.all_rows, self.all_hashes = rows, hashes
        self.rows, self.hashes = rows[new], hashes[new]
        self.sizes = np.bincount(self.rows, minlength=len(column))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def names(self) -> np.ndarray:
        """A 64-bit name of each set, whatever its order."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        total = np.add.reduceat(mixed(self.hashes ^ np.uint64(STEP)), self.starts)
        return mixed(total + self.sizes.astype(np.uint64)).view(np.int64)

    def fingerprints(self) -> np.ndarray:
        """SimHash: the 64 majority bits of the shingles, repeats included."""
        counts = np.bincount(self.all_rows, minlength=len(self.sizes))
        ones = np.zeros((len(counts), 64), np.int64)
        for a in range(0, len(self.all_rows), 1 << 18):  # slices bound the unpacked bits
            rows = self.all_rows[a : a + (1 << 18)]
            bits = np.unpackbits(self.all_hashes[a : a + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            ones[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<i8").ravel()

    def histograms(self) -> pa.ListArray:
        """How many shingles of each set fall in each of its buckets: two sets share at most the sum of their lesser counts.

        The number of buckets is a power of two that grows with the set. Empty where a count exceeds a byte.
        """
        bits = np.clip(np.ceil(np.log2(np.maximum(self.sizes, 1) / FILLED)), LEAST_BITS, MOST_BITS).astype(np.int64)
        ends = np.cumsum(1 << bits)
        first = ends - (1 << bits)
        counts = np.bincount(first[self.rows] + (self.hashes >> (64 - bits[self.rows]).astype(np.uint64)).astype(np.int64), minlength=ends[-1] if len(ends) else 0)
        full = np.zeros(len(bits), bool)
        full[np.searchsorted(ends, np.flatnonzero(counts > 127), "right")] = True
        kept = ~np.repeat(full, 1 << bits)
        offsets = np.concatenate([[0], np.cumsum(np.where(full, 0, 1 << bits))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts[kept].astype(np.int8)))

    def sketches(self) -> pa.ListArray:
        """Of each set the shingles of the least hashes, about SKETCH of them, as the hashes' low halves. Sets of like sizes that share most shingles share most of these."""
        bound = np.where(self.sizes <= SKETCH, 2.0**64 - 2048, SKETCH / np.maximum(self.sizes, 1) * 2.0**64).astype(np.uint64)
        chosen = self.hashes <= bound[self.rows]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.rows[chosen], minlength=len(self.sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.hashes[chosen].astype(np.uint32).view(np.int32)))

    def lists(self, least: float | None = None) -> pa.ListArray:
        """The whole sets, or their prefixes: two sets that are `least` alike share one of these first shingles."""
        taken = self.sizes if least is None else prefix_length(self.sizes, least)
        chosen = np.arange(len(self.rows)) - self.starts[self.rows] < taken[self.rows]
        offsets = np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.hashes[chosen].view(np.int64)))


def prefix_length(n, least: float):
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def named(docs: DataFrame, text: str = "text", shingle: int = 5, into: str = "fp") -> DataFrame:
    """The input's columns without the text, and the name of its shingle set. Null text counts as empty."""
    return _sets(docs, text, shingle, into).drop("__n", "__sim", "__buckets", "__sketch", "__sigs")


def common_shingles(docs: DataFrame, text: str, shingle: int) -> dict[int, int]:
    """Shingles that several documents of a sample hold, with their counts."""
    part = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else docs

    def apply(batches):
        for batch in chunks(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(Sets(text_of(batch, text), shingle).hashes.view(np.int64))], ["sig"])

    often = drawn.select(text).mapInArrow(apply, "sig long").groupBy("sig").count().where(F.col("count") >= COMMON)
    return {r["sig"]: r["count"] for r in often.orderBy(F.desc("count"), "sig").limit(MOST_COMMON).collect()}


def _sets(docs: DataFrame, text: str, shingle: int, into: str, keep: str = "", least: float = 0.8, common: dict[int, int] | None = None) -> DataFrame:
    """Without the text, with `into`, `__n`, and as `__sigs` the whole set, or its prefix along with `__sim`, `__buckets` and `__sketch`, or nothing."""
    others = [c for c in docs.columns if c not in (text, into)]
    schema = T.StructType(
        [docs.schema[c] for c in others]
        + [T.StructField(into, T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("__sim", T.LongType()), T.StructField("__buckets", T.ArrayType(T.ByteType())), T.StructField("__sketch", T.ArrayType(T.IntegerType())), T.StructField("__sigs", T.ArrayType(T.LongType()))]
    )

    def apply(batches):
        for batch in chunks(batches, text, SLICE):
            sets = Sets(text_of(batch, text), shingle, common)
            n = batch.num_rows
            sims = sets.fingerprints() if keep == "prefix" else np.zeros(n, np.int64)
            buckets = sets.histograms() if keep == "prefix" else pa.nulls(n, pa.list_(pa.int8()))
            sketch = sets.sketches() if keep == "prefix" else pa.nulls(n, pa.list_(pa.int32()))
            sigs = sets.lists(None if keep == "set" else least) if keep else pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sets.names()), pa.array(sets.sizes, pa.int32()), pa.array(sims), buckets, sketch, sigs], schema.names)

    return docs.select(*others, text).mapInArrow(apply, schema)


def simhash_pairs(sets: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints lie within the distance: those of each fingerprint in a star, and one pair for each link."""
    stars = with_least(sets.select("sim", "fp"), "sim", "fp", "one")
    first = sets.groupBy("sim").agg(F.min("fp").alias("fp"))
    near = simhash.links(first.select(F.col("sim").alias("fp")), distance)
    one, two = (first.select(F.col("sim").alias(c), F.col("fp").alias(f"{c}_fp")) for c in "ab")
    return _ordered(stars.select("one", "fp")).union(_ordered(near.join(one, "a").join(two, "b").select("a_fp", "b_fp")))


def _ordered(pairs: DataFrame) -> DataFrame:
    x, y = pairs.columns
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def most_shared(a: str, b: str) -> F.Column:
    """How many shingles two sets share at most, by their histograms, of which the finer one is halved."""
    halved = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), lambda i: F.get(x, 2 * i).cast("int") + F.get(x, 2 * i + 1))
    even = lambda x, y: F.when(F.size(x) > F.size(y), halved(x)).otherwise(F.col(x).cast("array<int>"))
    shared = F.aggregate(F.zip_with(even(a, b), even(b, a), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (F.greatest(F.size(a), F.size(b)) > 2 * F.least(F.size(a), F.size(b))), 1 << 30).otherwise(shared)


def likeness_roots(docs: DataFrame, sets: DataFrame, index: DataFrame, least: float, shingle: int, distance: int) -> DataFrame:
    """(node, root) of the components that all pairs of sets make that are `least` alike; sets without such a pair have no row.

    Candidates are the SimHash links, and sets that share a shingle of their prefixes at places
    that allow the likeness. Histograms rule out most of those that are too unlike, and the
    rest is verified on the whole sets. A group that shares a shingle is compared with one, then with some,
    of its sets first. Sets that are linked by then aren't compared with each other. What stays open of large groups is
    indexed anew by what sets each set apart from its group; there, too, groups are compared with some of their sets first, and all pairs
    that remain open are compared.
    """
    need = lambda m, n: (F.col(m) + F.col(n)) * F.lit(least / (1 + least)) - 1e-6

    def likely(pairs):
        one, two = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"{c}_n"), F.col("buckets").alias(f"{c}_buckets")) for c in "ab")
        both = pairs.join(one, "a").join(two, "b")
        return both.where(most_shared("a_buckets", "b_buckets") >= need("a_n", "b_n")).select("a", "b")

    def whole(ends):
        """A table (fp, set) of the sets that are named."""
        named = SharedTable(ends.distinct(), "ends")
        ends = named.read()
        # written tables: the planner knows their sizes, and texts are only shuffled where many are wanted
        asked = SharedTable(sets.join(ends, "fp", "left_semi").select(F.col("first").alias("id")).distinct(), "wanted")
        wanted = asked.read()
        texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]), "left_semi")
        held = _sets(texts, "text", shingle, "fp", "set").join(ends, "fp", "left_semi").groupBy("fp").agg(F.first("__sigs").alias("set"))
        held = SharedTable(held, "sets")
        for table in (named, asked):
            table.drop()
        return held

    def near(pairs):
        candidates = SharedTable(likely(pairs), "candidates")
        pairs = candidates.read()
        held = whole(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))
        one, two = (held.read().select(F.col("fp").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
        found = SharedTable(pairs.join(one, "a").join(two, "b").where(pruned_jaccard("a_set", "b_set", least) >= least).select("a", "b"), "near").read()
        for table in (candidates, held):
            table.drop()
        return found

    def settled(index, edges, member, fits, apart):
        """The roots of the edges and of all pairs of the index; with `apart`, large groups that stay open go on to another index."""

        def pairs_of(groups, other, *share, once=F.lit(True)):
            x, y = groups.select("sig", *share, member.alias("x")), other.select("sig", *share, F.col("p").alias("y"))
            return _ordered(x.join(y, ["sig", *share]).where((F.col("x")["root"] != F.col("y")["root"]) & fits & once).select(F.col("x.fp").alias("x"), F.col("y.fp").alias("y")))

        def with_pivots(groups, turn, n):
            order = Window.partitionBy("sig").orderBy(F.xxhash64("fp", F.lit(turn)))  # a rank limit: each task passes on n rows a group
            return pairs_of(groups, groups.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).select("sig", member.alias("p")))

        def in_full(groups, close=F.lit(False)):
            """All pairs but those of two close sets. A group is dealt over shares of SHARE sets, and all its sets are sent to each share, so a hot shingle's pairs are made in many tasks."""
            shares = F.ceil(F.col("rows") / SHARE).cast("int")
            dealt = groups.where(~close).withColumn("share", F.pmod(F.xxhash64("fp"), shares).cast("int"))
            every = groups.select("sig", member.withField("close", close).alias("p"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
            return pairs_of(dealt, every, "share", once=F.col("y")["close"] | (F.col("x")["fp"] < F.col("y")["fp"]))

        if edges is None:
            pivots = index.withColumn("root", F.col("fp"))
            pivots = pairs_of(pivots, pivots.groupBy("sig").agg(F.min_by(member, F.xxhash64("fp", F.lit(0))).alias("p")))
            edges = near(pivots.union(simhash_pairs(sets, distance)).distinct())
        for turn in range(1, PIVOT_ROUNDS + 1):
            roots = SharedTable(connected_components(edges), "roots").read()
            rooted = index.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            large = F.count("*") > FULL
            still = rooted.groupBy("sig").agg((F.min("root") != F.max("root")).alias("open"), large.alias("large"), F.count("*").alias("rows")).where("open and large" if turn > 1 else "open")
            opened = SharedTable(still.select("sig", "large", "rows"), "open")
            still = opened.read()
            if still.isEmpty():
                return roots
            gathered = SharedTable(rooted.join(still, "sig"), "groups")
            groups = gathered.read()
            # the roots stand for all links so far
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            if turn == PIVOT_ROUNDS and apart:
                return again(groups, known, in_full)
            more = in_full(groups if turn == PIVOT_ROUNDS else groups.where("not large"))
            more = more if turn == PIVOT_ROUNDS else more.union(with_pivots(groups.where("large"), turn, PIVOTS))
            edges = near(more.distinct()).union(known)
            opened.drop()
            gathered.drop()
        return connected_components(edges)

    def near_centre(members):
        """Those whose sketch holds enough of what over half of up to CENTRE sketches of their group hold, if they are over FULL of it."""
        sketched = members.join(sets.select("fp", "sketch"), "fp")
        drawn = sketched.withColumn("__n", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("fp")))).where(F.col("__n") <= CENTRE)
        drawn = SharedTable(drawn.select("of", "sketch"), "sketches")
        often = drawn.read().select("of", F.explode("sketch").alias("value")).groupBy("of", "value").count()
        often = often.join(drawn.read().groupBy("of").agg(F.count("*").alias("all")), "of").where(2 * F.col("count") > F.col("all"))
        centres = often.groupBy("of").agg(F.collect_list("value").alias("centre"))
        close = sketched.join(centres, "of").where(NEAR * F.size(F.array_intersect("sketch", "centre")) >= F.size("sketch"))
        close = SharedTable(close.select(*members.columns), "close")
        many = close.read().groupBy("of").count().where(F.col("count") > FULL).select("of")
        return close.read().join(many, "of")

    def again(groups, known, in_full):
        """The roots of what stays open of large groups. Sets that are near the centre of their group are compared by how they differ from it, and all other pairs in full.

        Sketches tell which sets are near; the choice changes the work, never the result, as sets that share a common passage and little else differ from any centre by most of what they hold.
        Let d be a near set's symmetric difference to the centre, whatever that is, c = (1 - least) / (1 + least) and s = |d| - c * n. Two sets are `least` alike where their
        differences share (s + s') / 2 values or more. So if s + s' is at most 0, both are like the set of the least s, and one comparison with that
        one serves them all. All other pairs share a value, and one of the rarest of each, which few sets of a group of near copies do.
        """
        c = F.lit((1 - least) / (1 + least))
        first = SharedTable(groups.groupBy("sig").agg(F.min_by("fp", F.xxhash64("fp")).alias("of")), "first")
        grouped = groups.join(first.read(), "sig")
        members = SharedTable(near_centre(grouped.select("of", "fp", "n", "root").distinct()), "members")
        marked = grouped.join(members.read().select("of", "fp", F.lit(True).alias("close")), ["of", "fp"], "left")
        apart = SharedTable(in_full(marked.withColumn("close", F.coalesce("close", F.lit(False))), F.col("close")).distinct(), "apart")
        if members.read().isEmpty():
            return connected_components(near(apart.read()).union(known))
        held = whole(members.read().select("fp"))
        drawn = members.read().withColumn("__n", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("fp")))).where(F.col("__n") <= CENTRE)
        drawn = SharedTable(drawn.join(held.read(), "fp").select("of", "set"), "drawn")
        often = drawn.read().select("of", F.explode("set").alias("value")).groupBy("of", "value").count()
        often = often.join(drawn.read().groupBy("of").agg(F.count("*").alias("all")), "of").where(2 * F.col("count") > F.col("all"))
        centres = SharedTable(often.groupBy("of").agg(F.collect_list("value").alias("centre")), "centres")
        beside = members.read().join(held.read(), "fp").join(centres.read(), "of", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
        beside = beside.withColumn("d", F.concat(F.array_except("set", "centre"), F.array_except("centre", "set"))).withColumn("s", F.size("d") - c * F.col("n"))
        beside = SharedTable(beside.select("of", "fp", "n", "root", "d", "s"), "beside")
        bounds = SharedTable(beside.read().groupBy("of").agg(F.min_by(F.struct("fp", "root"), F.struct("s", "fp")).alias("best"), F.min("s").alias("least_s")), "bounds")
        far = F.col("s") + F.col("least_s") > 1e-6
        marked = beside.read().join(bounds.read(), "of")
        stars = _ordered(marked.where(~far & (F.col("root") != F.col("best.root"))).select(F.col("fp").alias("x"), F.col("best.fp").alias("y")))
        values = SharedTable(beside.read().select("of", "fp", F.explode("d").alias("value")), "values")
        shared = SharedTable(values.read().groupBy("of", "value").count().where("count > 1"), "shared")
        rare = values.read().join(shared.read(), ["of", "value"]).groupBy("of", "fp").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("rare"))
        rare = marked.withColumn("far", far).drop("d").join(rare, ["of", "fp"]).withColumn("m", F.size("rare"))
        # what a set shares at least with any that it is like, which has no more than n / least members
        need = F.greatest(F.lit(1), F.ceil(F.greatest((F.col("s") + F.col("least_s")) / 2, F.col("s") - c * F.col("n") / least) - 1e-6))
        index = rare.withColumn("taken", (F.col("m") - need + 1).cast("int")).where("taken > 0").select("of", "fp", "n", "m", "s", "far", F.posexplode(F.slice("rare", F.lit(1), F.col("taken"))).alias("pos", "value"))
        index = SharedTable(index.select(F.xxhash64("of", "value.value").alias("sig"), "fp", "n", "pos", "m", "s", "far"), "differences")
        for table in (first, members, held, drawn, centres, values, shared):
            table.drop()
        member = F.struct("fp", "n", "pos", "root", "m", "s", "far")
        x, y = F.col("x"), F.col("y")
        fits = (x["far"] | y["far"]) & sizes_fit & (F.least(x["m"] - x["pos"], y["m"] - y["pos"]) >= (x["s"] + y["s"]) / 2 - 1e-6)
        edges = near(stars.union(apart.read()).distinct()).union(known)
        return settled(index.read(), edges, member, fits, apart=False)

    x, y = F.col("x"), F.col("y")
    sizes_fit = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * F.lit(least) - 1e-6
    rest_fits = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= (x["n"] + y["n"]) * F.lit(least / (1 + least)) - 1e-6
    return settled(index, None, F.struct("fp", "n", "pos", "root"), sizes_fit & rest_fits, apart=True)


def components(docs: DataFrame, least: float = 0.8, shingle: int = 5, distance: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, root, component_id) as `simhash.simhash_components`; `fp` names the shingle set, and sets that are `least` alike are linked.

    SimHash fingerprints within `distance` bits give the first candidates. At a likeness of 0.8 most
    pairs differ in more bits than blocks can bridge, so the others share a shingle of
    their sets' prefixes, rare shingles first, which misses no pair. Null and empty texts are one set, and
    linked; very long texts are taken whole; repeated rows and null ids get a row each; other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    common = common_shingles(rows, "text", shingle)
    for turn in range(REORDERS + 1):
        marked = SharedTable(_sets(rows, "text", shingle, "fp", "prefix", least, common), "prefixes")
        whole = marked.read().groupBy("fp").agg(F.first("__n").alias("n"), F.first("__sigs").alias("sigs"))
        exploded = whole.select("fp", "n", F.posexplode("sigs").alias("pos", "sig"))
        index = SharedTable(exploded.withColumn("size", F.count("*").over(Window.partitionBy("sig"))).where("size > 1"), "index")
        crowded = index.read().where(F.col("size") > LIMIT).select("sig", "size").distinct().orderBy(F.desc("size"), "sig").limit(MOST_COMMON)
        more = {r["sig"]: r["size"] for r in crowded.collect()} if turn < REORDERS else {}
        if not more:
            break
        common |= {s: common.get(s, 0) + n for s, n in more.items()}
        marked.drop()
        index.drop()
    sets = marked.read().groupBy("fp").agg(F.min("id").alias("first"), F.first("__n").alias("n"), F.first("__sim").alias("sim"), F.first("__buckets").alias("buckets"), F.first("__sketch").alias("sketch"))
    sets = SharedTable(sets, "values").read()
    names = SharedTable(marked.read().select("id", "fp"), "names").read()
    marked.drop()
    roots = likeness_roots(rows, sets, index.read().drop("size"), least, shingle, distance)
    return simhash.with_components(names, lambda _: roots, id_col)


def deduplicate(docs: DataFrame, least: float = 0.8, shingle: int = 5, distance: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As `simhash.deduplicate`, with documents linked by the exact likeness of their shingles; other columns stay as they are, whatever their names."""
    found = SharedTable(components(docs, least, shingle, distance, id_col, text), "components").read()
    return simhash.survivors(docs, found, lambda x: named(x, "text", shingle, "fp"), id_col, text)
