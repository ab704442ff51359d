"""Toxicity: a linear classifier whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SharedTable, unit_hash
from ._text import WORD, RangeHash, byte_view, chunks, runs, text_of

#: Identity terms of four languages; a term is swapped for the next one of its line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male", "nonbinary"),
    ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "junge"),
    ("schwul", "hetero", "lesbisch"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("schwarze", "weiße", "asiaten"),
    ("türken", "deutsche", "polen", "syrer"),
    ("flüchtlinge", "bürger", "einwanderer"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("fille", "garçon"),
    ("homosexuel", "hétérosexuel", "lesbienne"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "asiatiques"),
    ("algériens", "français", "marocains"),
    ("réfugiés", "citoyens", "immigrés"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("chica", "chico"),
    ("homosexual", "heterosexual", "lesbiana"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos", "asiáticos"),
    ("gitanos", "españoles", "mexicanos"),
    ("refugiados", "ciudadanos", "inmigrantes"),
)
#: Besides whole words, their first so many bytes are features: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and a bias in log-odds."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.StringArray) -> np.ndarray:
        """Probabilities of toxicity of lower-cased texts."""
        rows, places = self.found(column)
        logits = self.bias + np.bincount(rows, weights=self.weights[places], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def found(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place of a feature) of lower-cased texts."""
        rows, hashes = features_of(column, self.features)
        places = np.searchsorted(self.features, hashes)
        pairs = np.unique(rows * max(1, len(self.features)) + places)
        return pairs // max(1, len(self.features)), pairs % max(1, len(self.features))


def features_of(column: pa.StringArray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of lower-cased texts and of their prefixes; only of `wanted` (sorted) hashes if given."""
    data, offsets = byte_view(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, rows = runs(WORD[data], offsets)
    hashed = RangeHash(data)
    out_rows, out = [], []
    sieve = np.zeros(1 << 20, bool)
    if wanted is not None:
        sieve[wanted >> np.uint64(44)] = True
    for length in (None, *PREFIXES):
        if length is None:
            r, h = rows, hashed(starts, ends)
        else:
            long = ends - starts > length
            r, h = rows[long], hashed(starts[long], starts[long] + length, length)
        if wanted is not None:
            likely = sieve[h >> np.uint64(44)]
            r, h = r[likely], h[likely]
            place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            same = wanted[place] == h if len(wanted) else np.zeros(len(h), bool)
            r, h = r[same], h[same]
        out_rows.append(r)
        out.append(h)
    return np.concatenate(out_rows), np.concatenate(out)


def learning(id_col: str = "doc_id") -> F.Column:
    """Rows that may be learned from; the other quarter is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


class Swaps:
    """Identity terms, each with the one that it is swapped for."""

    def __init__(self, lines: Sequence[Sequence[str]]):
        self.after: dict[str, str] = {}
        for line in lines:
            for i, term in enumerate(line):
                self.after.setdefault(term, line[(i + 1) % len(line)])
        self.terms = sorted(set(self.after) | set(self.after.values()))
        words = "|".join(map(re.escape, sorted(self.after, key=len, reverse=True)))
        self.pattern = re.compile(rf"(?<!\w)(?:{words})(?!\w)" if words else r"(?!)")

    def swapped(self, text: str) -> str | None:
        """The counterfactual of a lower-cased text; None without identity terms."""
        new, n = self.pattern.subn(lambda m: self.after[m[0]], text)
        return new if n else None


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    most_features: int = 4096,
    least_z: float = 6.0,
    swap_penalty: float = 1.0,
    balance: float = 0.5,
    seed: int = 5,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """A model of `labels.toxic`, from learning rows only.

    Bound: about `per_class` labelled documents of each class are used, chosen by a hash of
    doc_id; the classes are weighted by their true shares (`balance` 0), by equal ones (1), or
    between, so that rare toxic texts with a single mark still count. Features are the words and
    prefixes whose document frequencies differ most between the classes, and the identity terms.

    `swap_penalty` times the squared change of the log-odds is added to the loss for counterfactual
    pairs: a sampled text that holds identity terms and its swapped form (weighted to a mean
    over these texts); and, as few texts hold any, a term put into a sampled text and the term
    that it is swapped for in its place, and for clean texts the text without it (weighted
    to a sum over the terms of their means). So terms that come along with toxic labels don't raise the score
    of neutral mentions.

    Several labels of a document count as toxic if one is; null labels and null texts are not
    learned from. Without rows of both classes the model is a constant: the share of toxic
    rows (zero without rows).
    """
    known = labels.where("doc_id is not null and toxic is not null").where(learning()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = SharedTable(known, "labels").read()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = sizes.get(1, 0) / max(1, total)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if share == 1 else -40.0)
    rate = F.when(F.col("toxic") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    # a written table of about 2 * per_class ids: the planner knows its size
    chosen = SharedTable(known.where(unit_hash(F.col("doc_id"), seed=seed) < rate), "chosen").read()
    sample = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("text", "toxic")
    sample = SharedTable(sample, "sample").read()

    count = F.col("toxic_rows") + F.col("clean_rows")
    drawn = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    a, b = max(1, drawn.get(1, 0)), max(1, drawn.get(0, 0))
    share = count / (a + b)
    z = (F.col("toxic_rows") / a - F.col("clean_rows") / b) / F.sqrt(share * (1 - share) * (1 / a + 1 / b) + 1e-12)
    best = sample.mapInArrow(_counts, "feature long, toxic_rows long, clean_rows long").groupBy("feature").agg(F.sum("toxic_rows").alias("toxic_rows"), F.sum("clean_rows").alias("clean_rows"))
    best = best.where(count >= 3).select("feature", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most_features)
    swaps = Swaps(terms)
    picked = np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64)
    model = Model(np.union1d(picked, features_of(pa.array(swaps.terms, pa.string()))[1]), np.zeros(0), 0.0)
    rows = sample.mapInArrow(lambda it: _examples(it, model, swaps), "toxic int, own array<int>, swapped array<int>, term int").collect()
    share = sizes[1] / total
    share += (0.5 - share) * balance
    weight = {1: share / a, 0: (1 - share) / b}
    toxic, weights = np.array([r["toxic"] for r in rows], float), np.array([weight[r["toxic"]] for r in rows])
    model.weights, model.bias = train([r["own"] for r in rows], toxic, weights, counterfactuals(rows, model, swaps), len(model.features), swap_penalty)
    return model


def counterfactuals(rows: list, model: Model, swaps: Swaps) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, features gained, features lost) of each pair."""
    of_term = {t: x for t, x in zip(swaps.terms, _lists(model, pa.array(swaps.terms, pa.string())))}
    pairs, put = [], Counter(r["term"] for r in rows if r["term"] is not None)
    clean = Counter(r["term"] for r in rows if r["term"] is not None and not r["toxic"])
    real = sum(r["swapped"] is not None for r in rows)
    for r in rows:
        own = np.array(r["own"], np.int64)
        if r["swapped"] is not None:
            pairs.append((1 / real, np.setdiff1d(r["swapped"], own), np.setdiff1d(own, r["swapped"])))
        if r["term"] is not None:
            term = swaps.terms[r["term"]]
            here, there = (np.setdiff1d(of_term[t], own) for t in (term, swaps.after[term]))
            pairs.append((1 / put[r["term"]], np.setdiff1d(here, there), np.setdiff1d(there, here)))
            if not r["toxic"]:
                pairs.append((1 / clean[r["term"]], here, here[:0]))
    return [p for p in pairs if len(p[1]) or len(p[2])]


def _counts(batches):
    for batch in chunks(batches, "text"):
        column = text_of(batch, "text", lower=True)
        toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
        rows, hashes = features_of(column)
        kinds, codes = np.unique(hashes, return_inverse=True)
        pairs = np.unique(codes.astype(np.int64) * len(column) + rows)
        code, row = pairs // max(1, len(column)), pairs % max(1, len(column))
        n = np.bincount(code, minlength=len(kinds))
        bad = np.bincount(code, weights=toxic[row], minlength=len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(n - bad)], ["feature", "toxic_rows", "clean_rows"])


def _examples(batches, model: Model, swaps: Swaps):
    """Features of each text and of its counterfactual (null without identity terms), and the number of a term to put into it."""
    for batch in chunks(batches, "text"):
        column = text_of(batch, "text", lower=True)
        own = _lists(model, column)
        texts = column.to_pylist()
        new = [swaps.swapped(x) for x in texts]
        other = _lists(model, pa.array([x or "" for x in new], pa.string()))
        kind = pa.list_(pa.int32())
        terms = [zlib.crc32(x.encode()) % len(swaps.terms) if swaps.terms else None for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, kind), pa.array([o if x is not None else None for o, x in zip(other, new)], kind), pa.array(terms, pa.int32())], ["toxic", "own", "swapped", "term"])


def _lists(model: Model, column: pa.StringArray) -> list[np.ndarray]:
    rows, places = model.found(column)
    return np.split(places.astype(np.int32), np.searchsorted(rows, np.arange(1, len(column))))


def train(own: list, labels: np.ndarray, weights: np.ndarray, pairs: list, n: int, swap_penalty: float, rounds: int = 1000, step: float = 0.1, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
    """Adam on weighted logistic loss, plus the penalty on the pairs' squared changes of log-odds."""
    weights = weights / weights.sum()
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    joined = lambda lists: np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])
    place = joined(own)
    gained, lost, pair_weight = [p[1] for p in pairs], [p[2] for p in pairs], np.array([p[0] for p in pairs])
    differ_pair = np.concatenate([np.repeat(np.arange(len(pairs)), [len(x) for x in lists]) for lists in (gained, lost)]).astype(np.int64)
    differ_place = np.concatenate([joined(gained), joined(lost)])
    sign = np.concatenate([np.ones(sum(map(len, gained))), -np.ones(sum(map(len, lost)))])
    w, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    prior = np.clip((weights * labels).sum(), 1e-6, 1 - 1e-6)
    w[n] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        logits = w[n] + np.bincount(row, weights=w[place], minlength=len(own))
        error = weights * (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels)
        grad = np.append(np.bincount(place, weights=error[row], minlength=n) + shrink * w[:n], error.sum())
        if len(pairs) and swap_penalty:
            change = np.bincount(differ_pair, weights=sign * w[differ_place], minlength=len(pairs))
            grad[:n] += 2 * swap_penalty * np.bincount(differ_place, weights=sign * (pair_weight * change)[differ_pair], minlength=n)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every whole text, 0 to 1. Null counts as empty, and an empty text gets the score of no evidence.

    Repeated rows and null ids get a row each; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def apply(batches):
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(text_of(batch, text, lower=True)), pa.float64())], [id_col, "score"])

    return docs.select(id_col, text).mapInArrow(apply, schema)


def keep_below(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows that score under the threshold, with all their columns, whatever their names.

    Null texts count as empty, whole texts of any length are scored, repeated rows and null ids stay or go like others, and an empty table gives no rows.
    """

    def apply(batches):
        for batch in chunks(batches, text):
            yield batch.filter(pa.array(model.scores(text_of(batch, text, lower=True)) < threshold))

    return docs.mapInArrow(apply, docs.schema)
