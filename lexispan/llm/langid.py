"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SharedTable, unit_hash
from ._text import byte_view, chunks, text_of

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 12, 6
#: Windows of a text overlap so that every n-gram of the widest filter lies in one of them.
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


@dataclass
class Network:
    """Byte embedding, filters of several widths (padded to the widest), max pooling, and a softmax layer."""

    languages: list[str]
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # widest * DEPTH x all filters
    bias: np.ndarray
    dense: np.ndarray  # all filters x languages
    offset: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int) -> Network:
        rng, wide, n = np.random.default_rng(seed), max(WIDTHS), len(WIDTHS) * FILTERS
        f = np.float32
        return Network(languages, rng.normal(0, 0.5, (256, DEPTH)).astype(f), (rng.normal(0, 0.3, (wide * DEPTH, n)) * used()).astype(f), np.zeros(n, f), rng.normal(0, 0.1, (n, len(languages))).astype(f), np.zeros(len(languages), f))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest filter outputs over the positions of each window, where they are, and the inputs of the filters."""
        inside = patches(self.embedding[windows])
        out = (inside.reshape(-1, inside.shape[2]) @ self.filters).reshape(*inside.shape[:2], -1)
        return out.max(1), out, inside

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.pooled(windows[i : i + 128])[0] + self.bias, 0) for i in range(0, len(windows), 128)]
        return np.concatenate(parts) @ self.dense + self.offset

    def predict(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language and its probability, from all windows of each text."""
        data, offsets = byte_view(column)
        windows, rows = windows_of(data, offsets)
        sums = np.zeros((len(column), len(self.languages)))
        np.add.at(sums, rows, self.logits(windows))
        mean = sums / np.maximum(1, np.bincount(rows, minlength=len(column)))[:, None]
        chance = np.exp(mean - mean.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        return chance.argmax(1), chance.max(1)


def used() -> np.ndarray:
    """Ones where a filter of its width has weights."""
    mask = np.zeros((max(WIDTHS) * DEPTH, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * DEPTH, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def patches(embedded: np.ndarray) -> np.ndarray:
    """The widest filter's input at each position of each window."""
    flat = np.ascontiguousarray(embedded).reshape(len(embedded), -1)
    view = np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * DEPTH, axis=1)
    return view[:, ::DEPTH]


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All fixed-length windows of the texts, ends filled with zero bytes, and their rows."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    rows = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    starts = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * STRIDE
    places = starts[:, None] + np.arange(WINDOW)
    inside = places < offsets[1:][rows][:, None]
    if not len(data):
        return np.zeros(places.shape, np.uint8), rows
    return np.where(inside, data[np.minimum(places, len(data) - 1)], 0).astype(np.uint8), rows


def train(languages: list[str], windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = 8, seed: int = 2) -> Network:
    """Adam on weighted cross-entropy; gradients go through the pooled positions alone."""
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    names, mask, t = ("embedding", "filters", "bias", "dense", "offset"), used(), 0
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            at = order[i : i + 64]
            top, out, inside = net.pooled(windows[at])
            where = out.argmax(1)
            hidden = np.maximum(top + net.bias, 0)
            logits = hidden @ net.dense + net.offset
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(at)), labels[at]] -= 1
            error = (chance * weights[at][:, None] / len(at)).astype(np.float32)
            back = (error @ net.dense.T) * (hidden > 0)
            taken = inside[np.arange(len(at))[:, None], where]  # window x filter x patch
            grads = {"dense": hidden.T @ error, "offset": error.sum(0), "bias": back.sum(0), "filters": np.einsum("wf,wfp->pf", back, taken) * mask}
            spread = (back[:, :, None] * net.filters.T[None]).reshape(len(at), back.shape[1], max(WIDTHS), DEPTH)
            grads["embedding"] = np.zeros_like(net.embedding)
            bytes_at = windows[at][np.arange(len(at))[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))]
            np.add.at(grads["embedding"], bytes_at, spread)
            t += 1
            for k in names:
                first, second = moments[k]
                first += 0.1 * (grads[k] - first)
                second += 0.001 * (grads[k] ** 2 - second)
                getattr(net, k)[...] -= 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, per_language: int = 500, windows_per_text: int = 4, seed: int = 2) -> Network | None:
    """A network of `lang`, from learning rows (crc32 of doc_id modulo 4 is not 2) alone.

    Bounds: about `per_language` documents of each language, chosen by a hash of doc_id,
    give `windows_per_text` windows each; every language is learned. Rows without text or
    lang are not learned from. None without rows.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    sizes = SharedTable(known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("rate")), "languages").read()
    # one row a language
    chosen = known.select("doc_id", "lang", "text").join(sizes, "lang").where(unit_hash(F.col("doc_id"), seed=seed) < F.col("rate"))
    place = lambda k: F.floor(unit_hash(F.col("doc_id"), F.lit(k), seed=seed) * F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    drawn = chosen.select("lang", F.explode(F.array(*[F.substring(F.col("text"), place(k), F.lit(WINDOW)) for k in range(windows_per_text)])).alias("window")).collect()
    languages = sorted({r["lang"] for r in drawn})
    if not drawn:
        return None
    windows = np.zeros((len(drawn), WINDOW), np.uint8)
    for i, r in enumerate(drawn):
        raw = np.frombuffer(r["window"].encode()[:WINDOW], np.uint8)
        windows[i, : len(raw)] = raw
    labels = np.array([languages.index(r["lang"]) for r in drawn])
    counts = np.bincount(labels, minlength=len(languages))
    return train(languages, windows, labels, (len(drawn) / len(languages) / counts)[labels])


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every whole text, from the text alone.

    `und` with score 0 for texts that are null or have no letter, and for all texts
    without a network. Repeated rows and null ids get a row each; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def apply(batches):
        for batch in chunks(batches, text, 1 << 20):
            column = text_of(batch, text)
            known = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            names, scores = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            if network is not None and known.any():
                best, chance = network.predict(column)
                names[known], scores[known] = np.array(network.languages, object)[best[known]], chance[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text).mapInArrow(apply, schema)
