"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lexispan.llm import bpe, mixing, near_copies, queries, secret_scan, toxicity
from lexispan.llm._spark import SharedTable, in_small_batches, load

#: Fixed value: documents that score this or more are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the learning rows of the tables in sf_dir, and drops the documents that score as toxic."""
    model = toxicity.fit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash blocks over five-word shingles, and all pairs of a Jaccard likeness of 0.8 or more."""
    return near_copies.deduplicate(docs, least=0.8, shingle=5, distance=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in it don't."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that every source has an equal share, in a shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, *queries.tokenizer_files())


def sized(stage):
    """The stage, in a session whose batches of texts are small."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", sized(reject_toxic)),
    ("simhash_near_dedup", sized(drop_near_duplicates)),
    ("secret_scan", sized(redact_secrets)),
    ("source_mixing", sized(mix_sources)),
    ("byte_bpe", sized(encode_tokens)),
]

#: No SQL: a trained classifier, zstandard and byte-level BPE aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = SharedTable(stage(spark, docs, sf_dir), name).read()
    return docs
