"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, langid, license_scan, mixing, repeats, resample, secret_scan, simhash, spotsigs, tiered, topk, toxicity
from ._spark import in_small_batches, load

#: Fixed value: the rank file of the byte-level BPE query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_files(name: str = RANKS) -> tuple[str, str]:
    """Path of a public rank file, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def held_out() -> F.Column:
    """Whether a document's rows may not be learned from."""
    return (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.find_secrets(docs, settings=secret_scan.learned(docs)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(), "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.recognise(load(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(load(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return resample.resample(docs, resample.fit(docs, load(spark, sf_dir, "labels")))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(load(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), *tokenizer_files())


def op11_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return repeats.remove_repeats(load(spark, sf_dir, "documents"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode(load(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_language_id,
        op3_source_mixing,
        op4_license_scan,
        op5_toxicity,
        op6_block_topk,
        op7_simhash_components,
        op8_importance_resampling,
        op9_spotsigs,
        op10_byte_bpe,
        op11_repeat_removal,
        op12_tiered_search,
        op13_vector_codes,
    )
}

#: The others can't be expressed in SQL; tests hold them against brute-force versions, round trips or held-out labels.
ORACLE_SQL = {
    "op3_source_mixing": mixing.mix_sql(),
    "op4_license_scan": license_scan.recognise_sql(),
    "op6_block_topk": topk.top_k_sql(),
    "op9_spotsigs": spotsigs.compare_edited_sql(),
    "op12_tiered_search": tiered.search_sql(),
    "op13_vector_codes": codebooks.encode_sql(),
}
