import duckdb
import pytest

from lexispan.llm import queries

TABLES = ("documents", "embeddings", "labels", "benchmark")
SF = "/root/testdata/sf0.001"


def shown(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    expected = sorted(tuple(shown(r[theirs.index(c)]) for c in names) for r in found.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(*names).collect()) == expected


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def test_contract_columns(spark):
    wanted = {
        "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op6_block_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op7_simhash_components": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op9_spotsigs": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op11_repeat_removal": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op12_tiered_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op10_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, columns in wanted.items():
        types = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert columns.items() <= types.items(), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, SF)
        assert after.columns == docs.columns, name
        step = after
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)


@pytest.mark.parametrize("rows", ["edge", "none"])
def test_pipeline_stages_in_a_row_over_edges(spark, request, rows, tmp_path):
    """All stages over nulls, empty and long texts, repeats and clashing names, and over an empty table."""
    import corpus_pipeline

    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (7, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, step, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns, name
        step = corpus_pipeline.SharedTable(after, "edge").read()
    assert (step.count() > 0) == (rows == "edge")


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
@pytest.mark.parametrize("rows", ["edge", "none"])
def test_queries_over_edges(spark, request, rows, tmp_path, name):
    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, [1.0, 2.0]), (1, None)] if rows == "edge" else [], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    query = next(q for n, q in queries.QUERIES.items() if n.startswith(f"{name}_"))
    found = query(spark, str(tmp_path)).collect()
    assert len(found) == 0 if rows == "none" or name == "op6" else name == "op3" or len(found) == 13


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    calm = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert calm.count() < docs.count()
    twice = docs.union(docs.limit(20).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, SF)
    assert kept.where("doc_id >= 1000000").count() == 0
    assert corpus_pipeline.redact_secrets(spark, docs, SF).where("text like '%[SECRET]%'").count() > 0
    assert labels.count() > 0


def test_pipeline_equals_brute_force(spark):
    import hashlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    import tiktoken
    from test_mixing import brute_count
    from test_near_copies import brute_components

    from lexispan.llm import bpe, secret_scan, toxicity

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "source").collect()
    scores = toxicity.fit(docs, labels).scores(pa.array([r["text"].lower() for r in rows]))
    rows = [r for r, s in zip(rows, scores) if s < 0.3]
    first = brute_components(sorted((r["doc_id"], r["text"]) for r in rows))
    rows = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]

    def redacted(text):
        out, at = "", 0
        for _, a, b in secret_scan.spans_of(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    sources = [r["source"] for r in rows]
    means = {s: len(rows) / len(set(sources)) / sources.count(s) for s in set(sources)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    expected = []
    for r in rows:
        text = redacted(r["text"])
        ids = encoder.encode_ordinary(text)
        row = (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        expected += [row] * brute_count(17, r["doc_id"], means[r["source"]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(expected)
