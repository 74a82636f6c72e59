import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from gridmend.llm import pieces, queries, toxicity


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "/root/testdata/sf0.001")
        assert left.columns == docs.columns, name
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    done = corpus_pipeline.STAGES[-1][1](spark, left, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in done} == ids and all(len(r.ids) == r.n_tokens for r in done)
    assert 0 < len(ids) < docs.count()


def test_registered():
    names = queries.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_on_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    names = ["__id", "a.b", "removed", "toxicity", "hash", "fp"]
    clashing = odd.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for docs in (clashing, none):
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, docs, "/root/testdata/sf0.001")
            rows = left.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert left.columns == docs.columns, name
                assert all(r[5:] == tuple(f"kept {n}" for n in names) for r in rows if len(r) > 5), name
            assert len(rows) <= docs.count(), name
            if name in ("line_dedup", "benchmark_decontamination", "sentencepiece"):
                assert len(rows) == docs.count(), name
            if name == "simhash_near_dedup" and docs is clashing:
                # one of the rows without words, one of the repeated rows, and all of the others
                assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 4, 5, 5, 6, 7] or len(rows) == 8, name


def test_a_worker_keeps_the_tables_of_one_operator(spark, monkeypatch):
    # the tasks of both operators, run in this process as in a worker that is used again
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    task = lambda run: list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})])))
    encode = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    score = toxicity.score_documents(docs, toxicity.Model(np.zeros(toxicity.DIMS, np.float32), 0.0, 0.5))
    task(encode)
    assert pieces.codec_of.cache_info().currsize
    task(score)
    assert not pieces.codec_of.cache_info().currsize and toxicity._slots
    task(encode)
    assert not toxicity._slots
