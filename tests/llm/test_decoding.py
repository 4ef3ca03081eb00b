"""The pipeline decodes what it encodes."""

import hashlib

import corpus_pipeline as pipeline


def test_the_last_stage_decodes_what_it_encodes(spark):
    texts = ["plain words", "naïve café — 中文 🙂", "", "x" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.decoded_sha256 for r in pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
