"""Batches that the pipeline's stages hand to Python."""

import corpus_pipeline as pipeline


def test_stages_keep_batches_small(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    before = spark.conf.get(pipeline.BATCH_KEY)
    try:
        for given, used in (("10000", "1000"), ("0", "1000"), ("70", "70")):
            spark.conf.set(pipeline.BATCH_KEY, given)
            pipeline.quality_rules(spark, docs, "")
            assert spark.conf.get(pipeline.BATCH_KEY) == used
    finally:
        spark.conf.set(pipeline.BATCH_KEY, before)
