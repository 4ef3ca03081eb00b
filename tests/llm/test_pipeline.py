"""Every stage against a plain version on its own input."""

import corpus_pipeline as pipeline
from tests.llm.test_relational import plain_contamination
from tests.llm.test_similar import plain_components, plain_shingles
from tidemark.llm import bands
from tidemark.llm.shared import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    steps = []
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        steps.append({r.doc_id: r for r in docs.collect()})
        if stage is not pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    good, single, clean, masked, coded = steps

    def verdict(t):
        (row,) = bands.measured([t])
        of = dict(zip(bands.NAMES, row))
        low, high = bands.band(of["n_bytes"])
        return of["n_words"] >= 10 and 100 * of["n_repeat_words"] <= 20 * of["n_words"] and low <= of["ratio"] <= high and of["n_low_chunks"] + of["n_high_chunks"] <= 0.25 * of["n_chunks"]

    assert set(good) == {i for i, r in given.items() if verdict(r.text)}
    ids = sorted(good)
    groups = plain_components([plain_shingles(good[i].text) for i in ids])
    assert set(single) == {ids[g] for g in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, r in single.items() if not plain_contamination(r.text, items)[1]}
    assert set(masked) == set(clean) == set(coded)
    for i, r in masked.items():
        assert r.n_chars == len(r.text) and ("[SECRET]" in r.text) == (r.text != clean[i].text)


def test_repeated_and_odd_rows(spark):
    text = "A text of more than ten words that nobody else wrote, with a few rare terms like quixotry and zephyr."
    rows = [(1, text, "x"), (1, text, "y"), (2, text, "z"), (None, None, "n"), (None, text + " And more words to make it another text than before, quite so.", "m"), (3, "", "e")]
    docs = spark.createDataFrame([(i, t, "en", s, None, 1) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, `__row x` int")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "test-odd")
    assert [r.doc_id for r in docs.collect()].count(1) == 1
    assert all(r.text for r in docs.collect())


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-empty")
    assert docs.count() == 0
