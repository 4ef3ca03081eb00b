"""Near-duplicates by Jaccard similarity against all pairs."""

import random

import numpy as np

import corpus_pipeline as pipeline
from tidemark.llm import golay, similar

FOLDER = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = golay.WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            common = len(a & sets[k])
            if 5 * common >= 4 * (len(a) + len(sets[k]) - common):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def variants(pick, words, number, changes):
    out = []
    for _ in range(number):
        copy = list(words)
        for at in pick.sample(range(len(copy)), changes):
            copy[at] = f"other{pick.random()}"
        out.append(" ".join(copy))
    return out


def test_stage_finds_all_similar_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    root = plain_components([plain_shingles(r.text) for r in rows])
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, FOLDER).select("doc_id").collect()}
    assert kept == {rows[i].doc_id for i in root}


def test_groups_strays_and_odd_rows(docs):
    """Dense groups, two groups that only a few pairs join, strays that share most of their words."""
    pick = random.Random(11)
    base = [f"w{pick.randint(0, 10_000)}" for _ in range(300)]
    texts = variants(pick, base, 60, 3) + variants(pick, base, 20, 8) + variants(pick, base, 40, 15) + [" ".join(base)] * 30
    texts += [None, "", " \n", "four words are few", "Four words are few", "four words are many"]
    pick.shuffle(texts)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs(*enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components([plain_shingles(t) for t in texts])
    assert similar.near_duplicates(docs()).count() == 0


def test_keys_meet_at_the_least_similarity():
    """Sets of exactly 0.8: at most one in a thousand pairs without a common key."""
    pick = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        drawn = pick.integers(0, 1 << 63, 250, np.uint64)
        missed += not np.intersect1d(similar.band_keys(drawn[:225]), similar.band_keys(drawn[25:])).size
    assert missed <= 3


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(str(i % 700) for i in range(3000)).encode()
    whole = similar.shingles(text)
    monkeypatch.setattr(golay, "BLOCK", 100)
    assert similar.shingles(text).tolist() == whole.tolist()
