"""The fingerprints by which the pipeline's near-duplicate stage finds candidates."""

import numpy as np

from tidemark.llm import golay, similar


def test_fingerprint_of_a_set():
    text = " ".join(f"w{i}" for i in range(40000)).encode()
    assert golay.set_fingerprint(similar.shingles(text)) == golay.fingerprint(text, 5)
    assert golay.set_fingerprint(similar.shingles(b"two words")) == golay.fingerprint(b"two words", 5)
    assert similar.marks(similar.shingles(b" ")).size == 0
    assert similar.marks(similar.shingles(text)).size == 1 + similar.BANDS


def test_candidates_meet_by_fingerprint_alone(spark):
    """Equal fingerprints, links of three bits and chains of them; no edge at four bits. Keys differ in all rows."""
    base = 0x0123456789ABCDEF
    prints = [base, base, base ^ 0b111, base ^ 0b111 ^ (0b111 << 40), ~base, ~base ^ 0b1111]
    rows = [(i, np.array([p & (1 << 64) - 1], np.uint64).view(np.int64).tolist() + [1000 * i + k for k in range(similar.BANDS)]) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame([*rows, (9, [])], "node bigint, keys array<bigint>")
    edges = similar.candidate_edges(nodes).collect()
    assert sorted((r.a, r.b) for r in edges) == [(1, 0), (2, 0), (3, 0)]
