"""Near-duplicate texts by the Jaccard similarity of their shingles.

Shingles are runs of five lower-cased words, as a set. Texts link when their sets' Jaccard similarity
is 0.8 or more; a component is what links connect.

Candidates. Every set has a SimHash fingerprint, and ``golay`` finds the fingerprints that differ in three bits or
less by their Golay-code keys; sets whose fingerprints such links connect are candidates. That does not reach all
the way down: at a similarity of 0.8 about ten of 64 bits differ. For the rest there are keys of min-hashes, ``ROWS`` to
a key and ``BANDS`` keys to a set: a pair of similarity s shares a key with probability
1 - (1 - s^ROWS)^BANDS, 0.99997 at 0.8.

Links. Candidates are connected into families, through the smallest set of a key or of a component of fingerprints; no
pairs are made of those that share one. ``sigtree`` then finds all links in each family exactly, with every pair whose similarity the
signature trees leave open worked out from the whole sets. Equal sets are one node whatever their number of texts.

Defined results: a null or empty text, or one of white space, has the empty set, and such texts link; fewer words
than a shingle make one shingle. Rows with equal ids are kept; null ids are kept. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay, shingling
from tidemark.llm.golay import SEED
from tidemark.llm.shared import stored

WIDTH = 5
#: Least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
ROWS, BANDS = 4, 20

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64)
_FLIP, _FACTOR = _DRAWN[0], _DRAWN[1] << np.uint64(1) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    return shingling.shingles(text, WIDTH)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; the empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048, None] ^ _FLIP) * _FACTOR).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def marks(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles, and its keys behind it; nothing for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.concatenate([np.array([golay.set_fingerprint(hashes)], np.uint64), band_keys(hashes)])


def fingerprint_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes (node, fp) whose fingerprints are equal or connected by links of three
    bits: each to the smallest node of its component."""
    linked = stored(golay.roots(nodes.select("fp").distinct()), "similar-fingerprints")
    placed = nodes.join(linked, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    shared = placed.groupBy("root").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("root", "b")
    return placed.join(shared, "root").where("node <> b").select(F.col("node").alias("a"), "b")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Edges by fingerprints and by min-hash keys, of nodes whose ``keys`` are their :func:`marks`."""
    marked = nodes.where(F.size("keys") > 0)
    by_print = fingerprint_edges(marked.select("node", F.get("keys", F.lit(0)).alias("fp")))
    by_key = shingling.family_edges(marked.select("node", F.slice("keys", 2, BANDS).alias("keys")))
    return by_print.unionByName(by_key).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id`` (the smallest id reachable over links) per row."""
    marked = stored(shingling.marked_rows(docs, id_col, text_col, WIDTH, marks), "similar-rows")
    found = shingling.joined(docs, marked, id_col, text_col, WIDTH, LEAST, "similar", candidate_edges)
    return found.select(F.col("id").alias(id_col), "component_id")
