"""Exact join of documents whose sets of word n-grams have a Jaccard similarity of 0.9 or more.

Candidates. Of two linked sets of sizes a and b at most (a + b) / 19 tokens are in one of them only. So the token
space is cut by a hash into more classes than that: some classes are then equal in both sets, and a key is a class with
the hash of what a set has in it. The number of classes depends on the size, so sizes are cut into *spaces* of a ratio of 1.5;
a set has the keys of its own space, and of the space below if it may link to a smaller set there. Classes hold six tokens
or more on average. An empty class would be a key that strangers share, so there are a few classes more than needed: as
long as no more are empty than that, an equal class that isn't empty is left. A set with more empty classes gets the keys of
another hash besides; so does any set that could have met it in empty classes alone. No link is ever lost.

Links. Documents that share a key are connected (to the key's smallest set) into families, and the signature trees of
``sigtree`` find the links in each family exactly.

Equal sets are one set whatever their number of documents, so copies cost nothing after the first step.

Defined results: fewer words than an n-gram make one token; a text that is null or has no words has the empty set, which
links with nothing, not even another empty one. Rows with equal ids are kept, each with its own set; null ids are
kept and don't count for ``component_id``. An empty table gives an empty result."""

from __future__ import annotations

import functools
import math
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.golay import SEED
from tidemark.llm.shared import stored
from tidemark.llm.shingling import joined, marked_rows

WIDTH = 3
#: Least Jaccard similarity of a link, as a fraction.
LEAST = (9, 10)
GROWTH, HASHES = 1.5, 4

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES + 3, np.uint64) << np.uint64(1) | np.uint64(1)


@functools.cache
def space(number: int, least: tuple[int, int]) -> tuple[int, int, int]:
    """Least size, number of classes, and how many of them may be empty, of a space of sizes."""
    num, den = least
    start = lambda i: max(1, math.ceil((den / (den - num) - 1) * GROWTH**i))  # noqa: E731  smaller sets link to equal ones only
    low, top = start(number), start(number + 1) - 1
    needed = (top + top * den // num) * (den - num) // (den + num) + 1
    spare = math.ceil(2 + 2 * needed * math.exp(-low / needed))
    return low, needed + spare, spare


def mixed(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * factor
    return values ^ (values >> np.uint64(29))


def class_keys(tokens: np.ndarray, number: int, least: tuple[int, int]) -> list[np.ndarray]:
    """The keys of a set in one space."""
    _, classes, spare = space(number, least)
    found = []
    for level in range(HASHES):
        of = (mixed(tokens, _DRAWN[level]) >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sums, there = np.add.reduceat(mixed(tokens[order], _DRAWN[HASHES]), first), of[first]
        if level == HASHES - 1:  # the last hash takes empty classes as they are
            whole = np.zeros(classes, np.uint64)
            whole[there.astype(np.int64)] = sums
            sums, there = whole, np.arange(classes, dtype=np.uint64)
        tag = np.uint64((number * HASHES + level) << 32)
        found.append(mixed(sums * _DRAWN[HASHES + 1] + mixed(there + tag, _DRAWN[HASHES + 2]), _DRAWN[HASHES]))
        if classes - len(first) <= spare:
            break
    return found


def candidate_keys(tokens: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """All keys of a set: sets with the similarity share one."""
    number = 0
    while space(number + 1, least)[0] <= len(tokens):
        number += 1
    if len(tokens) < space(number, least)[0]:
        return np.zeros(0, np.uint64)
    found = class_keys(tokens, number, least)
    if number and len(tokens) * least[0] <= (space(number, least)[0] - 1) * least[1]:
        found += class_keys(tokens, number - 1, least)
    return np.concatenate(found)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """``id_col``, ``n_shingles`` (the set's size) and ``component_id`` (the smallest id reachable by links) per row."""
    if GROWTH * least[0] < least[1]:
        raise ValueError("a similarity of 2/3 or more is needed: sets of spaces that are not neighbours never meet")
    marked = stored(marked_rows(docs, id_col, text_col, width, lambda tokens: candidate_keys(tokens, least)), "jaccard-rows")
    found = joined(docs, marked, id_col, text_col, width, least, "jaccard")
    own = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), own.alias("component_id"))
