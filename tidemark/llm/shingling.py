"""Texts as sets of shingles: hashes, candidate keys, families, and the join that ends in ``sigtree``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.golay import SEED, WORD, blocks, shingle_hashes
from tidemark.llm.shared import by_size, in_arrow, stored
from tidemark.llm.sigtree import linked


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Different shingles of a UTF-8 text as sorted hashes; fewer words than a shingle make one."""
    found, held = [], []
    for block in blocks((text or b"").lower()):
        held += WORD.findall(block)
        if len(held) >= width:
            found.append(np.unique(shingle_hashes(held, width)))
            held = held[len(held) - width + 1 :]
    if found:
        return np.unique(np.concatenate(found))
    return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)] if held else [], np.uint64)


def signed(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))


def marked_rows(docs: DataFrame, id_col: str, text_col: str, width: int, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``id``, ``hash`` (of the text), ``node`` (the set's hash), ``size`` and ``keys`` of every row;
    sets that may link share one of the keys that ``keys_of`` gives for a set."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 2, 4 << 20):
                sets = [shingles(t.as_py(), width) for t in part.column(2)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(map(len, sets), pa.int64()), signed([keys_of(s) for s in sets])],
                    ["id", "hash", "node", "size", "keys"])

    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, node bigint, size bigint, keys array<bigint>")


def family_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes (node, keys) that share a key: each to the key's smallest."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("key", "b")
    return keyed.join(shared, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` of the rows (id, hash) wanted, read again."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    want = wanted.select(F.col("id").alias("wid"), F.col("hash").alias("whash")).distinct()
    there = rows.join(want, F.col("id").eqNullSafe(F.col("wid")) & (F.col("hash") == F.col("whash")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0, 4 << 20):
                sets = [shingles(t.as_py(), width) for t in part.column(0)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), signed(sets)], ["node", "shingles"])

    # the same row may be there more than once
    return in_arrow(there, run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def joined(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, width: int, least: tuple[int, int], name: str,
           edges_of: Callable[[DataFrame], DataFrame] = family_edges) -> DataFrame:
    """``id``, ``node``, ``size`` and ``component_id`` of all marked rows; the empty set is a node like any other.
    ``edges_of`` makes candidate edges (a, b) of the nodes (node, keys)."""
    nodes = stored(
        marked.groupBy("node").agg(F.min(F.struct("id", "hash", "size", "keys")).alias("n"), F.min("id").alias("least")).select("node", "n.id", "n.hash", "least", "n.keys"), f"{name}-nodes")
    edges = stored(edges_of(nodes), f"{name}-edges")
    members = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(sets_of(docs, id_col, text_col, width, nodes.join(members, "node")), f"{name}-sets")
    roots = linked(edges, sets, least, name)
    placed = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = stored(placed.join(smallest, "root").select("node", "component_id"), f"{name}-ends")
    # a set of very many texts is one row on the right; its rows on the left are split by AQE
    return marked.select("id", "node", "size").join(ends, "node")
