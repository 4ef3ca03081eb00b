"""Connected components of an edge list, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def _downward(one: str, other: str) -> tuple[Column, Column]:
    return F.greatest(one, other).alias("a"), F.least(one, other).alias("b")


def flattened(forest: DataFrame, name: str) -> DataFrame:
    """``node`` and the ``root`` of its tree, from ``node`` and the node above it (``root``, a root has itself).
    Each turn halves the depth and is a written table; the driver sees one count a turn."""
    turn = 0
    while True:
        turn += 1
        ahead = forest.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stored(forest.join(ahead, "root").select("node", F.col("next").alias("root"), F.col("root").alias("old")), f"{name}-{turn}")
        changed = after.where("root <> old").limit(1).count()
        forest = after.select("node", "root")
        if not changed:
            return forest


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all nodes of edges (a, b).

    In a round every node hangs itself below its smallest neighbour if that is smaller, and each tree that
    this makes becomes one node, its root. Only edges between different trees are left for the next round,
    each once, so an edge is joined in few rounds however many there are: in a dense group nearly all lie
    within a tree after the first. Rounds end when no edge is left; their number grows with the logarithm
    of the nodes for all but contrived graphs. Each step is a written table, so a lost executor costs one step at most."""
    left = stored(edges.select(*_downward("a", "b")).distinct(), f"{name}-edges")
    roots, turn = None, 0
    while True:
        turn += 1
        ends = left.select(F.col("a").alias("node"), "b").unionByName(left.select(F.col("b").alias("node"), "b"))
        forest = stored(ends.groupBy("node").agg(F.min("b").alias("root")), f"{name}-{turn}-hung")
        trees = flattened(forest, f"{name}-{turn}-trees")
        if roots is None:
            roots = trees
        else:
            above = trees.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-{turn}")
        of = [trees.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")) for end in ("a", "b")]
        apart = left.where("a <> b").join(of[0], "a").join(of[1], "b").where("root_a <> root_b")
        left = stored(apart.select(*_downward("root_a", "root_b")).distinct(), f"{name}-{turn}-edges")
        if left.isEmpty():
            return roots
