"""Links between sets of tokens with a least Jaccard similarity, by signature trees.

Given are candidate edges between sets, such that two sets that may link are connected by them: a *family* is what
candidate edges connect. Within families links are exact.

Units. The sets of a family are dealt into units of about ``UNIT`` sets of similar size; a unit is worked
through in one task. Its sets are the leaves of a tree in order of their smallest tokens, so that alike sets are
neighbours. Each node of the tree holds the OR of its sets' token bitmaps, its range of sizes, and the most tokens that
share a bit with another one of their set (spare). Two sets of two nodes have at most as many tokens in common as
the bitmaps have bits in common, and the smaller of the two spares. Pairs of nodes are descended from the root down
and dropped when that, or the ranges of sizes, rule out a link, or when both lie in one component already. Pairs of
leaves that are left are compared token by token.

Rounds. Sizes are cut into bands twice, the second time shifted by half a band; a band is wider than twice what the
similarity allows, so two sets that may link share a band one of the times. Families of a single unit are
complete then. Larger ones are dealt by another draw the second time, which connects what is dense. What is still
in several components is completed in a third round: sets outside of a family's largest component are compared in
blocks with one another and with the rest of the family. So a dense family costs its size, and only sets without a link to the largest
component are compared with all others that their sizes allow. In families where hardly anything links those blocks grow
with the square of the family's size, and the trees are what keeps each of them cheap.

A unit is bounded in sets and in tokens. All rounds start from written tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import in_arrow, stored

#: Sets of a unit of the first two rounds, and of a block of the third; tokens of either.
UNIT, BLOCK, TOKENS = 128, 256, 1 << 20
#: Copies of a family's line in joins by family.
SPREAD = 16
#: Children of a node; bits of a bitmap for each token of the largest set.
FANOUT, BITS = 4, 16
#: Words of bitmaps that are compared together.
STEP = 1 << 21


def bitmaps(tokens: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """One row of ``width`` bits for each set, as 64-bit words."""
    n = len(starts) - 1
    out = np.empty((n, width // 64), np.uint64)
    step = max(1, (4 << 20) // width)
    for at in range(0, n, step):
        to = min(n, at + step)
        cells = np.zeros((to - at, width), bool)
        row = np.repeat(np.arange(to - at), np.diff(starts[at : to + 1]))
        cells[row, tokens[starts[at] : starts[to]] & np.uint64(width - 1)] = True
        out[at:to] = np.packbits(cells, axis=1, bitorder="little").view(np.uint64)
    return out


class Level:
    """Nodes of one level: bitmaps, least and greatest size, spare, and the component and the side if it is one."""

    def __init__(self, bits: np.ndarray, least: np.ndarray, most: np.ndarray, spare: np.ndarray, part: np.ndarray, side: np.ndarray):
        self.bits, self.least, self.most, self.spare, self.part, self.side = bits, least, most, spare, part, side

    def above(self) -> Level:
        at = np.arange(0, len(self.least), FANOUT)

        def single(values: np.ndarray) -> np.ndarray:
            low = np.minimum.reduceat(values, at)
            return np.where(low == np.maximum.reduceat(values, at), low, -1)

        return Level(
            np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.least, at), np.maximum.reduceat(self.most, at),
            np.maximum.reduceat(self.spare, at), single(self.part), single(self.side))

    def left(self, a: np.ndarray, b: np.ndarray, num: int, den: int, across: bool) -> np.ndarray:
        """Whether pairs of nodes may hold a link between two components."""
        go = (den * self.most[a] >= num * self.least[b]) & (den * self.most[b] >= num * self.least[a])
        go &= (self.part[a] != self.part[b]) | (self.part[a] < 0)
        if across:
            go &= (self.side[a] != self.side[b]) | (self.side[a] < 0)
        at = np.flatnonzero(go)
        step = max(1, STEP // self.bits.shape[1])
        for i in range(0, len(at), step):
            x, y = a[at[i : i + step]], b[at[i : i + step]]
            overlap = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(self.spare[x], self.spare[y])
            go[at[i : i + step]] = (num + den) * overlap >= num * (self.least[x] + self.least[y])
        return go


def unit_links(tokens: np.ndarray, starts: np.ndarray, part: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (places of two sets) that connect what links connect in a unit: no pair within a component
    (``part``), and where there are two sides only pairs across."""
    size = np.diff(starts)
    # leaves in order of the smallest tokens, which alike sets share
    second = tokens[np.minimum(starts[:-1] + 1, starts[1:] - 1)]
    order = np.lexsort((size, second, tokens[starts[:-1]], side))
    place = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
    tokens, size, part, side = tokens[place], size[order], part[order], side[order]
    starts = np.cumsum(np.append(0, size))
    part = np.unique(part, return_inverse=True)[1]

    sides = np.unique(side)
    bits = bitmaps(tokens, starts, max(64, 1 << math.ceil(math.log2(BITS * size.max()))))
    spare = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [Level(bits, size, size, spare, part, side)]
    while len(levels[-1].least) > FANOUT:
        levels.append(levels[-1].above())
    a, b = np.triu_indices(len(levels[-1].least))
    for level in reversed(levels):
        if level is not levels[-1]:
            child = np.arange(FANOUT)
            a, b = (x.ravel() for x in np.broadcast_arrays(a[:, None, None] * FANOUT + child[:, None], b[:, None, None] * FANOUT + child))
            there = (a <= b) & (b < len(level.least))
            a, b = a[there], b[there]
        go = level.left(a, b, num, den, len(sides) > 1)
        a, b = a[go], b[go]

    found, names, where = [], part.copy(), np.unique(tokens, return_inverse=True)[1]
    marks = np.zeros(where.max() + 1, bool)
    by_first = np.argsort(a, kind="stable")
    a, b = a[by_first], b[by_first]
    for at, to in zip(cuts := np.flatnonzero(np.diff(a, prepend=-1)), [*cuts[1:], len(a)]):
        one = a[at]
        others = b[at:to][names[b[at:to]] != names[one]]
        if not len(others):
            continue
        mine = where[starts[one] : starts[one + 1]]
        marks[mine] = True
        spans = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in others])
        common = np.add.reduceat(marks[where[spans]], np.cumsum(np.append(0, size[others][:-1])), dtype=np.int64)
        marks[mine] = False
        for other in others[(num + den) * common >= num * (size[one] + size[others])]:
            if names[other] != names[one]:
                found.append((int(order[one]), int(order[other])))
                names[names == names[other]] = names[one]
    return found


def links_of_units(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) of rows (unit, node, part, side, shingles). Units are dealt by range, which evens out what tasks get."""
    dealt = rows.select("unit", "node", "part", "side", "shingles").repartitionByRange("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            unit = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            start = 0
            for end in ends:
                if held and held[0].column(0)[0].as_py() != unit[start]:
                    yield from worked(held)
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        yield from worked(held)

    def worked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(len(b) for b in held) > 1:
            table = pa.Table.from_batches(held).combine_chunks()
            node, part, side = (table.column(i).to_numpy() for i in (1, 2, 3))
            shingles = table.column(4).combine_chunks()
            starts = np.append(0, np.cumsum(shingles.value_lengths().to_numpy().astype(np.int64)))
            links = unit_links(shingles.flatten().to_numpy().view(np.uint64), starts, part, side, *least)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return in_arrow(dealt, run, "a bigint, b bigint")


def spread(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Join of rows (of nodes) with one line for each family. One family may hold most rows, so they are
    spread over ``SPREAD`` copies of its line."""
    copies = lines.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    return rows.withColumn("copy", F.pmod(F.xxhash64("node", F.lit(0)), F.lit(SPREAD))).join(copies, [*keys, "copy"]).drop("copy")


def linked(edges: DataFrame, sets: DataFrame, least: tuple[int, int], name: str) -> DataFrame:
    """``node`` and ``root`` of the sets that link to another. ``edges`` (a, b) connect what may link; ``sets``
    (node, shingles: sorted hashes) has the sets of all nodes of edges, which are not empty."""
    num, den = least
    width = 2.2 * math.log(den / num)
    family = components(edges, f"{name}-families").withColumnRenamed("root", "family")
    sized = sets.select("node", F.size("shingles").cast("bigint").alias("size"))
    band = lambda shift: F.floor(F.log(F.col("size")) / width + shift)
    meta = stored(family.join(sized, "node").withColumns({"band_1": band(0.0), "band_2": band(0.5)}), f"{name}-members")

    def dealt(rows: DataFrame, keys: list[str], sets_each: int, seed: int) -> DataFrame:
        """Rows with ``salt``: as many of the same keys as keep a unit small."""
        parts = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / sets_each), F.ceil(F.sum("size") / TOKENS)).alias("parts"))
        return spread(rows, parts, keys).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")))

    first = dealt(meta, ["family", "band_1"], UNIT, 1).withColumn("unit", F.xxhash64("family", "band_1", "salt", F.lit(1))).drop("salt", "parts")
    # a second time only where the first left anything apart
    again = first.groupBy("family", "band_2").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low <> high").select("family", "band_2")
    second = dealt(spread(first.drop("unit"), again, ["family", "band_2"]), ["family", "band_2"], UNIT, 2).withColumn(
        "unit", F.xxhash64("family", "band_2", "salt", F.lit(2)))
    units = first.select("unit", "node").unionByName(second.select("unit", "node"))
    rows = units.join(sets, "node").withColumns({"part": F.col("node"), "side": F.lit(0)})
    links = stored(links_of_units(rows, least), f"{name}-links")
    roots = components(links, f"{name}-first")

    # families of several units that are still apart
    counts = [meta.groupBy("family", b).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")) for b in ("band_1", "band_2")]
    several = counts[0].drop("band_1").unionByName(counts[1].drop("band_2")).where((F.col("n") > UNIT) | (F.col("tokens") > TOKENS)).select("family").distinct()
    large = spread(meta, several, ["family"]).join(roots, "node", "left").select("family", "node", "size", F.col("band_1").alias("band"), F.coalesce("root", "node").alias("part"))
    large = stored(large, f"{name}-large")
    main = large.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.max(F.struct("n", "part")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("family", F.col("m.part").alias("main"))
    sided = spread(large, main, ["family"]).withColumn("side", F.when(F.col("part") == F.col("main"), 1).otherwise(0))
    blocks = stored(
        dealt(sided, ["family", "side", "band"], BLOCK, 3).withColumn("block", F.xxhash64("family", "side", "band", "salt")), f"{name}-blocks")
    if blocks.isEmpty():
        return roots
    listed = blocks.groupBy("block", "family", "side", "band").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    one, other = (listed.select(*[F.col(c).alias(f"{c}_{x}") if c != "family" else F.col(c) for c in listed.columns]) for x in ("x", "y"))
    # bands are a second condition of the join, so a family's blocks meet only blocks of like sizes
    near = one.withColumn("band", F.explode(F.array(F.col("band_x") - 1, F.col("band_x"), F.col("band_x") + 1))).join(
        other.withColumnRenamed("band_y", "band"), ["family", "band"])
    pairs = near.where(
        (F.col("side_x") == 0) & ((F.col("side_y") == 1) | (F.col("block_x") <= F.col("block_y")))
        & (den * F.col("most_x") >= num * F.col("least_y")) & (den * F.col("most_y") >= num * F.col("least_x")))
    pairs = stored(pairs.select("block_x", "block_y", F.xxhash64("block_x", "block_y").alias("unit")), f"{name}-pairs")
    ends = pairs.select("unit", F.col("block_x").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.where("block_x <> block_y").select("unit", F.col("block_y").alias("block"), F.lit(1).alias("side")))
    # two blocks are compared across only: within itself a block has a unit of its own
    third = ends.join(blocks.select("block", "node", "part"), "block").join(sets, "node")
    more = stored(links_of_units(third, least), f"{name}-more-links")
    return components(links.unionByName(more), f"{name}-last")
