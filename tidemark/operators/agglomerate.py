"""Exact hierarchical clustering (Ward) of very many points, by reciprocal nearest neighbours.

Ward's distance of two groups of n and m points is nm / (n + m) times the squared distance of their means, which is
what the rule of Lance and Williams gives for it. It is reducible: two groups that are nearest to each other stay so until
they merge, whatever merges elsewhere. So all such pairs may merge in any order, in any place, and the
hierarchy is that of merging the closest pair of all again and again.

Passes. Equal points are one point with a weight. A pass cuts space into boxes of about ``CELL`` groups (by medians of
a sample, which decides about speed only), and each box is one task. Inside, pairs that are nearest to
each other merge round by round, as long as that is certain: a group's distance to anything outside is
at least that to the nearest point of another box with that box's least weight, and a pair merges only below that
bound. Boxes are cut elsewhere in each pass, so what was at an edge comes to lie inside. A pass leaves a small part of
the groups; ``AT_ONCE`` or fewer are finished in one task, whose memory is in proportion to their number.

The cut. The k - 1 highest merges are the ones to leave out. Passes take merges below a height ``limit`` only, first a
small part of the points' squared deviations, and the last step knows all merges above. If fewer than k - 1 are above, the
passes are repeated with the height of the (k - 1)th, which settles it.

The driver sees counts, the sample, and the boxes. Each pass starts from a written table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Groups of a box, groups that are finished in one task, most boxes, and sampled groups for each box.
CELL, AT_ONCE, BOXES, DRAWN = 1500, 4000, 1 << 16, 16
#: Height up to which passes merge at first, as a part of all squared deviations.
FIRST_LIMIT = 1 / 2000


def tools() -> SimpleNamespace:
    """The steps of one task. They refer to nothing but numpy and pandas and are made here, so they
    reach workers by value, which need not have this package."""

    def nearest(x: np.ndarray, w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest other group of some groups (the first one on a tie) and its distance."""
        found, distance = np.empty(len(rows), np.int64), np.empty(len(rows))
        step = max(1, (1 << 21) // len(x))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            d = (x[some, 0, None] - x[:, 0]) ** 2
            for i in range(1, x.shape[1]):
                d += (x[some, i, None] - x[:, i]) ** 2
            d *= w[some, None] * w / (w[some, None] + w)
            d[np.arange(len(some)), some] = np.inf
            found[at : at + step] = d.argmin(axis=1)
            distance[at : at + step] = d.min(axis=1)
        return found, distance

    def merged(x: np.ndarray, w: np.ndarray, outside, limit: float):
        """Merges pairs that are nearest to each other, below ``limit`` and below what ``outside`` gives for both.
        Returns each given group's place among those left, their means and weights, and all heights."""
        x, w, label, heights = x.copy(), w.copy(), np.arange(len(x)), [np.empty(0)]
        bound, fresh = outside(x, w), False
        rows, found, distance = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        while len(x) > 1:
            found[rows], distance[rows] = nearest(x, w, rows)
            sure, i = distance < np.minimum(bound, limit), np.arange(len(x))
            first = np.flatnonzero((found[found] == i) & (i < found) & sure & sure[found])
            if not len(first):
                if fresh or not sure.any():
                    break
                # equal distances to an old and a new group: look at all again
                rows, fresh = np.arange(len(x)), True
                continue
            fresh, second = len(rows) == len(x) and fresh, found[first]
            heights.append(distance[first])
            total = w[first] + w[second]
            x[first] = (x[first] * w[first, None] + x[second] * w[second, None]) / total[:, None]
            w[first] = total
            bound[first] = outside(x[first], total)
            stale, kept = np.zeros(len(x), bool), np.ones(len(x), bool)
            stale[first] = stale[second] = True
            stale |= stale[found]
            kept[second] = False
            place = np.cumsum(kept) - 1
            place[second] = place[first]
            label, found = place[label], place[found][kept]
            x, w, bound, distance = x[kept], w[kept], bound[kept], distance[kept]
            rows = np.flatnonzero(stale[kept])
        return label, x, w, np.concatenate(heights)

    def nothing_outside(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.full(len(x), np.inf)

    def cut(x: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Labels of at most ``k`` groups, in order of their means, and the height of the (k - 1)th highest merge."""
        height = np.inf
        if len(x) > k > 1:
            height = float(np.sort(merged(x, w, nothing_outside, np.inf)[3])[1 - k])
        label, x, w, _ = merged(x, w, nothing_outside, height) if len(x) > k else (np.arange(len(x)), x, w, None)
        while len(x) > k:  # merges of equal height
            found, distance = nearest(x, w, np.arange(len(x)))
            a = int(distance.argmin())
            b = int(found[a])
            x[a] = (x[a] * w[a] + x[b] * w[b]) / (w[a] + w[b])
            w[a] += w[b]
            place = np.arange(len(x)) - (np.arange(len(x)) > b)
            place[b] = a - (a > b)
            label, x, w = place[label], np.delete(x, b, axis=0), np.delete(w, b)
        order = np.lexsort(x.T[::-1])
        return np.argsort(order)[label], height

    def beyond(low: np.ndarray, high: np.ndarray, least: np.ndarray):
        """Least distance to any group of some boxes, given by their edges and least weights."""

        def outside(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            bound = np.full(len(x), np.inf)
            step = max(1, (1 << 21) // max(1, len(x)))
            for at in range(0, len(low), step):
                gap = np.zeros((len(x), len(low[at : at + step])))
                for i in range(x.shape[1]):
                    gap += np.maximum(np.maximum(low[at : at + step, i] - x[:, i, None], x[:, i, None] - high[at : at + step, i]), 0) ** 2
                m = least[at : at + step]
                bound = np.minimum(bound, (gap * (w[:, None] * m / (w[:, None] + m))).min(axis=1))
            return bound * (1 - 1e-9)

        return outside

    def box_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
        """Boxes of points: nodes are (variable, value, below, from there on), a leaf has variable -1 and its number."""
        at = np.zeros(len(x), np.int64)
        variable, value, below, above = (np.array(v) for v in zip(*nodes))
        while (variable[at] >= 0).any():
            inner = np.flatnonzero(variable[at] >= 0)
            node = at[inner]
            at[inner] = np.where(x[inner, variable[node]] < value[node], below[node], above[node])
        return below[at]

    return SimpleNamespace(nearest=nearest, merged=merged, cut=cut, beyond=beyond, box_of=box_of)


def boxes(x: np.ndarray, number: int, turn: int) -> list[tuple[int, float, int, int]]:
    """Cuts of space into about ``number`` boxes of like many of the given points; elsewhere in each turn."""
    nodes: list[tuple[int, float, int, int]] = []
    part = (0.5, 0.37, 0.63)[turn % 3]

    def grow(rows: np.ndarray, number: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, at, at))
        if number > 1 and len(rows) > 1:
            for i in np.argsort(-np.ptp(x[rows], axis=0), kind="stable"):
                values = x[rows, i]
                few = min(number - 1, max(1, round(number * part)))
                value = np.quantile(values, few / number, method="higher")
                if value > values.min():
                    side = values < value
                    nodes[at] = (int(i), float(value), grow(rows[side], few), grow(rows[~side], number - few))
                    break
        return at

    grow(np.arange(len(x)), number)
    return nodes


def _merged_pass(groups: DataFrame, names: list[str], number: int, turn: int, limit: float) -> DataFrame:
    """One pass over groups (id, means, w): ``id``, ``root`` (the id that stands for what it has merged into) and the means and weight of that."""
    kit = tools()
    drawn = groups.orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(max(10_000, DRAWN * number)).select(*names).toPandas().to_numpy(float)
    nodes = boxes(drawn, number, turn)

    @F.pandas_udf("bigint")
    def box(*values: pd.Series) -> pd.Series:
        return pd.Series(kit.box_of(np.stack([v.to_numpy(float) for v in values], axis=1), nodes))

    placed = written(groups.withColumn("box", box(*names)))
    edges = placed.groupBy("box").agg(
        *[F.min(c).alias(f"low_{c}") for c in names], *[F.max(c).alias(f"high_{c}") for c in names], F.min("w").alias("least")).toPandas()
    low, high = (edges[[f"{side}_{c}" for c in names]].to_numpy(float) for side in ("low", "high"))
    least, known = edges["least"].to_numpy(float), edges["box"].to_numpy()

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names)
        others = known != key[0]
        label, x, w, _ = kit.merged(rows[names].to_numpy(float), rows["w"].to_numpy(float), kit.beyond(low[others], high[others], least[others]), limit)
        ids = rows["id"].to_numpy()
        first = np.full(len(x), -1)
        first[label[::-1]] = ids[::-1]
        out = pd.DataFrame(x[label], columns=names)
        return out.assign(id=ids, root=first[label], w=w[label])[["id", "root", *names, "w"]]

    schema = "id BIGINT, root BIGINT, " + ", ".join(f"{c} DOUBLE" for c in names) + ", w DOUBLE"
    return written(placed.groupBy("box").applyInPandas(work, schema))


def ward_labels(points: DataFrame, k: int, at_once: int = AT_ONCE, cell: int = CELL, first_limit: float = FIRST_LIMIT) -> DataFrame:
    """``label`` (from 0, in order of the groups' means) of all different rows of a table of doubles without gaps."""
    kit, columns = tools(), points.columns
    names = [f"x{i}" for i in range(len(columns))]
    counted = points.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("w"))
    start = written(counted.withColumn("id", F.monotonically_increasing_id()))
    # a sum over numbers that don't share a large mean is exact enough for a limit that is only a guess
    facts = start.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.var_pop(c).alias(c) for c in names]).first()
    limit = first_limit * sum(facts[c] or 0.0 for c in names) * (facts["w"] or 0.0)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["id", *names, "w"]), *batches]).sort_values(names)
        if len(rows):
            label, height = kit.cut(rows[names].to_numpy(float), rows["w"].to_numpy(float), k)
            yield pd.DataFrame({"id": rows["id"].astype("int64"), "label": label, "height": height})

    while True:
        groups, number, maps, turn, size = start, facts["n"], [], 0, cell
        while number > at_once and size <= 64 * cell:
            done = _merged_pass(groups, names, min(BOXES, math.ceil(number / size)), turn, limit)
            maps.append(done.select("id", "root"))
            groups = done.where("id = root").select("id", *names, "w")
            before, number, turn = number, groups.count(), turn + 1
            size *= 2 if number > 0.7 * before else 1
        last = written(groups.select("id", *names, "w").repartition(1).mapInPandas(finish, "id BIGINT, label INT, height DOUBLE"))
        height = (last.agg(F.min("height").alias("h")).first()["h"] if maps else None) or math.inf
        if not maps or height >= limit:
            break
        limit = height
    ends = last.select("id", "label")
    for done in reversed(maps):
        ends = done.join(ends.withColumnRenamed("id", "root"), "root").select("id", "label")
    return start.join(ends, "id").select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "label")
