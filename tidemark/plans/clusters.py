"""Clustering of sessions: k-means with restarts, and hierarchical (Ward)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.agglomerate import AT_ONCE, boxes, tools, ward_labels
from tidemark.session import written

RESTARTS = 30
MAX_PASSES = 300
TOLERANCE = 1e-4
#: Boxes that rows are dealt into for k-means, and rows sampled for each of them.
BOXES, DRAWN = 2048, 8
#: Rows that one task of a pass is given at least.
ROWS_EACH = 50_000


def feature_matrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The chosen variables as doubles; rows with a gap are left out."""
    return df.select(*[F.col(v).cast("double").alias(v) for v in variables]).na.drop("any")


def _starts(features: DataFrame, runs: int, k: int, seed: int) -> np.ndarray | None:
    """``runs`` x ``k`` starting points: for every run the ``k`` distinct points with the
    smallest seeded hash of (point, run). Every task keeps the ``k`` best of each run, so
    runs x k lines leave it; no draw, and the same points however the rows are spread. With
    fewer than ``k`` distinct points there are as many centers; without rows there are none."""
    columns, width = features.columns, len(features.columns)

    # refers to nothing but numpy and pandas, so that workers need not have this package
    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [pd.DataFrame(columns=["h", *columns]) for _ in range(runs)]
        for batch in batches:
            points = batch.drop_duplicates()
            base = pd.util.hash_pandas_object(points + 0.0, index=False).to_numpy()
            for run in range(runs):
                h = (base ^ np.uint64((seed * 1_000_003 + run) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
                h = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(1)
                few = np.argpartition(h, k - 1)[:k] if len(h) > k else np.arange(len(h))
                more = points.iloc[few].assign(h=h[few].astype(np.int64))[["h", *columns]]
                best[run] = more if best[run].empty else pd.concat([best[run], more]).drop_duplicates().nsmallest(k, "h")
        for run, rows in enumerate(best):
            if not rows.empty:
                yield rows.assign(run=run)[["run", "h", *columns]]

    schema = "run INT, h BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    drawn = features.mapInPandas(smallest, schema).distinct()
    first = Window.partitionBy("run").orderBy("h", *columns)
    chosen = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    points = chosen.toPandas().sort_values(["run", "h", *columns])
    if points.empty:
        return None
    return points[columns].to_numpy(dtype=float).reshape(runs, -1, width)


def _decided(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For runs x boxes the one center that is nearer than all others everywhere in the box, or -1.

    Another center can be the nearer one somewhere in a box only if it is at the corner that lies
    furthest in its direction; a tie there counts as undecided."""
    runs, k, _ = centers.shape
    middle = (low + high) / 2
    nearest = ((centers[:, None] - middle[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    own = np.take_along_axis(centers, nearest[:, :, None], axis=1)
    sure = np.ones(nearest.shape, bool)
    for j in range(k):
        other = centers[:, None, j]
        corner = np.where(other > own, high, low)
        ahead = ((other - corner) ** 2).sum(axis=2) > ((own - corner) ** 2).sum(axis=2)
        sure &= ahead | (nearest == j)
    return np.where(sure, nearest, -1)


class _Boxes:
    """Different points with their number of rows, dealt into boxes of space, and of each box its rows, their sums,
    squared deviations and edges. The boxes come from a bounded sample and decide only about speed."""

    def __init__(self, points: DataFrame, columns: list[str], seed: int):
        kit, self.columns = tools(), columns
        names = [f"x{i}" for i in range(len(columns))]
        drawn = points.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(BOXES * DRAWN).select(*columns).toPandas().to_numpy(float)
        nodes = boxes(drawn, min(BOXES, max(1, len(drawn) // DRAWN)), 0)

        @F.pandas_udf("int")
        def box(*values: pd.Series) -> pd.Series:
            return pd.Series(kit.box_of(np.stack([v.to_numpy(float) for v in values], axis=1), nodes), dtype="int32")

        # in order of boxes, so that a scan for some boxes can leave out row groups
        self.rows = written(points.toDF(*names, "w").withColumn("box", box(*names)).repartitionByRange("box").sortWithinPartitions("box"))
        middle = drawn.mean(axis=0)
        facts = self.rows.groupBy("box").agg(
            F.sum("w").alias("n"), *[F.sum(F.col(c) * F.col("w")).alias(f"s{c}") for c in names],
            *[F.sum((F.col(c) - float(m)) * (F.col(c) - float(m)) * F.col("w")).alias(f"v{c}") for c, m in zip(names, middle)],
            *[f(c).alias(f"{name}{c}") for name, f in (("l", F.min), ("h", F.max)) for c in names]).toPandas().sort_values("box")
        part = lambda name: facts[[f"{name}{c}" for c in names]].to_numpy(float)
        self.box, self.n, self.sums, self.low, self.high = facts["box"].to_numpy(), facts["n"].to_numpy(float), part("s"), part("l"), part("h")
        self.apart = (part("v") - self.n[:, None] * (self.sums / self.n[:, None] - middle) ** 2).sum(axis=1).clip(0)

    def spread(self) -> float:
        """Mean variance of the variables."""
        whole = self.n.sum()
        mean = self.sums.sum(axis=0) / whole
        inside = self.apart.sum() + (((self.sums / self.n[:, None] - mean) ** 2).sum(axis=1) * self.n).sum()
        return float(inside / whole / len(self.columns))

    def reduced(self, centers: np.ndarray) -> tuple[np.ndarray, int]:
        """One pass for all runs: rows, sums and cost of each run and center, and how often a row was compared.

        Boxes that lie on one center's side of every border give what they have in common; only rows of the others are
        looked at, and only for the runs that need them. Every task reduces its rows to at most runs x k lines."""
        runs, k, width = centers.shape
        owner = _decided(self.low, self.high, centers)
        totals = np.zeros((runs, k, width + 2))
        mean = self.sums / self.n[:, None]
        for run in range(runs):
            known = owner[run] >= 0
            to = owner[run][known]
            cost = self.apart[known] + ((mean[known] - centers[run][to]) ** 2).sum(axis=1) * self.n[known]
            for i, values in enumerate((self.n[known], *self.sums[known].T, cost)):
                totals[run, :, i] = np.bincount(to, weights=values, minlength=k)
        open_boxes = (owner < 0).any(axis=0)
        if not open_boxes.any():
            return totals, 0
        place = np.full(self.box.max() + 1, 0)
        place[self.box] = np.arange(len(self.box))
        open_for = owner < 0

        # refers to nothing but numpy and pandas, so that workers need not have this package
        def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros((runs, k, width + 2))
            for batch in batches:
                x, w, at = batch.iloc[:, :width].to_numpy(dtype=float), batch["w"].to_numpy(float), place[batch["box"].to_numpy()]
                for run in range(runs):
                    seen = open_for[run][at]
                    some, weight = x[seen], w[seen]
                    distance = sum((some[:, i, None] - centers[run][:, i]) ** 2 for i in range(width))
                    nearest = distance.argmin(axis=1)
                    for i, values in enumerate((1.0, *some.T, distance.min(axis=1))):
                        found[run, :, i] += np.bincount(nearest, weights=values * weight, minlength=k)
            slots = np.arange(runs * k)
            frame = pd.DataFrame(found.reshape(runs * k, width + 2), columns=[f"t{i}" for i in range(width + 2)])
            yield frame.assign(run=slots // k, cluster=slots % k)[["run", "cluster", *frame.columns]]

        columns = [f"t{i}" for i in range(width + 2)]
        schema = "run INT, cluster INT, " + ", ".join(f"{c} DOUBLE" for c in columns)
        few = self.rows.where(f"box in ({', '.join(map(str, self.box[open_boxes]))})")  # one expression, not a call for each number
        few = few.coalesce(int(self.n[open_boxes].sum() // ROWS_EACH) + 1)
        looked = few.mapInPandas(reduce_rows, schema).groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        totals[looked["run"], looked["cluster"]] += looked[columns].to_numpy()
        return totals, int((open_for * self.n).sum())


def kmeans_centers(
    features: DataFrame, k: int, restarts: int = RESTARTS, seed: int = 7, max_passes: int = MAX_PASSES, report: list[tuple[int, int]] | None = None
) -> tuple[np.ndarray, float]:
    """Centers and cost of the best of ``restarts`` runs from random rows. There are fewer
    than ``k`` centers only if there are fewer distinct points, and none without rows.

    All runs that have not converged advance in the same pass over the data. Rows lie in boxes, and a pass looks only at those
    of boxes that a border between centers goes through (see ``_Boxes``); ``report`` is given, for every pass, how
    many comparisons of a row with a run's centers there would be and how many there were."""
    columns = features.columns
    points = written(features.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("__rows")))
    centers = _starts(points.select(*columns), restarts, k, seed)
    if centers is None:
        return np.empty((0, len(columns))), 0.0
    dealt = _Boxes(points, columns, seed)
    limit = TOLERANCE * dealt.spread()
    cost = np.full(len(centers), np.inf)
    active = np.arange(len(centers))
    for _ in range(max_passes):
        totals, compared = dealt.reduced(centers[active])
        if report is not None:
            report.append((int(dealt.n.sum()) * len(active), compared))
        n, sums = totals[..., 0], totals[..., 1:-1]
        cost[active] = totals[..., -1].sum(axis=1)
        moved = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centers[active])
        shift = ((moved - centers[active]) ** 2).sum(axis=(1, 2))
        centers[active] = moved
        active = active[shift > limit]
        if not len(active):
            break
    best = int(cost.argmin())
    return centers[best], float(cost[best])


def nearest_center(variables: Sequence[str], centers: np.ndarray) -> Column:
    """0-based index of the nearest center (the first one on a tie), in one vectorised step
    over Arrow batches; NULL for rows with a gap, and when there is no center."""
    columns = [F.col(v).cast("double") for v in variables]
    if not len(centers):
        return F.lit(None).cast("int")

    @F.pandas_udf("int")
    def nearest(*values: pd.Series) -> pd.Series:
        x = np.stack([v.to_numpy(dtype=float) for v in values], axis=1)
        distance = sum((x[:, i, None] - centers[:, i]) ** 2 for i in range(x.shape[1]))
        return pd.Series(distance.argmin(axis=1), dtype="int32")

    whole = columns[0].isNotNull()
    for x in columns[1:]:
        whole = whole & x.isNotNull()
    return F.when(whole, nearest(*columns))


def group_label(number: Column) -> Column:
    return F.concat(F.lit("Grp"), number.cast("string"))


def kmeans_segments(
    df: DataFrame, variables: Sequence[str], k: int, restarts: int = RESTARTS, seed: int = 7
) -> DataFrame:
    """Adds ``SubSegment`` from k-means on the unscaled variables. Groups are numbered by
    their centers, so that equal input gives equal labels."""
    centers, _ = kmeans_centers(feature_matrix(df, variables), k, restarts, seed)
    ordered = np.array(sorted(centers.tolist()))
    return df.withColumn("SubSegment", group_label(nearest_center(variables, ordered)))


def ward_merge(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Groups of weighted points after merging down to ``k`` by least added variance."""
    return tools().cut(points.astype(float), weights.astype(float), k)[0]


def hierarchical_segments(df: DataFrame, variables: Sequence[str], k: int, at_once: int = AT_ONCE) -> DataFrame:
    """Adds ``SubSegment`` from agglomerative clustering with Ward's criterion, exact for any number of
    sessions (see ``operators.agglomerate``). Groups are numbered by their means. Sessions with a gap have no label.

    Labels come back by a join on the variables' values: equal sessions are one row on the right, and a
    value of very many sessions is split on the left by the engine."""
    labels = ward_labels(feature_matrix(df, variables), k, at_once).toDF(*[f"__{v}" for v in variables], "__label")
    same = F.lit(True)
    for v in variables:
        same = same & (F.col(v).cast("double") == F.col(f"__{v}"))
    return df.join(labels, same, "left").withColumn("SubSegment", group_label(F.col("__label"))).select(*[F.col(f"`{c}`") for c in df.columns if c != "SubSegment"], "SubSegment")
