"""KPI cubes: every combination of dimensions, with 'all' for a dimension left out.

The input is reduced to one row per finest cell before anything is multiplied by the
number of grouping sets, so only domain-sized data is ever expanded. Additive measures are
summed from the cells. Distinct counts need the ids: see :func:`cube_distinct`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import dealt

ALL = "all"
UNKNOWN = "unknown"  # a real null, kept apart from the rolled-up level


def subsets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for r in range(len(dims), -1, -1) for s in combinations(dims, r)]


def name_nulls(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.withColumns({d: F.coalesce(F.col(d), F.lit(UNKNOWN)) for d in dims})


def _rollups(dims: Sequence[str], sets: Sequence[Sequence[str]]) -> Column:
    """Array of a cell's roll-ups: its dimensions with 'all' for those outside the set.

    Exploding it does what grouping sets do. It is preferred here because the ids of a
    frame stay hash-partitioned through it, and because a persisted cube is recognised by
    Spark when a view reads it twice, which it is not above an ``Expand`` node."""
    return F.array(*[
        F.struct(*[(F.col(d) if d in s else F.lit(ALL)).alias(d) for d in dims]) for s in sets
    ])


def cube_sums(
    df: DataFrame, dims: Sequence[str], fixed: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Cube of additive measures (sums and counts) over ``dims``, always split by ``fixed``."""
    dims, fixed = list(dims), list(fixed)
    cells = name_nulls(df, dims).groupBy(*dims, *fixed).agg(*[m.alias(c) for c, m in measures.items()])
    spread = cells.select(*fixed, *measures, F.explode(_rollups(dims, subsets(dims))).alias("cell"))
    return spread.select(*fixed, *measures, "cell.*").groupBy(*dims, *fixed).agg(
        *[F.sum(c).alias(c) for c in measures])


def cube_measures(
    df: DataFrame,
    dims: Sequence[str],
    fixed: Sequence[str],
    id_col: str,
    out: str,
    measures: Mapping[str, Column],
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Additive measures and the exact number of distinct ids ``out`` in every cell of the
    cube (of the grouping sets ``sets``, all unless given), from one reading of the rows.

    Rows are first reduced to (id, finest cell), with partial sums before the exchange. An
    id with a single cell counts once in every roll-up of that cell, so it is counted at the
    finest level and rolled up later like any sum. Only ids with several cells are expanded
    into their roll-ups and de-duplicated, where all cells of an id already are together. That
    step sorts and expands, so its rows are spread over many tasks (see :func:`~tidemark.session.dealt`)."""
    dims, fixed = list(dims), list(fixed)
    wanted = subsets(dims) if sets is None else [tuple(x) for x in sets]
    own, rollups = F.struct(*dims), _rollups(dims, wanted)
    named = name_nulls(df, dims)
    sums = [m.alias(c) for c, m in measures.items()]
    per_id = named.groupBy(id_col, *fixed, *dims).agg(*sums) if sums else named.select(id_col, *fixed, *dims).distinct()
    cells = F.count(F.lit(1)).over(Window.partitionBy(id_col, *fixed))
    known = F.col(id_col).isNotNull()
    # a finest cell with its sums, which counts the id if it is its only one; and, for ids
    # with several cells, each roll-up they reach (its sums are null, it counts the id)
    placed = dealt(per_id, id_col, *fixed).withColumn("__cells", cells).select(
        id_col, *fixed, *measures, F.explode(F.concat(
            F.array(F.struct(F.lit(False).alias("ready"), own.alias("cell"), (known & (F.col("__cells") == 1)).cast("long").alias("ids"))),
            F.when(known & (F.col("__cells") > 1), F.transform(rollups, lambda c: F.struct(F.lit(True).alias("ready"), c.alias("cell"), F.lit(1).cast("long").alias("ids"))))
            .otherwise(F.array().cast(f"array<struct<ready:boolean,cell:struct<{','.join(f'{d}:string' for d in dims)}>,ids:bigint>>")))).alias("x"))
    once = placed.groupBy(id_col, *fixed, "x.ready", "x.cell").agg(
        F.max("x.ids").alias(out), *[F.sum(F.when(~F.col("x.ready"), F.col(c))).alias(c) for c in measures])
    counted = once.groupBy(*fixed, "ready", "cell").agg(*[F.sum(c).alias(c) for c in (out, *measures)])
    spread = counted.select(*fixed, "ready", "cell.*", out, *measures)
    rolled = spread.select(*fixed, out, *measures, F.explode(F.when(F.col("ready"), F.array(own)).otherwise(rollups)).alias("cell"))
    return rolled.select(*fixed, out, *measures, "cell.*").groupBy(*dims, *fixed).agg(*[F.sum(c).alias(c) for c in (out, *measures)])


def cube_distinct(df: DataFrame, dims: Sequence[str], fixed: Sequence[str], id_col: str, out: str) -> DataFrame:
    """Exact number of distinct ids in every cell of the cube."""
    return cube_measures(df.select(id_col, *fixed, *dims), dims, fixed, id_col, out, {})


def _exact(df: DataFrame, name: str, kind: str) -> F.Column:
    """A measure as a number whose sums are exact."""
    is_float = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    whole = isinstance(df.schema[name].dataType, T.IntegralType)
    return F.col(name).cast(kind if is_float else "decimal(18,0)") if is_float or whole else F.col(name)


def weighted_rollup(
    df: DataFrame, path: Sequence[str], value: str, weighted: str, root: str
) -> DataFrame:
    """Totals along a hierarchy, with the value-weighted mean of a second measure.

    One row per node of the hierarchy: ``level`` 0 is the root. ``share_of_root`` is the
    node's part of the grand total in percent. Sums are of decimals, so they don't depend on the order of rows: doubles
    are taken to 8 places (values) and 10 places (the second measure), whole numbers and decimals as they are."""
    path = list(path)
    value_, weighted_ = _exact(df, value, "decimal(18,8)"), _exact(df, weighted, "decimal(19,10)")
    sets = [[F.col(c) for c in path[:n]] for n in range(len(path), -1, -1)]
    nodes = df.groupingSets(sets, *path).agg(
        F.sum(value_).cast("double").alias(value),
        F.sum(value_ * weighted_).cast("double").alias("__weighted"),
        *[F.grouping(c).alias(f"__g_{c}") for c in path],
    )
    depth = F.lit(len(path)) - sum([F.col(f"__g_{c}") for c in path], F.lit(0))
    # the nodes are as few as the domain has values, so one partition holds them
    total = F.max(F.when(F.col(f"__g_{path[0]}") == 1, F.col(value))).over(Window.partitionBy(F.lit(1)))
    return nodes.select(
        F.lit(root).alias("root"),
        *[F.when(F.col(f"__g_{c}") == 1, F.lit(ALL)).otherwise(F.col(c)).alias(c) for c in path],
        depth.cast("int").alias("level"),
        F.col(value),
        F.try_divide(F.col("__weighted"), F.col(value)).alias(weighted),
        (F.try_divide(F.col(value), total) * 100).alias("share_of_root"),
    )
