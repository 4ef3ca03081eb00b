"""Approximate distinct counts as mergeable state.

A cell (dimensions and period) keeps a HyperLogLog sketch of its ids instead of the ids. Sketches of
cells are united, never counted again: over grouping sets, over coarser periods, and with the cells of rows that
arrive later. A stored table of cells therefore answers any roll-up without the ledger, and a new
day costs one pass over that day.

The relative standard error of an estimate is ``1.04 / sqrt(2 ** bits)`` (see :func:`standard_error`); few ids
are counted almost exactly. The estimate of a sketch made in one go is a little better than that of united
ones, so the last digits depend on how rows were split into tasks, always within that error. A sketch has at most ``2 ** bits`` bytes, whatever the number of ids.
The exact cube (:func:`tidemark.operators.cube.cube_measures`) stays the default of all KPIs.

Defined results: null ids are not counted; a cell with null ids only has the estimate 0; a null
dimension shows as ``unknown``; an empty table gives no cells."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cube import _rollups, name_nulls, subsets

BITS = 12
SKETCH = "sketch"


def standard_error(bits: int = BITS) -> float:
    return 1.04 / math.sqrt(2 ** bits)


def sketch_cells(df: DataFrame, dims: Sequence[str], fixed: Sequence[str], id_col: str, bits: int = BITS) -> DataFrame:
    """One row per finest cell: ``dims``, ``fixed`` and the sketch of its ids. Rows are folded into sketches before the exchange."""
    return name_nulls(df, dims).groupBy(*dims, *fixed).agg(F.hll_sketch_agg(F.col(id_col).cast("string"), bits).alias(SKETCH))


def united(*cells: DataFrame) -> DataFrame:
    """Cells of several tables as one table: sketches of equal cells are united."""
    together = cells[0]
    for more in cells[1:]:
        together = together.unionByName(more)
    return together.groupBy(*[c for c in together.columns if c != SKETCH]).agg(F.hll_union_agg(SKETCH).alias(SKETCH))


def coarser(cells: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    """Cells with columns replaced by coarser ones (a month by its quarter, a country by its region)."""
    return united(cells.withColumns(dict(changed)))


def rolled_up(cells: DataFrame, dims: Sequence[str], fixed: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Cells of all grouping sets (or ``sets``), with ``all`` for a dimension left out."""
    wanted = subsets(dims) if sets is None else [tuple(s) for s in sets]
    spread = cells.select(*fixed, SKETCH, F.explode(_rollups(dims, wanted)).alias("cell")).select("cell.*", *fixed, SKETCH)
    return united(spread)


def estimated(cells: DataFrame, out: str) -> DataFrame:
    """The cells with the estimate ``out`` in place of the sketch."""
    return cells.withColumn(out, F.hll_sketch_estimate(SKETCH)).drop(SKETCH)
