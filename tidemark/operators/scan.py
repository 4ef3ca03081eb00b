"""Running sums, forward fills and lags over very long ordered groups.

A plain window puts every row of a group into one task. Here every group is cut along its
order into slices, from coarse to fine: each finest slice is scanned on its own, and what a
slice inherits from the earlier ones (its *carry*) is worked out from one total per slice.
The plan is the same at every size and for every key; nothing is measured. The result is that
of the plain window row by row.

Slices are dealt to many tasks, as one struct of all their columns (see :func:`~tidemark.session.dealt`): a struct is
never null, so null keys meet in a plain join, which keeps how rows are dealt and sorted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import dealt

PLACE = "__place"
ID_BLOCK_BITS = 20  # rows of one instant are cut into id blocks of about a million


def id_block(id_col: Column) -> Column:
    """Order-preserving cut of unique ids into blocks of bounded size."""
    return F.shiftright(id_col, ID_BLOCK_BITS)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in the (ascending, unique) ``order``; nulls come first.

    ``sums``: running total; ``lasts``: last non-null value so far; ``previous``: value of
    the row before. ``slices`` lists, coarse to fine, expressions that cut the order into
    consecutive pieces; a null is a first slice of its own. Without keys there is one group,
    the whole frame. Null keys are groups like any other."""
    keys, order = list(keys), list(order)
    sums, lasts, previous = dict(sums or {}), dict(lasts or {}), dict(previous or {})
    cuts = [f"__cut{i}" for i in range(len(slices))]
    cut_rows = df.withColumns({c: F.struct(s.isNotNull().alias("known"), s.alias("at")) for c, s in zip(cuts, slices)})
    carry = _carry(cut_rows, keys, cuts, order, sums, lasts, previous)
    # Spelled out, because a frame that is already hashed by the keys alone would
    # otherwise keep all slices of a key in one partition.
    spread = dealt(_placed(cut_rows, keys + cuts), PLACE)
    local = _scan_groups(spread, [PLACE], order, sums, lasts, previous)
    joined = _attach(local, dealt(_placed(carry, keys + cuts), PLACE), keys + cuts)
    merged = {c: F.coalesce(F.col(c) + F.col(f"__carry_{c}"), F.col(c), F.col(f"__carry_{c}")) for c in sums}
    merged |= {c: F.coalesce(F.col(c), F.col(f"__carry_{c}")["v"]) for c in lasts}
    merged |= {c: F.coalesce(F.col(c), F.col(f"__carry_{c}"))["v"] for c in previous}
    out = joined.withColumns(merged)
    return out.drop(*cuts, *[f"__carry_{c}" for c in merged])


def _placed(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.withColumn(PLACE, F.struct(*on))


def _attach(rows: DataFrame, lines: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of placed rows with a placed line for each place; the columns of ``on`` may be null."""
    return rows.join(lines.drop(*on), PLACE, "left").drop(PLACE)


def _scan_groups(df, group, order, sums, lasts, previous) -> DataFrame:
    ordered = Window.partitionBy(*group).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {c: F.sum(x).over(so_far) for c, x in sums.items()}
    columns |= {c: F.last(x, ignorenulls=True).over(so_far) for c, x in lasts.items()}
    # in a struct, so that a null value of the previous row differs from "no previous row"
    columns |= {c: F.lag(F.struct(x.alias("v"))).over(ordered) for c, x in previous.items()}
    return df.withColumns(columns)


def _carry(df, keys, cuts, order, sums, lasts, previous) -> DataFrame:
    """For every slice, what all earlier slices of its group leave behind.

    Worked out from totals, one nesting level at a time, so that no window ever spans more
    than the slices of one parent slice."""
    at = F.struct(*order)
    totals = df.groupBy(*keys, *cuts).agg(
        *[F.sum(x).alias(c) for c, x in sums.items()],
        *[F.max_by(F.struct(x.alias("v")), F.when(x.isNotNull(), at)).alias(c) for c, x in lasts.items()],
        *[F.max_by(F.struct(x.alias("v")), at).alias(c) for c, x in previous.items()],
    )
    latest = [*lasts, *previous]
    carry = None
    for depth in range(1, len(cuts) + 1):
        parent, here, below = keys + cuts[: depth - 1], cuts[depth - 1], cuts[depth:]
        level = totals
        if below:
            level = totals.groupBy(*parent, here).agg(
                *[F.sum(c).alias(c) for c in sums],
                *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*below))).alias(c) for c in latest],
            )
        before = Window.partitionBy(*parent).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        step = level.select(
            *parent,
            here,
            *[F.sum(c).over(before).alias(f"__carry_{c}") for c in sums],
            *[F.last(c, ignorenulls=True).over(before).alias(f"__carry_{c}") for c in latest],
        )
        if carry is not None:
            above = carry.withColumnsRenamed({f"__carry_{c}": f"__above_{c}" for c in [*sums, *latest]})
            # Spelled out for the same reason. A line is narrow, but there can be as many lines as rows: a number on
            # one side of the join is that of both, and keeps adaptive execution from merging their parts.
            step = _attach(dealt(_placed(step, parent), PLACE, share=2), _placed(above, parent).repartition(PLACE), parent)
            step = step.withColumns(
                {f"__carry_{c}": F.coalesce(F.col(f"__carry_{c}") + F.col(f"__above_{c}"),
                                            F.col(f"__carry_{c}"), F.col(f"__above_{c}")) for c in sums}
                | {f"__carry_{c}": F.coalesce(f"__carry_{c}", f"__above_{c}") for c in latest}
            ).drop(*[f"__above_{c}" for c in [*sums, *latest]])
        carry = step
    return carry
