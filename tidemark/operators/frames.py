"""Steps on KPI frames: changes, running balances, latest rows, shares.

KPI frames hold one row per segment and period, so a window per segment is bounded by the
number of periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidemark.functions.numbers import ratio, round_half_up


def whole_frame() -> WindowSpec:
    """All rows together: for aggregated frames only."""
    return Window.partitionBy(F.lit(1))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def running_balance(
    df: DataFrame, segment: Sequence[str], order: Sequence[str], balances: Mapping[str, str]
) -> DataFrame:
    """``balances``: new column -> measure summed up to and including the row's period."""
    so_far = (
        Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({c: F.sum(x).over(so_far) for c, x in balances.items()})


def densified(
    df: DataFrame, segment: Sequence[str], date: str, step: str, flows: Sequence[str]
) -> DataFrame:
    """A row for every period of every segment, from the segment's first period to the frame's last one.

    ``step`` is the length of a period as an interval. ``flows`` are 0 in the added rows, other
    columns NULL. Works on aggregated frames: the spine has one row for each segment and period, made by the task
    that has the segment, and nothing is added before a segment's first period."""
    spans = df.groupBy(*segment).agg(F.min(date).alias("__first"))
    last = df.agg(F.max(date)).scalar()
    spine = spans.select(*segment, F.explode(F.sequence("__first", last, F.expr(f"interval {step}"))).alias(date))
    return spine.join(df, [*segment, date], "left").na.fill(0, list(flows)).select(*df.columns)


def percent_change(
    df: DataFrame,
    segment: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    places: int | None = None,
) -> DataFrame:
    """Add ``pct_change_<c>``: change in percent to the segment's previous row.

    A null counts as the last known value. The first row of a segment, and a row after a
    zero, have no change (NULL)."""
    columns = numeric_columns(df) if columns is None else list(columns)
    ordered = Window.partitionBy(*segment).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def change(c: str) -> Column:
        now = F.last(c, ignorenulls=True).over(so_far)
        prev = F.last(c, ignorenulls=True).over(before)
        x = (ratio(now, prev) - 1) * 100
        return x if places is None else round_half_up(x, places)

    return df.withColumns({f"pct_change_{c}": change(c) for c in columns})


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) in the order. An aggregate, so rows of a
    hot key are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def at_maximum(df: DataFrame, column: str) -> DataFrame:
    """Rows that hold the maximum of the column over the whole frame."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def beyond_maximum(df: DataFrame, column: str, other: str) -> DataFrame:
    """Rows whose ``column`` lies after the maximum of ``other`` over the whole frame."""
    return df.where(F.col(column) > df.agg(F.max(other)).scalar())


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def percent_of_total(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its percentage of the column's total. For aggregated frames
    (a few hundred rows): one partition holds them, and their input is read only once."""
    return df.withColumns({c: ratio(F.col(c), F.sum(c).over(whole_frame())) * 100 for c in columns})


def share_within(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """The column's share of its group total; for aggregated frames."""
    return df.withColumn(out, ratio(F.col(column), F.sum(column).over(Window.partitionBy(*keys))))


def percent_of_group_maximum(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    top = F.max(column).over(Window.partitionBy(*keys))
    return df.withColumn(out, ratio(F.col(column), top) * 100)


def flag_extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_extreme``: 'max', 'min' or NULL, column by column over the whole frame. For
    aggregated frames, as :func:`percent_of_total`."""
    quoted = {c: F.col(f"`{c}`") for c in columns}  # titles may hold dots
    return df.withColumns({
        f"{c}_extreme": F.when(q == F.max(q).over(whole_frame()), "max").when(q == F.min(q).over(whole_frame()), "min")
        for c, q in quoted.items()
    })


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])
