"""Customer segments from session variables, and their profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio, remap, right_closed_bin
from tidemark.operators.frames import percent_of_total
from tidemark.operators.quantiles import double_of, integers_at_ranks, is_value, ordered_bits
from tidemark.operators.scan import ordered_scan
from tidemark.plans.sessions import ANALYSIS_VARS, LOG_VARS, SHORT_NAMES

RANK_SEED = 42
PROFILE_VARS = ANALYSIS_VARS + LOG_VARS


def tie_break(id_col: str = "TransactionId") -> Column:
    """Seeded pseudo-random order among equal values, the same on every run."""
    return F.xxhash64(F.col(id_col), F.lit(RANK_SEED))


def range_bins(df: DataFrame, column: str, splits: int) -> Column:
    """Bin of the min-max scaled value; a constant column is all bin 1, a null has no bin."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.struct(
        F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("b")).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    share = F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
    return F.when(x.isNotNull(), right_closed_bin(share, splits))


def rank_bins(df: DataFrame, column: str, splits: int, id_col: str = "TransactionId") -> Column:
    """Bin of rank / count, with equal values in seeded random order; nulls and NaN have none.

    Only the ranks at the bin edges matter (at most three), so they are looked up instead
    of ranking all rows: first the value at each edge, then the tie-break among the rows
    that share it. Nothing is sorted or shuffled."""
    x = F.col(column).cast("double")
    narrow = df.select(ordered_bits(x).alias("v"), tie_break(id_col).alias("t")).where("v is not null").persist()  # read a few times
    try:
        n = narrow.count()
        last_ranks = [n * i // splits - 1 for i in range(1, splits)]  # 0-based rank that ends bin i
        values = integers_at_ranks(narrow, {"v": sorted({r for r in last_ranks if r >= 0})})["v"]
        v = F.col("v")
        sides = narrow.agg(
            F.count(v), *[c for x in values.values() for c in (F.count_if(v < x), F.count_if(v == x))]).first()
        edges = {}
        for i, (r, value) in enumerate(values.items()):
            below, same = sides[1 + 2 * i], sides[2 + 2 * i]
            at = F.lit(double_of(value))
            past = x > at
            if r - below < same - 1:  # the edge runs through the rows with this value
                last = integers_at_ranks(narrow.where(v == value), {"t": [r - below]})["t"][r - below]
                past = past | ((x == at) & (tie_break(id_col) > last))
            edges[r] = F.when(past, 1).otherwise(0)
    finally:
        narrow.unpersist()
    bin_ = sum([edges.get(r, F.lit(1)) for r in last_ranks], F.lit(1))
    return F.when(is_value(x), bin_)


def rank_share(df: DataFrame, column: str, id_col: str = "TransactionId") -> DataFrame:
    """Adds ``rank_share``: rank / count of every row, ties in seeded random order.

    The one global order is cut by the digits of the value's place among all doubles and then
    of the tie-break, so pieces get finer wherever rows are dense, whatever their number."""
    rows = df.withColumns({"__value": F.col(column).cast("double"), "__tie": tie_break(id_col)})
    rows = rows.withColumn("__place", ordered_bits(F.col("__value"))).where("__place is not null")
    slices = [F.shiftright("__place", 48), F.shiftright("__place", 24), F.col("__place"), F.shiftright("__tie", 40)]
    ranked = ordered_scan(rows, [], ["__place", "__tie"], slices, sums={"__rank": F.lit(1)})
    n = df.agg(F.count_if(is_value(F.col(column).cast("double")))).scalar()
    return ranked.withColumn("rank_share", ratio(F.col("__rank"), n)).drop("__value", "__tie", "__place", "__rank")


def fixed_segments(
    df: DataFrame, splits: Mapping[str, int], by_rank: Sequence[str] = (), id_col: str = "TransactionId"
) -> DataFrame:
    """Adds a label per variable (short name and bin number) and their join ``SubSegment``.

    ``splits``: variable -> number of bins; variables in ``by_rank`` are binned by rank.
    A null value has no label, and then no segment."""
    labels = {}
    for v, k in splits.items():
        bin_ = rank_bins(df, v, k, id_col) if v in by_rank else range_bins(df, v, k)
        short = SHORT_NAMES.get(v, v[0:12:2])  # fixed rule: every second letter of the first twelve
        labels[f"{short}Grp"] = F.concat(F.lit(short), bin_.cast("string"))
    parts = [p for name in labels for p in (F.lit("_"), F.col(name))][1:]
    # concat, not concat_ws: a missing label must leave no segment
    return df.withColumns(labels).withColumn("SubSegment", F.concat(*parts))


def segment_profile(df: DataFrame, by: str = "SubSegment") -> DataFrame:
    """Share of sessions and of energy in percent, and the mean of every variable."""
    profile = df.groupBy(by).agg(
        F.count("TransactionId").alias("SegmentShare"),
        F.sum("TotalEnergy").alias("EnergyShare"),
        *[F.avg(v).alias(v) for v in PROFILE_VARS],
    )
    return percent_of_total(profile, ["SegmentShare", "EnergyShare"]).orderBy(by)


def regroup(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``Segment``: sub-segments merged by a name mapping; unmapped ones keep their name."""
    return df.withColumn("Segment", remap(F.col("SubSegment"), mapping) if mapping else F.col("SubSegment"))


def unassigned(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Sub-segments that no mapping entry names."""
    found = df.select("SubSegment").where(F.col("SubSegment").isNotNull())
    return found.where(~F.col("SubSegment").isin(list(mapping))).distinct().orderBy("SubSegment")


def regroup_segments(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return segment_profile(regroup(df, mapping), "Segment")
