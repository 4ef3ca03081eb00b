"""Exact percentiles of very long columns.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here the
value at a wanted rank is closed in on instead: each pass counts the rows of the current value
range by a few leading bits (combined on the map side, a few thousand counts in all), and
the next pass looks only into the part that holds the rank. No rows are sorted or shuffled,
and all columns and ranks share the passes.

Doubles are compared by an order-preserving 64-bit integer, so each pass settles ``BITS`` of at
most 64 bits and the number of passes is bounded for any values. Infinite values are the
least and the greatest; nulls and NaN are not values and left out."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 11
PASSES = -(-64 // BITS) + 1
_TOP = (1 << 63) - 1


def is_value(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def ordered_bits(v: Column) -> Column:
    """A 64-bit integer in the order of doubles; null for null and NaN."""
    plain = F.when(is_value(v), v + F.lit(0.0)).otherwise(F.lit(0.0))  # adding zero makes both zeros one
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
    return F.when(is_value(v), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_TOP))))


def double_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ _TOP))[0]


def integers_at_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, dict[int, int]]:
    """Per 64-bit integer column the values at 0-based ranks among its non-null rows."""
    columns = [c for c, wanted in ranks.items() if wanted]
    if not columns:
        return {c: {} for c in ranks}
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # (column, rank) -> (rows below the range, least and greatest value in the range)
    open_ranges = {(c, r): (0, ends[f"lo{i}"], ends[f"hi{i}"]) for i, c in enumerate(columns) for r in ranks[c]}
    found: dict[str, dict[int, int]] = {c: {} for c in ranks}
    for _ in range(PASSES):
        for at, (_, lo, hi) in list(open_ranges.items()):
            if lo == hi:
                found[at[0]][at[1]] = lo
                del open_ranges[at]
        if not open_ranges:
            return found
        spans = sorted({(c, lo, hi) for (c, _), (_, lo, hi) in open_ranges.items()})
        hits = F.array(*[
            F.when(F.col(c).between(lo, hi), F.struct(
                F.lit(i).alias("span"), F.shiftright(c, max(0, (hi - lo).bit_length() - BITS)).alias("part"), F.col(c).alias("x")))
            for i, (c, lo, hi) in enumerate(spans)
        ])
        counts = df.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit"))
        parts: dict[int, list] = {}
        for row in counts.groupBy("hit.span", "hit.part").agg(
            F.count(F.lit(1)).alias("n"), F.min("hit.x").alias("lo"), F.max("hit.x").alias("hi")
        ).collect():  # at most 2 ** BITS + 1 rows per span
            parts.setdefault(row["span"], []).append((row["part"], row["n"], row["lo"], row["hi"]))
        for at, (below, lo, hi) in list(open_ranges.items()):
            for _, n, part_lo, part_hi in sorted(parts[spans.index((at[0], lo, hi))]):
                if at[1] < below + n:
                    break
                below += n
            open_ranges[at] = (below, part_lo, part_hi)
    raise AssertionError("every pass settles some bits")


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks among the column's values."""
    return _doubles(df, {column: ranks})[column]


def _doubles(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    names = {c: f"v{i}" for i, c in enumerate(ranks)}
    bits = df.select(*[ordered_bits(F.col(c).cast("double")).alias(n) for c, n in names.items()]).persist()
    try:
        found = integers_at_ranks(bits, {names[c]: wanted for c, wanted in ranks.items()})
    finally:
        bits.unpersist()
    return {c: {r: double_of(x) for r, x in found[n].items()} for c, n in names.items()}


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Interpolated percentiles per column; a handful of numbers, so they are returned as such."""
    rows = df.agg(*[F.count_if(is_value(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = {c: [(rows[f"n{i}"] - 1) * p for p in probs] if rows[f"n{i}"] else [] for i, c in enumerate(columns)}
    values = _doubles(df, {c: sorted({r for x in at for r in (math.floor(x), math.ceil(x))}) for c, at in places.items()})
    return {c: [_between(values[c], x) for x in at] if at else [None] * len(probs) for c, at in places.items()}


def _between(values: Mapping[int, float], x: float) -> float:
    low, high = values[math.floor(x)], values[math.ceil(x)]
    if low == high:  # also for infinite values
        return low
    return (math.ceil(x) - x) * low + (x - math.floor(x)) * high
