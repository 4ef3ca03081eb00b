"""Distribution tables of the session variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.quantiles import exact_percentiles, ordered_bits
from tidemark.operators.scan import ordered_scan

PERCENTILES = [0.05, 0.5, 0.95]
QUARTILES = [0.25, 0.5, 0.75]
WHISKER = 1.5


def describe_features(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum, 5 %, 50 %, 95 % and maximum: a row per statistic, a column
    per variable."""
    shares = exact_percentiles(df, variables, PERCENTILES)
    moments = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    once = df.agg(*[f(v).alias(f"{s}_{v}") for s, f in moments.items() for v in variables])

    def row(name: str, values):
        return F.struct(F.lit(name).alias("statistic"), *[
            x.cast("double").alias(v) for v, x in zip(variables, values)])

    rows = [row(s, [F.col(f"{s}_{v}") for v in variables]) for s in ("mean", "std", "min")]
    rows += [row(f"{p:.0%}", [F.lit(shares[v][i]) for v in variables]) for i, p in enumerate(PERCENTILES)]
    rows.append(row("max", [F.col(f"max_{v}") for v in variables]))
    return once.select(F.inline(F.array(*rows)))


def long_form(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    doubles = df.select(*keep, *[F.col(v).cast("double").alias(v) for v in variables])
    return doubles.unpivot(list(keep), list(variables), "variable", "value").where(F.col("value").isNotNull())


def histograms(df: DataFrame, variables: Sequence[str], bins: int) -> DataFrame:
    """Percent of rows per equal-width bin and variable; the last bin includes the maximum.

    Bounds are a few numbers per variable, so they enter the second pass as literals."""
    bounds = df.agg(*[f(v).cast("double").alias(f"{n}_{v}") for n, f in (("lo", F.min), ("hi", F.max)) for v in variables]).first()

    def bin_of(v: str):
        lo, hi = bounds[f"lo_{v}"], bounds[f"hi_{v}"]
        if lo is None or lo == hi:
            return F.when(F.col(v).isNotNull(), 0)
        x = F.col(v).cast("double")
        return F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")

    counted = (
        df.select(*[bin_of(v).alias(v) for v in variables])
        .unpivot([], list(variables), "variable", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counted.groupBy("variable").agg(F.sum("n").alias("total"))
    return counted.join(totals, "variable").select(
        "variable", "bin", "n", (ratio(F.col("n"), F.col("total")) * 100).alias("pct"))


def box_statistics(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 quartile ranges of the box."""
    quartiles = exact_percentiles(df, variables, QUARTILES)
    reach = {}
    for v in variables:
        q1, _, q3 = quartiles[v]
        reach[v] = (None, None) if q1 is None else (q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1))

    def fences(v: str):
        lo, hi = reach[v]
        x = F.col(v).cast("double")
        q1, q2, q3 = quartiles[v]
        return F.struct(
            F.lit(v).alias("variable"),
            F.lit(q1).cast("double").alias("q1"), F.lit(q2).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
            F.min(F.when(x >= F.lit(lo), x)).alias("low"), F.max(F.when(x <= F.lit(hi), x)).alias("high"),
        )

    return df.agg(F.array(*[fences(v) for v in variables]).alias("boxes")).select(F.inline("boxes"))


def box_by_group(df: DataFrame, by: str, variable: str) -> DataFrame:
    """Quartiles and whiskers of one variable for every value of a label column.

    Grouped inside the plan, whatever the number of labels. Rows are counted by (label, value) first,
    which partial sums do before any move; the running count of a label's values then
    gives the ranks, cut into slices of values so that no label is one task's work."""
    v = F.col(variable).cast("double")
    counted = (
        df.select(F.col(by).alias("label"), ordered_bits(v).alias("place"), v.alias("v")).where("label is not null and place is not null")
        .groupBy("label", "place").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")))
    upto = ordered_scan(counted, ["label"], ["place"], [F.shiftright("place", 48), F.shiftright("place", 24)], sums={"upto": F.col("n")})
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    ranked = upto.join(totals, "label")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("place")))  # the first value that reaches the rank

    def value(p: float, side) -> Column:
        return at(side((F.col("total") - 1) * F.lit(p)))

    places = ranked.groupBy("label").agg(
        F.min("total").alias("total"), *[value(p, side).alias(f"{n}{i}") for i, p in enumerate(QUARTILES) for n, side in (("lo", F.floor), ("hi", F.ceil))])
    values = places
    for i in range(len(QUARTILES)):
        for n in ("lo", "hi"):
            found = counted.select("label", F.col("place").alias(f"{n}{i}"), F.col("v").alias(f"v{n}{i}"))
            values = values.join(found, ["label", f"{n}{i}"])
    quartile = {}
    for i, p in enumerate(QUARTILES):
        x = (F.col("total") - 1) * F.lit(p)
        low, high = F.col(f"vlo{i}"), F.col(f"vhi{i}")
        quartile[i] = F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)
    boxes = values.select("label", quartile[0].alias("q1"), quartile[1].alias("median"), quartile[2].alias("q3"))
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    whiskers = counted.join(boxes, "label").groupBy("label").agg(
        F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("low"), F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("high"))
    return boxes.join(whiskers, "label").select(F.col("label").alias(by), "q1", "median", "q3", "low", "high")
