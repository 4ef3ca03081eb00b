"""Tables behind the KPI charts, each a short step on the KPI frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio, remap, round_half_up
from tidemark.operators.cube import ALL, weighted_rollup
from tidemark.operators.frames import percent_of_group_maximum
from tidemark.plans.kpis import first_due, latest_period

MILLIONTH = 0.000001
# Root of the tree, types that pay a deposit out, labels of steps.
ROOT = "Europe"
REALIZED_TYPES = ["break", "withdraw", "mature", "renew"]
STEP_LABELS = {"verify": "Verified", "reject": "Rejected"}


def level(**wanted: str | bool) -> Column:
    """Rows of a cube level: ``dim=True`` keeps single values, ``dim='x'`` that value."""
    tests = [(F.col(d) != ALL) if v is True else (F.col(d) == v) for d, v in wanted.items()]
    test = tests[0]
    for t in tests[1:]:
        test = test & t
    return test


def deposits_over_time(kpis: DataFrame) -> DataFrame:
    """Cumulative deposit volume by service (with the 'all' series)."""
    so_far = Window.partitionBy("service").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = kpis.where(level(country=ALL, trxn_type=ALL, trxn_group=ALL))
    return rows.select("service", "date", "TPV", F.sum("TPV").over(so_far).alias("cum_TPV"))


def due_vs_realized(kpis: DataFrame, dues: DataFrame) -> DataFrame:
    """Volume of the types that end or renew a deposit, next to deposits falling due."""
    realized = kpis.where(
        F.col("trxn_type").isin(REALIZED_TYPES) & level(country=ALL, trxn_group=ALL, service=ALL)
    ).select(F.col("trxn_type").alias("series"), "date", F.abs("ATPV").alias("value"))
    due = dues.where(level(country=ALL, service=ALL, trxn_group=ALL, trxn_type=ALL)).select(
        F.lit("Due Deposits").alias("series"), F.col("mdate").alias("date"), F.col("DD").alias("value"))
    return realized.unionByName(due)


def segment_tree(acquisition: DataFrame) -> DataFrame:
    """Verified and rejected users of the last period by country, channel and outcome, with
    the user-weighted acquisition cost at every level."""
    cells = latest_period(acquisition).where(
        level(country=True, channel=True) & F.col("trxn_type").isin(list(STEP_LABELS)))
    cells = cells.withColumn("trxn_type", remap(F.col("trxn_type"), STEP_LABELS))
    return weighted_rollup(cells, ["country", "channel", "trxn_type"], "U", "A_CAC", ROOT)


def channel_funnel(acquisition: DataFrame) -> DataFrame:
    """Users per step and channel in the last period, in percent of the channel's largest step."""
    steps = latest_period(acquisition).where(level(country=ALL, channel=True) & (F.col("trxn_type") != "reject"))
    funnel = percent_of_group_maximum(steps, ["channel"], "U", "pct_of_max")
    return funnel.select("channel", "trxn_type", "U", "pct_of_max").orderBy(F.desc("U"), "channel", "trxn_type")


def due_ratio_by_country(dues: DataFrame, kpis: DataFrame) -> DataFrame:
    """Deposits falling due in the nearest due period, in percent of deposits under
    management; countries with only one of the two have no ratio."""
    by_country = level(country=True, service=ALL, trxn_group=ALL, trxn_type=ALL)
    managed = latest_period(kpis).where(by_country).select("country", "DUM")
    coming = first_due(dues).where(by_country)
    nearest = coming.where(F.col("mdate") == coming.agg(F.min("mdate")).scalar()).select("country", "DD")
    both = nearest.join(managed, "country", "full")
    pct = round_half_up(ratio(F.col("DD"), F.col("DUM")) * 100, 2)
    return both.select("country", "DD", "DUM", pct.alias("due_pct"))


def due_vs_managed(dues: DataFrame, kpis: DataFrame) -> DataFrame:
    """Long table of managed (DUM) and due (DD) deposits by country and service, in
    millions, with a signed logarithm: managed counts up, due counts down."""
    cells = level(country=True, service=True, trxn_group=ALL, trxn_type=ALL)
    managed = latest_period(kpis).where(cells).unpivot(["country", "service"], ["DUM"], "variable", "value")
    due = first_due(dues).where(cells).unpivot(["country", "service"], ["DD"], "variable", "value")
    long = due.unionByName(managed).withColumn("value", F.col("value").cast("double")).where(F.col("value") != 0)
    # no logarithm for negative balances
    size = F.when(F.col("value") > 0, F.log10("value"))
    return long.withColumns({
        "signed_value": F.when(F.col("variable") == "DUM", size).otherwise(-size),
        "value": F.col("value") * MILLIONTH,
    })


def due_vs_managed_tree(dues: DataFrame, kpis: DataFrame) -> DataFrame:
    """:func:`due_vs_managed` totalled by country, service and kind."""
    path = ["country", "service", "variable"]
    return weighted_rollup(due_vs_managed(dues, kpis), path, "value", "signed_value", ROOT)
