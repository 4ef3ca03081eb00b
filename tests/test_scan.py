"""Cutting groups must not change any row."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.scan import ordered_scan
from tidemark.plans.ledger import event_slices

ORDER = ["trxn_datetime", "trxn_id"]


@pytest.fixture(scope="module")
def events(spark):
    # user 0 holds a third of the rows, most of them at one instant
    n = F.col("id")
    user = F.when(n % 3 == 0, 0).otherwise(n % 17 + 1)
    hour = F.when((n % 3 == 0) & (n % 5 != 0), 100).otherwise(n * 7919 % 500)
    time = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int"))
    return spark.range(6000).select(
        F.when(user != 5, user).alias("user_id"),  # a null key is a group of its own
        (n * 700_001 % 60_000_000).alias("trxn_id"),
        F.when(n % 11 != 0, time).alias("trxn_datetime"),  # events without a time come first
        (n % 7 - 3).alias("v"),
        F.when(n % 4 == 0, n).alias("sparse"),
    ).persist()


def plain(df, keys):
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "total": F.sum("v").over(run), "filled": F.last("sparse", ignorenulls=True).over(run), "before": F.lag("sparse").over(w)})


@pytest.mark.parametrize("keys", [["user_id"], []])
def test_cut_scan_equals_plain_window(events, keys):
    got = ordered_scan(
        events, keys, ORDER, event_slices(), sums={"total": F.col("v")}, lasts={"filled": F.col("sparse")},
        previous={"before": F.col("sparse")})
    want = plain(events, keys or [F.lit(1)]).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_slices_of_a_key_go_to_different_partitions(events):
    # the input is hashed by user already, which must not keep all slices of user 0 together
    hashed = events.repartition(8, "user_id")
    got = ordered_scan(hashed, ["user_id"], ORDER, event_slices(), sums={"total": F.col("v")})
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()


def test_empty_frame(events):
    assert ordered_scan(events.limit(0), ["user_id"], ORDER, event_slices(), sums={"total": F.col("v")}).count() == 0
