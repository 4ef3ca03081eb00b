"""The steps of a scan that sort rows are dealt to a spelled-out number of tasks, and null keys stay groups."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.scan import ordered_scan
from tidemark.session import LEAST_TASKS


def test_scan_is_spread(spark):
    day = dt.datetime(2024, 1, 1)
    made = [(None if i % 3 == 0 else i % 5, None if i % 11 == 0 else day + dt.timedelta(hours=7 * (i % 40)), i, i if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(made, "user bigint, at timestamp_ntz, id bigint, n bigint")
    out = ordered_scan(
        df, ["user"], ["at", "id"], [F.to_date("at"), F.struct("at", F.shiftright("id", 4).alias("block"))],
        sums={"total": F.col("n")}, lasts={"last": F.col("n")}, previous={"before": F.col("n")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{LEAST_TASKS}), REPARTITION_BY_NUM") == 2  # rows and carry
    assert "coalesce(user" not in plan  # null keys don't cost another exchange
    state, wanted = {}, {}
    for user, at, i, n in sorted(made, key=lambda r: (r[1] is not None, r[1] or day, r[2])):
        total, last, before = state.get(user, (None, None, None))
        new = total if n is None else (total or 0) + n
        wanted[i] = (new, last if n is None else n, before)
        state[user] = (new, wanted[i][1], n)
    assert {r.id: (r.total, r.last, r.before) for r in out.collect()} == wanted


def test_lines_of_slices_are_spread(spark):
    # a day per row, so there are as many lines of slices as rows
    day = dt.datetime(2024, 1, 1)
    made = [(i % 4 or None, day + dt.timedelta(days=i), i) for i in range(200)]
    df = spark.createDataFrame(made, "user bigint, at timestamp_ntz, n bigint")
    out = ordered_scan(df, ["user"], ["at"], [F.to_date("at"), F.struct("at")], sums={"total": F.col("n")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{LEAST_TASKS // 2}), REPARTITION_BY_") == 2  # a slice's lines and those of its parent
    assert {r.n: r.total for r in out.collect()} == {i: sum(range(i % 4, i + 1, 4)) for i in range(200)}
