"""Steps that sort or expand rows of ids are spread over many tasks, whatever the number of cores."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.cube import cube_measures
from tidemark.session import LEAST_TASKS, dealt


def rows(spark):
    made = [(i % 50, f"s{i % 3}" if i % 7 else None, dt.date(2024, 1 + i % 2, 1), i) for i in range(400)]
    return spark.createDataFrame(made, "user_id bigint, service string, date date, n bigint")


def parts(df):
    """Numbers of parts that the plan spells out."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"{LEAST_TASKS}), REPARTITION_BY_NUM")


def test_cube_is_spread(spark):
    cube = cube_measures(rows(spark), ["service"], ["date"], "user_id", "users", {"n": F.sum("n")})
    assert parts(cube) == 1
    got = {(r.service, r.date.month): (r.users, r.n) for r in cube.collect()}
    whole = [i for i in range(400) if i % 2 == 0]
    assert got["all", 1] == (len({i % 50 for i in whole}), sum(whole))
    assert got["unknown", 1] == (len({i % 50 for i in whole if i % 7 == 0}), sum(i for i in whole if i % 7 == 0))


def test_null_keys_and_larger_numbers(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(LEAST_TASKS + 5))
    try:
        spread = dealt(rows(spark).withColumn("user_id", F.when(F.col("n") % 2 == 0, F.col("user_id"))), "user_id")
        assert spread.rdd.getNumPartitions() == LEAST_TASKS + 5 and spread.count() == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
