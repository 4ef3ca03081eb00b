"""The ledger's join is dealt on both sides, also where the session's number of shuffle partitions is small."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from tidemark.session import LEAST_TASKS
from tidemark.sources import star_schema as star

START = dt.datetime(2024, 1, 1)
# an order without a customer, and one of a customer who is not known
ORDERS = [(i, None if i == 77 else 99 if i == 78 else i % 18, "O", 100.0 + i, START + dt.timedelta(days=3 * i), "1-URGENT") for i in range(120)]


@pytest.fixture
def folder(spark, tmp_path):
    made = {
        "nation": ([(i, f"NATION_{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"c{i}", i % 3, 10.0 * i, "M") for i in range(20)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (ORDERS, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def spelled_out(df):
    return df._jdf.queryExecution().executedPlan().toString().count(f", {LEAST_TASKS}), REPARTITION_BY_NUM")


def test_ledger_join_is_spread(spark, folder):
    ledger = star.ledger(spark, folder)
    assert spelled_out(ledger) == 2
    assert sorted((r.trxn_id, r.user_id) for r in ledger.collect()) == [
        (i, i % 18) for i in range(120) if i not in (77, 78) and i % 18 % 10 < 7]


# for each ledger two sides, and a cube; the ledger is read for months and for quarters in a3_sketch_error
@pytest.mark.parametrize("name, steps", [("c8_due_kpis", 3), ("a3_sketch_error", 6)])
def test_queries_are_spread(spark, folder, name, steps):
    assert spelled_out(entry.queries()[name](spark, folder)) == steps
