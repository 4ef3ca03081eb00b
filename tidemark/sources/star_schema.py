"""The library's input tables derived from an order/customer/event star schema.

Used where no ledger, registration or session files are at hand: orders become ledger
rows, customers become registrations, events become charging sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import plus_seconds
from tidemark.session import dealt

DAY, HOUR, MINUTE = 86400, 3600, 60

# Weekday public holidays that fall in the events' time span.
HOLIDAY_DATES = ["2024-01-01", "2024-03-29", "2024-04-01"]

# Declared, so that no file footer is read before a query runs.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        table(spark, folder, "customer")
        .select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_acctbal")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .drop("c_nationkey", "n_nationkey")
    )


def _first_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders; reduced before the shuffle."""
    first = F.min(F.struct("o_orderdate", "o_orderkey"))
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(first.alias("first"))
        .select("user_id", F.col("first.o_orderdate").alias("first_date"), F.col("first.o_orderkey").alias("first_id"))
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    clients = (
        _customers(spark, folder)
        .where(F.col("user_id") % 10 < 7)
        .select("user_id", "country", F.concat(F.lit("ch"), (F.col("user_id") % 4).cast("string")).alias("channel"))
        .join(_first_orders(spark, folder).select("user_id", "first_id"), "user_id")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("trxn_id"),
        F.col("o_orderdate").alias("trxn_datetime"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("balance"),
    )
    key = F.col("trxn_id")
    kinds = F.array(*[F.lit(x) for x in [
        "cross-open", "re-open", "cross-open", "renew", "top_up", "mature", "break", "withdraw"]])
    services = F.array(F.lit("Fixed"), F.lit("Flexible"), F.lit("Locked"))
    # both sides: where only one is dealt, the join takes the number of the other, which can be one part a core
    typed = dealt(orders, "user_id").join(dealt(clients, "user_id"), "user_id").select(
        "user_id", "trxn_id", "trxn_datetime", "country", "channel", "balance",
        F.when(key == F.col("first_id"), "open").otherwise(F.get(kinds, (key % 8).cast("int"))).alias("trxn_type"),
        F.get(services, (key % 3).cast("int")).alias("service"),
        plus_seconds(F.col("trxn_datetime"), (30 + key % 360) * DAY).alias("acc_maturity_datetime"),
    )
    tpv = (
        F.when(F.col("trxn_type") == "renew", F.lit(0).cast("decimal(18,2)"))
        .when(F.col("trxn_type").isin("mature", "break", "withdraw"), (-F.col("balance")).cast("decimal(18,2)"))
        .otherwise(F.col("balance"))
    )
    return typed.withColumn("tpv", tpv)


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("user_id")
    people = (
        _customers(spark, folder)
        .join(_first_orders(spark, folder).select("user_id", "first_date"), "user_id", "left")
        .select(
            "user_id",
            plus_seconds(
                F.coalesce("first_date", F.lit("1996-01-01").cast("timestamp_ntz")), -(2 + k % 30) * DAY
            ).alias("signup_datetime"),
            "country",
            F.concat(F.lit("ch"), (k % 4).cast("string")).alias("channel"),
            (F.abs(F.col("c_acctbal").cast("decimal(18,2)")) / 100).cast("decimal(18,4)").alias("customer_acquisition_cost"),
        )
    )
    checked = plus_seconds(F.col("signup_datetime"), (1 + k % 40) * HOUR)
    steps = F.array(
        F.struct(F.lit("signup").alias("trxn_type"), F.col("signup_datetime").alias("trxn_datetime")),
        F.struct(F.when(k % 10 == 9, "reject").otherwise("verify").alias("trxn_type"), checked.alias("trxn_datetime")),
    )
    return people.withColumn("step", F.explode(steps)).select(
        "user_id", "step.trxn_datetime", "signup_datetime", "step.trxn_type",
        "country", "channel", "customer_acquisition_cost",
    )


def market(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("country"),
        (F.lit(1000000) * (1 + F.col("n_nationkey").cast("bigint"))).alias("population"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    k, hours = F.col("event_id"), F.lit(0.5).cast("double") * (1 + F.col("event_id") % 24)
    return table(spark, folder, "events").select(
        k.alias("TransactionId"),
        F.col("ts").alias("UTCTransactionStart"),
        plus_seconds(F.col("ts"), (1 + k % 24) * 30 * MINUTE).alias("UTCTransactionStop"),
        hours.alias("ConnectedTime"),
        (hours * (1 + k % 5) / F.lit(4.0).cast("double")).alias("ChargeTime"),
        F.col("value").alias("TotalEnergy"),
        (F.col("value") / hours).alias("MaxPower"),
    )


def holidays(spark: SparkSession) -> DataFrame:
    dates = F.array(*[F.lit(d).cast("date") for d in HOLIDAY_DATES])
    return spark.range(1).select(F.explode(dates).alias("date"))
