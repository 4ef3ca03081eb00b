"""Headline figures: value and change of one KPI as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import short_number, signed_short_number
from tidemark.functions.periods import PERIOD_WORD
from tidemark.operators.cube import ALL
from tidemark.plans.kpis import first_due, latest_period
from tidemark.plans.views import level

# Title, frame, transaction group and type of the row, measure, unit, and
# whether a rise is good ("normal") or bad ("inverse"). All are taken over all countries.
CATALOGUE = [
    ("Deposits under Management", "trxns", "all", "all", "DUM", "€", "normal"),
    ("Account Activation", "trxns", "all", "all", "A_ACTN", "#", "normal"),
    ("Due Deposits", "dues", "all", "all", "DD", "€", "inverse"),
    ("Account Deactivation", "trxns", "all", "all", "A_DCTN", "#", "inverse"),
    ("New Signups", "acqs", "all", "signup", "U", "#", "normal"),
    ("avg. Customer Acq. Cost", "acqs", "all", "signup", "A_CAC", "€", "inverse"),
    ("New Verified Signups", "acqs", "all", "verify", "U", "#", "normal"),
    ("avg. Turn Around Time", "acqs", "all", "verify", "A_TAT", "Hours", "inverse"),
    ("Conversion Rate", "rates", "all", "all", "CR_as", "%", "normal"),
    ("New Clients", "acqs", "all", "activate", "U", "#", "normal"),
    ("Active Clients", "trxns", "all", "all", "ACTIVE_C", "#", "normal"),
    ("Churned Clients", "trxns", "lose", "all", "U_DCTN", "#", "inverse"),
    ("Retained Clients", "trxns", "all", "renew", "U", "#", "normal"),
    ("Active Accounts", "trxns", "all", "all", "ACTIVE_A", "#", "normal"),
    ("Closed Accounts", "trxns", "lose", "all", "A_DCTN", "#", "inverse"),
    ("Renewed Accounts", "trxns", "all", "renew", "T", "#", "normal"),
    ("Net Deposits", "trxns", "all", "all", "DUM", "€", "normal"),
    ("Lost Deposits", "trxns", "lose", "all", "-TPV", "€", "inverse"),
    ("Renewed Deposits", "trxns", "all", "renew", "ATPV", "€", "normal"),
]
_FIELDS = "kpi STRING, frame STRING, trxn_group STRING, trxn_type STRING, measure STRING, unit STRING, delta STRING"


def catalogue(spark: SparkSession) -> DataFrame:
    fields = [f.split()[0] for f in _FIELDS.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in CATALOGUE])
    return spark.range(1).select(F.inline(rows))


def _measures(rows: DataFrame, frame: str, group, kind) -> DataFrame:
    """The catalogue's measures of a frame in long form, with their percent change."""
    names = sorted({m for _, f, _, _, m, _, _ in CATALOGUE if f == frame})
    triples = F.array(*[
        F.struct(
            F.lit(m).alias("measure"),
            ((-1 if m[0] == "-" else 1) * F.col(m.lstrip("-")).cast("double")).alias("value"),
            F.col(f"pct_change_{m.lstrip('-')}").cast("double").alias("change"),
        )
        for m in names
    ])
    return rows.select(F.lit(frame).alias("frame"), group.alias("trxn_group"), kind.alias("trxn_type"), F.inline(triples))


def kpi_cards(
    trxns: DataFrame, dues: DataFrame, acqs: DataFrame, rates: DataFrame, freq: str
) -> DataFrame:
    """One row per catalogue entry: title, value text, change text and delta kind.

    Due deposits take the nearest coming due period. An entry without a row in its frame
    reads "No Record"; one without a previous value reads "No prev. stat"."""
    all_, group, kind = F.lit(ALL), F.col("trxn_group"), F.col("trxn_type")
    everywhere = level(country=ALL, service=ALL)
    due = first_due(dues).where(level(country=ALL, service=ALL, trxn_group=ALL, trxn_type=ALL))
    nearest = due.groupBy("trxn_group", "trxn_type").agg(
        F.min_by(F.struct("DD", "pct_change_DD"), F.struct("mdate", -F.datediff("date", F.lit("1970-01-01")))).alias("r")
    ).select("trxn_group", "trxn_type", "r.*")
    facts = (
        _measures(latest_period(trxns).where(everywhere), "trxns", group, kind)
        .unionByName(_measures(nearest, "dues", all_, all_))
        .unionByName(_measures(latest_period(acqs).where(level(country=ALL, channel=ALL)), "acqs", all_, kind))
        .unionByName(_measures(latest_period(rates).where(level(country=ALL, channel=ALL)), "rates", all_, all_))
    )
    cards = catalogue(trxns.sparkSession).join(facts, ["frame", "trxn_group", "trxn_type", "measure"], "left")
    unit, value, change = F.col("unit"), F.col("value"), F.col("change")
    shown = short_number(F.when(unit == "%", value * 100).otherwise(value), whole=unit == "#")
    trend = F.concat(signed_short_number(change), F.lit(f" % vs. prev. {PERIOD_WORD[freq]}"))
    missing = value.isNull()
    return cards.select(
        F.concat(F.lit(f"{freq} "), "kpi").alias("title"),
        "value",
        "change",
        F.when(missing, F.concat(F.lit("0 "), unit)).otherwise(F.concat(shown, unit)).alias("shown"),
        F.when(change.isNull(), "No prev. stat").otherwise(trend).alias("trend"),
        F.when(missing | change.isNotNull(), F.col("delta")).otherwise("off").alias("delta"),
        F.when(missing, "No Record").otherwise("ok").alias("status"),
    )
