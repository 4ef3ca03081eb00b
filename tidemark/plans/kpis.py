"""The four KPI frames: acquisition, conversion, transactions and due deposits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.functions.periods import PERIOD_STEP, period_start, whole_hours
from tidemark.operators.cube import cube_measures, cube_sums
from tidemark.operators.frames import (
    at_maximum,
    beyond_maximum,
    densified,
    first_per,
    numeric_columns,
    percent_change,
    running_balance,
)

REGIONS = ["country", "channel"]
SEGMENT = ["country", "service", "trxn_group", "trxn_type"]
# grouping sets that the views, cards and market figures read
VIEW_SETS = [(), ("service",), ("trxn_group",), ("trxn_type",), ("trxn_group", "trxn_type"), ("country",), ("country", "service")]
STEPS = ["signup", "verify", "reject", "activate"]


def acquisition_kpis(registrations: DataFrame, freq: str, densify: bool = False) -> DataFrame:
    """By signup period, step and region: users ``U``, mean acquisition cost ``A_CAC``, mean
    whole hours since signup ``A_TAT``, running users ``cum_U``, and percent changes. With ``densify``
    periods without users have a row from a segment's first period on (U = 0, no means)."""
    cost = F.col("customer_acquisition_cost")
    hours = whole_hours(F.col("signup_datetime"), F.col("trxn_datetime"))
    events = registrations.withColumns({"date": period_start("signup_datetime", freq), "__hours": hours})
    cubed = cube_sums(events, REGIONS, ["trxn_type", "date"], {
        "U": F.count("user_id"),
        "__cost": F.sum(cost), "__costs": F.count(cost),
        "__time": F.sum("__hours"), "__times": F.count("__hours"),
    })
    kpis = cubed.select(
        *REGIONS, "trxn_type", "date", "U",
        ratio(F.col("__cost"), F.col("__costs")).alias("A_CAC"),
        ratio(F.col("__time"), F.col("__times")).alias("A_TAT"),
    )
    segment = [*REGIONS, "trxn_type"]
    if densify:
        kpis = densified(kpis, segment, "date", PERIOD_STEP[freq], ["U"])
    kpis = running_balance(kpis, segment, ["date"], {"cum_U": "U"})
    return percent_change(kpis, segment, ["date"])


def conversion_rates(acquisition: DataFrame) -> DataFrame:
    """Users per step side by side, the rates between the steps, and percent changes."""
    wide = (
        acquisition.groupBy(*REGIONS, "date").pivot("trxn_type", STEPS).agg(F.first("U")).na.fill(0, STEPS)
    )
    rates = wide.withColumns({
        "CR_vs": ratio(F.col("verify"), F.col("signup")),
        "CR_av": ratio(F.col("activate"), F.col("verify")),
        "CR_as": ratio(F.col("activate"), F.col("signup")),
    })
    return percent_change(rates, REGIONS, ["date"])


def transaction_kpis(ledger: DataFrame, freq: str, sets: Sequence[Sequence[str]] | None = None, densify: bool = False) -> DataFrame:
    """By period and segment: distinct users, transactions, volumes, account and user moves,
    running deposits ``DUM``, active clients and accounts, deposit per client ``DUMpC``, and
    percent changes rounded to one place, for all grouping sets or the given ones. Takes an
    enriched ledger. With ``densify`` idle periods have a row from a segment's first period on:
    flows are 0, balances stay, and views of the last period hold idle segments too."""
    dated = ledger.withColumn("date", period_start("trxn_datetime", freq))
    measures = {
        "T": F.count("trxn_id"),
        "TPV": F.sum("tpv"),
        "ATPV": F.sum("atpv"),
        "AU": F.sum("user_status"),
        "AA": F.sum("account_status"),
        "U_ACTN": F.count_if(F.col("user_status") > 0),
        "U_DCTN": F.count_if(F.col("user_status") < 0),
        "A_ACTN": F.count_if(F.col("account_status") > 0),
        "A_DCTN": F.count_if(F.col("account_status") < 0),
    }
    kpis = cube_measures(dated, SEGMENT, ["date"], "user_id", "U", measures, sets).select(*SEGMENT, "date", "U", *measures)
    if densify:
        kpis = densified(kpis, SEGMENT, "date", PERIOD_STEP[freq], ["U", *measures])
    kpis = running_balance(kpis, SEGMENT, ["date"], {"DUM": "TPV", "ACTIVE_C": "AU", "ACTIVE_A": "AA"})
    kpis = kpis.withColumn("DUMpC", F.coalesce(ratio(F.col("DUM"), F.col("ACTIVE_C")), F.lit(0.0)))
    return percent_change(kpis, SEGMENT, ["date"], places=1)


def due_kpis(ledger: DataFrame, freq: str, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Deposits falling due, by due period ``mdate``: what was known of it at the last
    transaction period before (or after) the due period. Takes a ledger with groups."""
    dated = ledger.withColumns({
        "date": period_start("trxn_datetime", freq),
        "mdate": period_start("acc_maturity_datetime", freq),
    }).where(F.col("mdate").isNotNull())
    fixed = ["mdate", "date"]
    # transaction ids are unique, so they are counted like any sum
    measures = {"T": F.count("trxn_id"), "ATPV": F.sum("atpv")}
    kpis = cube_measures(dated, SEGMENT, fixed, "user_id", "U", measures, sets).select(*SEGMENT, *fixed, "U", *measures)
    kpis = running_balance(kpis, ["mdate", *SEGMENT], ["date"], {"DD": "ATPV"})
    kpis = first_per(kpis.where(F.col("mdate") != F.col("date")), ["mdate", *SEGMENT], ["date"], last=True)
    return percent_change(kpis, SEGMENT, ["mdate", "date"])


def latest_period(kpis: DataFrame) -> DataFrame:
    """Rows of the frame's last period. Segments idle in that period are not in it. The
    frame is read twice, so persist it when several views follow."""
    return at_maximum(kpis, "date")


def first_due(dues: DataFrame) -> DataFrame:
    """Per segment and transaction period, the nearest due period after the last period."""
    return first_per(beyond_maximum(dues, "mdate", "date"), [*SEGMENT, "date"], ["mdate"])


def change_columns(kpis: DataFrame) -> list[str]:
    return [c for c in numeric_columns(kpis) if c.startswith("pct_change_")]
