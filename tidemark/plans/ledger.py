"""From raw deposit tables to enriched ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import remap
from tidemark.operators.scan import id_block, ordered_scan

# Which transaction types bring money in or take it out, and which open or
# close an account.
TYPE_GROUP = {
    "open": "gain", "re-open": "gain", "cross-open": "gain", "renew": "gain", "top_up": "gain",
    "mature": "lose", "break": "lose", "withdraw": "lose",
}
OPENING_TYPES = ["open", "re-open", "cross-open"]
CLOSING_TYPES = ["break", "mature"]

LEDGER_ORDER = ["trxn_datetime", "trxn_id"]
CARRIED_FORWARD = ["country", "channel", "signup_datetime", "customer_acquisition_cost"]


def event_slices(time: str = "trxn_datetime", id_col: str = "trxn_id") -> list:
    """How a user's events are cut: days, then instants in blocks of ids."""
    return [F.to_date(time), F.struct(F.col(time).alias("at"), id_block(F.coalesce(id_col, F.lit(-1))).alias("block"))]


def add_groups(trxns: DataFrame) -> DataFrame:
    """``trxn_group``, ``atpv`` (a renewal counts with its balance) and ``account_status``
    (+1 opens an account, -1 closes one)."""
    kind = F.col("trxn_type")
    return trxns.withColumns({
        "trxn_group": remap(kind, TYPE_GROUP),
        "atpv": F.when(kind == "renew", F.col("balance")).otherwise(F.col("tpv")),
        "account_status": F.when(kind.isin(OPENING_TYPES), 1).when(kind.isin(CLOSING_TYPES), -1).otherwise(0),
    })


def enrich_ledger(trxns: DataFrame) -> DataFrame:
    """Adds to :func:`add_groups` the user's running number of open accounts
    (``account_count``) and ``user_status``: +1 when the first account opens, -1 when the
    last one closes. Events are ordered by time and transaction id."""
    counted = ordered_scan(
        add_groups(trxns), ["user_id"], LEDGER_ORDER, event_slices(),
        sums={"account_count": F.col("account_status")},
    )
    status, count = F.col("account_status"), F.col("account_count")
    return counted.withColumn(
        "user_status",
        F.when((count == 0) & (status == -1), -1).when((count == 1) & (status == 1), 1).otherwise(0),
    )


def activations(trxns: DataFrame) -> DataFrame:
    """First openings as registration events."""
    return trxns.where(F.col("trxn_type") == "open").select(
        "user_id", "trxn_id", "trxn_datetime", F.lit("activate").alias("trxn_type"))


def registration_events(rgsns: DataFrame, trxns: DataFrame) -> DataFrame:
    """Registration steps and activations of each user in time order; an activation takes
    country, channel, signup time and acquisition cost from the steps before it.

    Values are carried within a user only: someone who activates without ever having
    registered keeps nulls instead of inheriting another user's country."""
    events = rgsns.unionByName(activations(trxns), allowMissingColumns=True)
    # steps without a transaction id come first at the same instant
    order = ["trxn_datetime", "__id", "trxn_type"]
    events = events.withColumn("__id", F.coalesce("trxn_id", F.lit(-1)))
    filled = ordered_scan(
        events, ["user_id"], order, event_slices(),
        lasts={f"__{c}": F.col(c) for c in CARRIED_FORWARD},
    )
    return filled.withColumns({c: F.col(f"__{c}") for c in CARRIED_FORWARD}).drop(
        "__id", *[f"__{c}" for c in CARRIED_FORWARD])


def market_dim(lcns: DataFrame) -> DataFrame:
    """Countries with market size in millions and a size class.

    Classes follow the size in millions (over 20, 10, 5); comparing the raw head count with
    these limits would put every country in the top class."""
    size = F.col("population").cast("double") * 0.000001
    return lcns.select(
        "country",
        size.alias("market_size"),
        F.when(size > 20, "XBig").when(size > 10, "Big").when(size > 5, "Med").otherwise("Small").alias("country_category"),
    ).orderBy("country")


def apply_filters(
    ledger: DataFrame,
    registrations: DataFrame,
    countries: Sequence[str] | None = None,
    services: Sequence[str] | None = None,
    channels: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Optional selections; an empty one selects everything. Services restrict the ledger
    only and keep rows without a service."""
    if countries:
        ledger = ledger.where(F.col("country").isin(list(countries)))
        registrations = registrations.where(F.col("country").isin(list(countries)))
    if services:
        ledger = ledger.where(F.col("service").isin(list(services)) | F.col("service").isNull())
    if channels:
        ledger = ledger.where(F.col("channel").isin(list(channels)))
        registrations = registrations.where(F.col("channel").isin(list(channels)))
    return ledger, registrations
