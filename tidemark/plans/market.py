"""Market expansion: how far each country and service has been won."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.cube import ALL
from tidemark.operators.frames import first_per, flag_extremes, prefixed
from tidemark.plans.views import level

THOUSANDTH, MILLIONTH = 0.001, 0.000001

# Column -> title, and the unit scale of the displayed number.
TITLES = {
    "country": ("Country", None),
    "market_size": ("Market Size", None),
    "client_base": ("Client Base", THOUSANDTH),
    "active_clients": ("Active Clients", THOUSANDTH),
    "DUM": ("Deposits under Management", MILLIONTH),
    "DUMpC": ("Deposit per Client", THOUSANDTH),
    "penetration_rate": ("Penetration Rate", None),
    "A_CAC": ("Avg. Customer Acq. Cost", None),
}


def client_base(acquisition: DataFrame) -> DataFrame:
    """Verified users so far and mean acquisition cost over all periods, by country."""
    rows = acquisition.where(level(country=True, channel=ALL, trxn_type="verify"))
    return rows.groupBy("country").agg(
        F.max_by("cum_U", "date").alias("client_base"), F.avg("A_CAC").alias("A_CAC"))


def _last_balances(kpis: DataFrame, keys: list[str], clients: str, **wanted) -> DataFrame:
    rows = kpis.where(level(**wanted, trxn_group=ALL, trxn_type=ALL))
    last = first_per(rows.select("country", "service", "date", "DUM", clients, "DUMpC"), keys, ["date"], last=True)
    return last.drop("date").withColumnRenamed(clients, "active_clients")


def _per_thousand(part, whole):
    return ratio(part.cast("double") * THOUSANDTH, whole) * 100


def market_penetration(market: DataFrame, kpis: DataFrame, acquisition: DataFrame) -> DataFrame:
    """Per country: market size, clients, balances and ``penetration_rate`` (thousands of
    verified users per hundred millions of market). Countries with a gap are left out."""
    balances = _last_balances(kpis, ["country"], "ACTIVE_C", country=True, service=ALL)
    joined = market.join(balances, "country", "left").join(client_base(acquisition), "country", "left")
    rate = _per_thousand(F.col("client_base"), F.col("market_size"))
    return joined.withColumn("penetration_rate", rate).na.drop("any")


def penetration_report(penetration: DataFrame) -> DataFrame:
    """Titles, display units, and the best and worst country per column."""
    shown = penetration.select(*[
        (F.col(c) if scale is None else F.col(c).cast("double") * scale).alias(title)
        for c, (title, scale) in TITLES.items()
    ])
    return flag_extremes(shown, [title for title, _ in TITLES.values() if title != "Country"])


def service_penetration(market: DataFrame, kpis: DataFrame, acquisition: DataFrame) -> DataFrame:
    """:func:`market_penetration` by country and service, on active accounts; ``AC_CB`` is
    accounts per thousand verified users in percent."""
    balances = _last_balances(kpis, ["country", "service"], "ACTIVE_A", country=True, service=True)
    joined = market.join(balances, "country", "left").join(client_base(acquisition), "country", "left")
    active = F.col("active_clients")
    return joined.withColumns({
        "penetration_rate": _per_thousand(active, F.col("market_size")),
        "AC_CB": _per_thousand(active, F.col("client_base")),
    }).na.drop("any")


def cross_sell_pairs(by_service: DataFrame, kpis: DataFrame) -> DataFrame:
    """Every two services of a country side by side, with the country's deposit per client.

    One self-join on the country, the service order kept as part of the condition; a
    country has as many rows as services, and a single service gives no pair."""
    first, second = prefixed(by_service, "S1_"), prefixed(by_service, "S2_")
    pairs = first.join(
        second, (F.col("S1_country") == F.col("S2_country")) & (F.col("S1_service") < F.col("S2_service")))
    per_client = _last_balances(kpis, ["country"], "ACTIVE_C", country=True, service=ALL)
    return pairs.withColumns({
        "S1": F.col("S1_service"),
        "S2": F.col("S2_service"),
        "product_set": F.concat(F.lit("S1("), "S1_service", F.lit(") vs. S2("), "S2_service", F.lit(")")),
    }).join(per_client.select(F.col("country").alias("S1_country"), "DUMpC"), "S1_country").drop("S2_country")
