"""Charging sessions: cleaning and per-session features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import ratio
from tidemark.functions.periods import at_hour, plus_seconds, seconds_between, utc_to_local, whole_seconds
from tidemark.plans.calendar import PEAK_END, PEAK_START, interval, open_day_counts
from tidemark.sources.readers import parse_session_time

# Variable groups of the analysis, short names and units.
RAW_VARS = ["ConnectedTime", "ChargeTime", "TotalEnergy", "MaxPower"]
ENGINEERED_VARS = ["PeakConnectedTime", "AvgChargePower", "Utilization", "Throughput", "PeakhourShare"]
LOG_VARS = ["ConnectedTimeLog1p", "ChargeTimeLog1p", "PeakConnectedTimeLog1p"]
ANALYSIS_VARS = [
    "ConnectedTime", "ChargeTime", "PeakConnectedTime", "TotalEnergy", "MaxPower",
    "AvgChargePower", "Utilization", "Throughput", "PeakhourShare",
]
SHORT_NAMES = {
    "ConnectedTime": "CntdTm", "ChargeTime": "ChrgTm", "PeakConnectedTime": "PkCnTm",
    "TotalEnergy": "TotEgy", "MaxPower": "MaxPwr", "AvgChargePower": "ACgPwr",
    "Utilization": "Utilzn", "Throughput": "Thrput", "PeakhourShare": "PkhShr",
    "ConnectedTimeLog1p": "CndTLg", "ChargeTimeLog1p": "ChgTLg", "PeakConnectedTimeLog1p": "PCnTLg",
}
UNITS = {
    "ConnectedTime": "h", "ChargeTime": "h", "PeakConnectedTime": "h", "TotalEnergy": "kWh",
    "MaxPower": "kW", "AvgChargePower": "kW", "Utilization": "%", "Throughput": "kW",
    "PeakhourShare": "%", "ConnectedTimeLog1p": "L(1+h)", "ChargeTimeLog1p": "L(1+h)",
    "PeakConnectedTimeLog1p": "L(1+h)", "SegmentShare": "%", "EnergyShare": "%",
}

SECONDS_PER_HOUR = 3600.0
PEAK_SECONDS = (PEAK_END - PEAK_START) * 3600


def _time(df: DataFrame, c: str) -> Column:
    text = isinstance(df.schema[c].dataType, T.StringType)
    return parse_session_time(F.col(c)) if text else F.col(c)


def clean_sessions(df: DataFrame) -> DataFrame:
    """Parsed times with local copies, the end of charging, and recomputed durations.

    Charging is taken to start with the session and to last ``ChargeTime`` hours (whole
    seconds), at most until the session ends. Durations are whole seconds in hours."""
    start, stop = "UTCTransactionStart", "UTCTransactionStop"
    parsed = df.withColumns({start: _time(df, start), stop: _time(df, stop)})
    charged = plus_seconds(F.col(start), F.floor(F.col("ChargeTime") * SECONDS_PER_HOUR))
    parsed = parsed.withColumn(
        "UTCChargeStop", F.when(charged.isNotNull(), F.least(charged, F.col(stop))))
    return parsed.withColumns({
        "CETTransactionStart": utc_to_local(F.col(start)),
        "CETTransactionStop": utc_to_local(F.col(stop)),
        "CETChargeStop": utc_to_local(F.col("UTCChargeStop")),
        "ConnectedTimeRC": whole_seconds(F.col(start), F.col(stop)) / F.lit(SECONDS_PER_HOUR),
        "ChargeTimeRC": whole_seconds(F.col(start), F.col("UTCChargeStop")) / F.lit(SECONDS_PER_HOUR),
    })


def peak_connected_hours(sessions: DataFrame, holidays: DataFrame) -> DataFrame:
    """Adds ``PeakConnectedTime``: hours of the session inside peak time.

    Peak seconds between two instants are the difference of the peak seconds elapsed up to
    each of them: 16 hours for every business day before the instant's day, plus the part
    of its own day. Two lookups in a small calendar per session, whatever its length."""
    calendar = open_day_counts(interval(sessions), holidays)
    out = sessions
    for side in ("Start", "Stop"):
        at = calendar.withColumnsRenamed({"day": f"__day{side}", "open": f"__open{side}", "opened": f"__opened{side}"})
        out = out.withColumn(f"__day{side}", F.to_date(f"CETTransaction{side}")).join(at, f"__day{side}", "left")

    def elapsed(side: str) -> Column:
        opening = at_hour(F.col(f"__day{side}"), PEAK_START)
        today = seconds_between(opening, F.col(f"CETTransaction{side}"))
        today = F.least(F.greatest(today, F.lit(0).cast("decimal(24,6)")), F.lit(PEAK_SECONDS).cast("decimal(24,6)"))
        return F.col(f"__opened{side}") * PEAK_SECONDS + F.when(F.col(f"__open{side}"), today).otherwise(0)

    hours = (elapsed("Stop") - elapsed("Start")).cast("double") / SECONDS_PER_HOUR
    return out.withColumn("PeakConnectedTime", hours).drop(
        *[f"__{n}{s}" for n in ("day", "open", "opened") for s in ("Start", "Stop")])


def session_features(sessions: DataFrame) -> DataFrame:
    """Rates, shares and log-scaled durations; a zero duration gives NULL rates."""
    connected, charging, peak = F.col("ConnectedTimeRC"), F.col("ChargeTimeRC"), F.col("PeakConnectedTime")
    energy = F.col("TotalEnergy")
    return sessions.withColumns({
        "Throughput": ratio(energy, connected),
        "Utilization": ratio(charging, connected) * 100,
        "PeakhourShare": ratio(peak, connected) * 100,
        "AvgChargePower": ratio(energy, charging),
        "ConnectedTimeLog1p": F.log1p(connected),
        "ChargeTimeLog1p": F.log1p(charging),
        "PeakConnectedTimeLog1p": F.log1p(peak),
    })


def prepare(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Raw sessions to sessions with all features."""
    return session_features(peak_connected_hours(clean_sessions(df), holidays))
