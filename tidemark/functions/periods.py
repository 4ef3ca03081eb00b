"""Reporting periods, durations and time zones. Everything works on zone-free timestamps,
so no result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency -> truncation unit, length, and the word used in "vs. prev. <word>".
PERIOD_UNIT = {"Quarterly": "quarter", "Monthly": "month", "Weekly": "week", "Daily": None}
PERIOD_STEP = {"Quarterly": "3 months", "Monthly": "1 month", "Weekly": "7 days", "Daily": "1 day"}
PERIOD_WORD = {"Quarterly": "Quarter", "Monthly": "Month", "Weekly": "Week", "Daily": "Day"}

LOCAL_ZONE = "CET"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_start(ts: Column | str, freq: str) -> Column:
    """First day (DATE) of the period a timestamp or date falls in; weeks start on Monday."""
    unit = PERIOD_UNIT[freq]
    day = F.to_date(_col(ts))
    return day if unit is None else F.trunc(day, unit)


def period_label(day: Column | str) -> Column:
    """Two-digit-year text label of a period. For display: order by the date, not by this."""
    return F.date_format(_col(day), "yy-MM-dd")


def seconds_between(start: Column, stop: Column) -> Column:
    """Exact ``stop - start`` in seconds as DECIMAL(24,6)."""
    return (stop - start).cast("interval second").cast("decimal(24,6)")


def whole_seconds(start: Column, stop: Column) -> Column:
    return seconds_between(start, stop).cast("bigint")


def whole_hours(start: Column, stop: Column) -> Column:
    """Hours between two timestamps, cut toward zero."""
    return (whole_seconds(start, stop) / 3600).cast("bigint")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def utc_to_local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts)


def local_to_utc(ts: Column) -> Column:
    return F.convert_timezone(F.lit(LOCAL_ZONE), F.lit("UTC"), ts)


def at_hour(day: Column, hour: int) -> Column:
    """A DATE at a full hour, as a zone-free timestamp."""
    zero = F.lit(0)
    return day.cast("timestamp_ntz") + F.make_dt_interval(zero, F.lit(hour), zero, F.lit(0).cast("decimal(18,6)"))
