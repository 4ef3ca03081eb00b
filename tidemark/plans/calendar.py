"""Business days and peak hours. Peak time is 07:00 to 23:00 local time on weekdays that
are not public holidays. Holidays are an input table with one DATE per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.periods import at_hour, local_to_utc

PEAK_START, PEAK_END = 7, 23


def interval(sessions: DataFrame) -> DataFrame:
    """One row: earliest and latest instant over both ends of all sessions."""
    start, stop = "UTCTransactionStart", "UTCTransactionStop"
    return sessions.agg(
        F.least(F.min(start), F.min(stop)).alias("start"), F.greatest(F.max(start), F.max(stop)).alias("stop"))


def days(span: DataFrame, holidays: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """One row per calendar day of the span (a one-row frame with start and stop), with
    ``open`` = business day."""
    first, last = F.date_sub(F.to_date("start"), before), F.date_add(F.to_date("stop"), after)
    every = span.select(F.explode(F.sequence(first, last)).alias("day"))
    closed = holidays.select(F.col("date").alias("day")).distinct().withColumn("holiday", F.lit(True))
    weekday = F.weekday("day") < 5
    return every.join(closed, "day", "left").select("day", (weekday & F.col("holiday").isNull()).alias("open"))


def business_days(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Business days from the first one on or after the span's start date to the first one
    on or after its end date (so the last may lie after the span)."""
    # n holidays can close at most n weekdays after the end, beside weekends
    bounded = span.select("start", "stop", holidays.agg((2 * F.count(F.lit(1)) + 7).cast("int")).scalar().alias("slack"))
    reach = bounded.select("start", F.date_add(F.to_date("stop"), F.col("slack")).cast("timestamp_ntz").alias("stop"))
    opened = days(reach, holidays).where("open").select("day")
    end = span.select(F.to_date("stop")).scalar()
    last = opened.where(F.col("day") >= end).agg(F.min("day")).scalar()
    return opened.where(F.col("day") <= last)


def peak_calendar(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Switch points of peak time in UTC: ``Peakhour`` 1 at the daily opening, 0 at closing."""
    switches = F.array(*[
        F.struct(local_to_utc(at_hour(F.col("day"), h)).alias("UTCDatetime"), F.lit(v).alias("Peakhour"))
        for h, v in ((PEAK_START, 1), (PEAK_END, 0))
    ])
    return business_days(span, holidays).select(F.inline(switches))


def open_day_counts(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Per calendar day of the span: ``open``, and ``opened`` = business days before it.

    One row per day between two timestamps, a few hundred per year, so it fits any
    broadcast and its single ordered pass is short."""
    # a day more on either side, since local days are shifted against UTC days
    calendar = days(span, holidays, before=1, after=1)
    earlier = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return calendar.withColumn("opened", F.coalesce(F.sum(F.col("open").cast("int")).over(earlier), F.lit(0)))


def next_opening(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Per calendar day of the span, the opening time (local) of the first business day on
    or after it."""
    slack = holidays.agg((2 * F.count(F.lit(1)) + 7).cast("int")).scalar()
    reach = span.select("start", F.date_add(F.to_date("stop"), slack).cast("timestamp_ntz").alias("stop"))
    later = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    opening = F.min(F.when(F.col("open"), at_hour(F.col("day"), PEAK_START))).over(later)
    wanted = span.select(F.to_date("stop")).scalar()
    return days(reach, holidays).withColumn("opening", opening).where(F.col("day") <= wanted).select("day", "opening")
