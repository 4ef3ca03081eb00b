"""Power drawn by the whole network over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.functions.periods import period_start, utc_to_local
from tidemark.operators.frames import share_within
from tidemark.operators.scan import id_block, ordered_scan
from tidemark.plans.calendar import peak_calendar

BUCKET = "5 minutes"
BUCKET_MINUTES = 5
HOURS_PER_BUCKET = BUCKET_MINUTES / 60
WATTS = 1000
# Fixed point, so that the running total does not depend on how the data was split.
POWER = "decimal(20,6)"
EXACT = "decimal(38,6)"

CURVE = ["AvgChargePower_Mean", "AvgChargePower_Max", "AvgChargePower_Min", "AvgChargeVolume"]


def power_changes(sessions: DataFrame) -> DataFrame:
    """Each session as two changes in watts: up when it starts, down when charging stops."""
    ends = sessions.unpivot(
        ["TransactionId", "AvgChargePower"], ["UTCTransactionStart", "UTCChargeStop"], "Point", "UTCDatetime")
    up = F.col("Point") == "UTCTransactionStart"
    signed = F.col("AvgChargePower") * WATTS * F.when(up, 1).otherwise(-1)
    return ends.select(
        "UTCDatetime",
        signed.cast(POWER).alias("AvgChargePowerChange"),
        F.when(up, 0).otherwise(1).alias("Point"),  # starts come before stops of the same instant
        "TransactionId",
    )


CHANGE_ORDER = ["UTCDatetime", "Point", "TransactionId"]


def running_power(changes: DataFrame) -> DataFrame:
    """The network's power after every single change, in watts. Cut by days and hours, then
    by instants and id blocks."""
    at = F.col("UTCDatetime")
    piece = F.struct(at.alias("at"), F.col("Point").alias("point"), id_block(F.col("TransactionId")).alias("block"))
    return ordered_scan(
        changes, [], CHANGE_ORDER, [F.to_date(at), F.hour(at), piece], sums={"AvgChargePower": F.col("AvgChargePowerChange")})


def bucket_power(changes: DataFrame) -> DataFrame:
    """Mean, maximum and minimum of the running power over the changes of each 5 minutes.

    Every bucket is summarised on its own: number of changes, their total, and sum, maximum
    and minimum of the running total inside. The level a bucket starts from is the total of
    all earlier buckets, which shifts those figures. Buckets themselves are summarised the
    same way from smaller pieces: seconds, then id blocks of one instant. So rows are
    shuffled once and only summaries are put in order."""
    at = F.col("UTCDatetime")
    levels = ["bucket", "second", "piece"]
    rows = changes.where(at.isNotNull()).withColumns({
        "bucket": F.window(at, BUCKET)["start"], "second": F.minute(at) * 60 + F.second(at),
        "piece": F.struct(at.alias("at"), F.col("Point").alias("point"), id_block(F.col("TransactionId")).alias("block"))})
    inside = Window.partitionBy(*levels).orderBy(*CHANGE_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.coalesce("AvgChargePowerChange", F.lit(0).cast(POWER))
    level = F.sum(change).over(inside).cast(EXACT)
    pieces = rows.withColumns({"change": change, "level": level}).groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum("change").cast(EXACT).alias("total"),
        F.sum("level").cast(EXACT).alias("area"), F.max("level").alias("high"), F.min("level").alias("low"))
    while len(levels) > 1:
        *parent, last = levels
        earlier = Window.partitionBy(*parent).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
        pieces = _lifted(pieces, F.sum("total").over(earlier)).groupBy(*parent).agg(
            F.sum("n").alias("n"), F.sum("total").cast(EXACT).alias("total"),
            F.sum("area").cast(EXACT).alias("area"), F.max("high").alias("high"), F.min("low").alias("low"))
        levels = parent
    base = ordered_scan(pieces, [], ["bucket"], [F.to_date("bucket")], sums={"upto": F.col("total")})
    curve = _lifted(base, F.col("upto") - F.col("total"))
    mean = ratio(F.col("area"), F.col("n"))
    return curve.select(
        F.col("bucket").alias("UTCDatetime"),
        mean.alias("AvgChargePower_Mean"),
        F.col("high").cast("double").alias("AvgChargePower_Max"),
        F.col("low").cast("double").alias("AvgChargePower_Min"),
        (mean * HOURS_PER_BUCKET).alias("AvgChargeVolume"),
    )


def _lifted(pieces: DataFrame, offset) -> DataFrame:
    """Summaries shifted by the level their piece starts from."""
    shifted = pieces.withColumn("__by", F.coalesce(offset.cast(EXACT), F.lit(0).cast(EXACT)))
    return shifted.withColumns({
        "area": (F.col("area") + F.col("__by") * F.col("n")).cast(EXACT),
        "high": (F.col("high") + F.col("__by")).cast(EXACT),
        "low": (F.col("low") + F.col("__by")).cast(EXACT),
    }).drop("__by")


def regular_grid(points: DataFrame, column: str = "UTCDatetime") -> DataFrame:
    """Every 5 minutes from the first to the last point: whole days first, so that the grid
    of a long interval is made by many tasks."""
    span = points.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    step = F.expr(f"interval {BUCKET}")
    day = F.col("day").cast("timestamp_ntz")
    by_day = span.withColumn("day", F.explode(F.sequence(F.to_date("first"), F.to_date("last")))).repartition("day")
    offset = F.col("first") - F.to_date("first").cast("timestamp_ntz")
    first_bucket = day + offset  # the grid runs through the first point
    stamps = F.sequence(first_bucket - F.expr("interval 1 day"), first_bucket + F.expr("interval 1 day"), step)
    return (
        by_day.select("first", "last", "day", F.explode(stamps).alias(column))
        .where((F.to_date(column) == F.col("day")) & F.col(column).between(F.col("first"), F.col("last")))
        .select(column)
    )


def fill_grid(points: DataFrame, columns: Sequence[str], column: str = "UTCDatetime") -> DataFrame:
    """Points on the regular grid, every column carried forward over the gaps."""
    on_grid = regular_grid(points, column).join(points, column, "left")
    filled = ordered_scan(
        on_grid, [], [column], [F.to_date(column)], lasts={f"__{c}": F.col(c) for c in columns})
    return filled.select(column, *[F.col(f"__{c}").alias(c) for c in columns])


def power_curve(changes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Power every 5 minutes with a peak-time flag and local time. Empty buckets repeat the
    figures of the last bucket with changes; the curve reaches to the last switch point of
    the calendar."""
    points = bucket_power(changes).join(calendar, "UTCDatetime", "full")
    filled = fill_grid(points, [*CURVE, "Peakhour"])
    return filled.withColumns({
        "Peakhour": F.coalesce("Peakhour", F.lit(0)),
        "CETDatetime": utc_to_local(F.col("UTCDatetime")),
    })


def level_points(changes: DataFrame) -> DataFrame:
    """Of every 5 minutes with changes: the level they begin with (``base``) and end with (``Level``), the
    power beyond the base times seconds (``area``), and the levels held (``high``, ``low``).

    A change counts from its instant to the end of the bucket, so areas are sums in any order. Changes of one
    instant are one step, as levels between them hold for no time. Levels are put in order inside a second, then
    seconds inside a bucket, then buckets by days."""
    at = F.col("UTCDatetime")
    steps = changes.where(at.isNotNull()).groupBy("UTCDatetime").agg(F.sum("AvgChargePowerChange").cast(POWER).alias("step"))
    bucket = F.window(at, BUCKET)
    left = (F.timestamp_diff("MICROSECOND", at, F.col("bucket_end")) / F.lit(1_000_000)).cast("decimal(9,6)")
    rows = steps.na.fill(0, ["step"]).withColumns({"bucket": bucket["start"], "bucket_end": bucket["end"]}).withColumns({
        "second": F.minute(at) * 60 + F.second(at), "area": F.col("step") * left})
    inside = Window.partitionBy("bucket", "second").orderBy("UTCDatetime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = rows.withColumn("level", F.sum("step").over(inside).cast(EXACT)).groupBy("bucket", "second").agg(
        F.sum("step").cast(EXACT).alias("total"), F.sum("area").alias("area"),
        F.max("level").alias("high"), F.min("level").alias("low"), F.min("UTCDatetime").alias("first"))
    earlier = Window.partitionBy("bucket").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("total").over(earlier).cast(EXACT), F.lit(0).cast(EXACT))
    buckets = seconds.withColumn("before", before).groupBy("bucket").agg(
        F.sum("total").cast(EXACT).alias("total"), F.sum("area").cast("double").alias("area"),
        F.max(F.col("high") + F.col("before")).cast(EXACT).alias("high"), F.min(F.col("low") + F.col("before")).cast(EXACT).alias("low"), F.min("first").alias("first"))
    based = ordered_scan(buckets, [], ["bucket"], [F.to_date("bucket")], sums={"Level": F.col("total")})
    base = (F.col("Level") - F.col("total")).cast(EXACT)
    # the level from before is held in a bucket unless its very first instant changes it
    held = F.when(F.col("first") > F.col("bucket"), base)
    return based.select(
        F.col("bucket").alias("UTCDatetime"), base.cast("double").alias("base"), F.col("Level").cast("double").alias("Level"), "area",
        F.greatest(held, base + F.col("high")).cast("double").alias("high"), F.least(held, base + F.col("low")).cast("double").alias("low"))


def level_curve(changes: DataFrame, calendar: DataFrame) -> DataFrame:
    """The power curve with every level weighted by how long it holds.

    Columns as of :func:`power_curve`, and ``Level`` at the end of the 5 minutes. Buckets without changes have the
    level of the bucket before, not its mean, maximum or volume; the volumes of all buckets add up to the energy of all sessions."""
    points = level_points(changes).join(calendar, "UTCDatetime", "full")
    on_grid = regular_grid(points).join(points, "UTCDatetime", "left")
    filled = ordered_scan(
        on_grid, [], ["UTCDatetime"], [F.to_date("UTCDatetime")],
        lasts={"__level": F.col("Level"), "__peak": F.col("Peakhour")})
    start = F.coalesce("base", "__level", F.lit(0.0))
    mean = start + F.coalesce("area", F.lit(0.0)) / (60 * BUCKET_MINUTES)
    return filled.select(
        "UTCDatetime", mean.alias("AvgChargePower_Mean"), F.coalesce("high", start).alias("AvgChargePower_Max"), F.coalesce("low", start).alias("AvgChargePower_Min"),
        (mean * HOURS_PER_BUCKET).alias("AvgChargeVolume"), F.coalesce("__level", F.lit(0.0)).alias("Level"),
        F.coalesce("__peak", F.lit(0)).alias("Peakhour"), utc_to_local(F.col("UTCDatetime")).alias("CETDatetime"))


def session_level_curve(sessions: DataFrame, span: DataFrame, holidays: DataFrame) -> DataFrame:
    return level_curve(power_changes(sessions), peak_calendar(span, holidays))


def session_power_curve(sessions: DataFrame, span: DataFrame, holidays: DataFrame) -> DataFrame:
    return power_curve(power_changes(sessions), peak_calendar(span, holidays))


def period_power(curve: DataFrame, freq: str) -> DataFrame:
    """The curve by local period and peak flag, with each part's share of the period's volume."""
    parts = curve.groupBy(period_start("CETDatetime", freq).alias("Period"), "Peakhour").agg(
        F.avg("AvgChargePower_Mean").alias("AvgChargePower_Mean"),
        F.max("AvgChargePower_Max").alias("AvgChargePower_Max"),
        F.min("AvgChargePower_Min").alias("AvgChargePower_Min"),
        F.sum("AvgChargeVolume").alias("AvgChargeVolume"),
    )
    shared = share_within(parts, ["Period"], "AvgChargeVolume", "PeakhoursShare")
    return shared.withColumn("Peakhour", F.col("Peakhour").cast("string"))
