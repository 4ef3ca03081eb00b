"""Balances per segment kept up to date from files as they arrive.

A streaming aggregation keeps one total per (segment, period) in the state store; every trigger that sees new
files hands on the totals that changed. They are written below ``table`` in a folder of the trigger's
number, so a trigger that is repeated after a failure replaces its own rows and adds nothing. Files, their order and
late ones don't matter: a late row changes its period's total, and balances are summed over the totals when the table is read.

State and table grow with segments x periods, not with rows, so there is no watermark and nothing is dropped as late.
Totals are decimals or counts, so the table equals the batch result exactly. Sums run partially in the task that
read the file; a segment with most of the rows sends one row per task. :func:`compacted` folds old triggers into one folder.

Defined results: null segments and periods are groups of their own; null amounts add nothing (a total without any amount is
null); a trigger without files writes nothing; before the first trigger the table doesn't exist, and reading it fails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.frames import running_balance

TRIGGER = "trigger"


def keep_totals(
    rows: DataFrame, segment: Sequence[str], period: Column, measures: Mapping[str, Column], *, table: str, progress: str
) -> int:
    """Take in all files that a stream of rows (``spark.readStream``) has not seen yet and end. Returns the number of
    triggers. ``progress`` is the stream's checkpoint folder; both folders are on storage that all machines share."""
    totals = rows.groupBy(*segment, period.alias("date")).agg(*[m.alias(c) for c, m in measures.items()])

    written = []

    def write(changed: DataFrame, number: int) -> None:
        written.append(number)
        changed.write.mode("overwrite").parquet(f"{table}/{TRIGGER}={number:012d}")

    query = totals.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return len(written)


def totals(spark: SparkSession, table: str) -> DataFrame:
    """The newest total of every segment and period."""
    found = spark.read.parquet(table).withColumn(TRIGGER, F.col(TRIGGER).cast("bigint"))
    keys, values = _parts(found)
    newest = found.groupBy(*keys).agg(F.max_by(F.struct(*values), TRIGGER).alias("v"))
    return newest.select(*keys, "v.*")


def balances(spark: SparkSession, table: str, sums: Mapping[str, str]) -> DataFrame:
    """Totals with running balances per segment (new column: total)."""
    now = totals(spark, table)
    keys, _ = _parts(now)
    return running_balance(now, [k for k in keys if k != "date"], ["date"], dict(sums))


def _parts(found: DataFrame) -> tuple[list[str], list[str]]:
    """Keys stand up to ``date``, values behind it."""
    names = [c for c in found.columns if c != TRIGGER]
    cut = names.index("date") + 1
    return names[:cut], names[cut:]


def compacted(spark: SparkSession, table: str, into: str) -> None:
    """The newest totals as a fresh table of one trigger, under the newest trigger's number. Run it while no stream
    writes, and let the stream go on with ``into``."""
    newest = spark.read.parquet(table).agg(F.max(F.col(TRIGGER).cast("bigint"))).first()[0]
    totals(spark, table).write.parquet(f"{into}/{TRIGGER}={newest:012d}")
