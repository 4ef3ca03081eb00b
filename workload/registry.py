"""Named queries over the supplied tables, each with the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import round_half_up
from tidemark.functions.periods import period_label
from tidemark.session import use_checkpoints

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is only run."""

    def register(build: Query) -> Query:
        assert name not in QUERIES, name

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types every engine shares: decimals as doubles, dates and times as text."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = period_label(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            text = c.cast("string")  # not date_format, which reads the time in the session zone
            c = F.rpad(F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
        return c.alias(f.name)

    return df.select([shown(f) for f in df.schema.fields])


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Sums and means of doubles depend on the order of addition in their last digits."""
    return df.withColumns({c: round_half_up(F.col(c), places) for c in columns})


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder of the cluster (see ``use_checkpoints``)."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}/{name}"
