"""Reading the input tables, and keeping computed frames for reuse."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import schemas

SESSION_TIME_FORMAT = "dd/MM/yyyyHH:mm"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file (or folder) with a header by declared schema, else Parquet.

    CSV columns are matched by header name, so extra columns and another order are fine."""
    if not path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.parquet(path)
    wanted = T.StructType.fromDDL(schema)
    header = spark.read.option("header", True).csv(path).columns
    by_name = {f.name: f for f in wanted.fields}
    as_filed = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    raw = spark.read.option("header", True).schema(as_filed).csv(path)
    return raw.select(*[c for c in wanted.names if c in header])


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.LEDGER)


def load_registrations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.REGISTRATIONS)


def load_market(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.MARKET)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SESSIONS)


def load_holidays(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.HOLIDAYS)


def parse_iso(text: Column) -> Column:
    """ISO text to a zone-free timestamp."""
    return F.to_timestamp_ntz(text)


def parse_session_time(text: Column) -> Column:
    """Day-first text, with or without a blank before the hour, to a zone-free timestamp."""
    return F.to_timestamp_ntz(F.regexp_replace(text, r"\s+", ""), F.lit(SESSION_TIME_FORMAT))


class FrameCache:
    """Persisted frames by input id: at most ``max_entries``, each for ``ttl`` seconds.

    Meant for aggregates that several views read. An evicted frame is unpersisted; a frame
    lost with its executor is computed again from its inputs."""

    def __init__(self, max_entries: int = 1, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.max_entries, self.ttl, self._clock = max_entries, ttl, clock
        self._kept: OrderedDict[Hashable, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: Hashable, build: Callable[[], DataFrame]) -> DataFrame:
        now = self._clock()
        kept = self._kept.get(key)
        if kept and now - kept[0] < self.ttl:
            return kept[1]
        if kept:
            self._drop(key)
        frame = build().persist()
        self._kept[key] = (now, frame)
        while len(self._kept) > self.max_entries:
            self._drop(next(iter(self._kept)))
        return frame

    def clear(self) -> None:
        for key in list(self._kept):
            self._drop(key)

    def _drop(self, key: Hashable) -> None:
        self._kept.pop(key)[1].unpersist()


def to_local(df: DataFrame, most: int) -> pd.DataFrame:
    """A result as a local frame; more than ``most`` rows are an error and are not fetched."""
    found = df.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: aggregate first, or write a table")
    return found
