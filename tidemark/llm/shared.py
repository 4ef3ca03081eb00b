"""Helpers of several operators: batches of bounded size, written steps, shipped code."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import use_checkpoints


def by_size(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of a variable-length column each."""
    start, held = 0, 0
    for i, value in enumerate(batch.column(column)):
        size = value.as_buffer().size if value.is_valid else 0
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: later steps start
    from files that outlive any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it isn't installed: once for each
    context, the driver's file server hands out a small archive of it."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = Path(tempfile.mkdtemp(prefix="tidemark-code-"))  # read by the driver alone
        shutil.copytree(package, folder / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / "tidemark"), "zip", folder / "code"))
        context._tidemark_shipped = True


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)
