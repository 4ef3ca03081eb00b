"""Spark session used by the tests, the benchmark and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LEAST_TASKS = 96


def local_session(cores: str | int = 8, app: str = "tidemark") -> SparkSession:
    """A local session. On a cluster the caller brings its own session; no operator
    depends on the settings made here (all time arithmetic is zone-free)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # small local data would otherwise be merged into one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", os.environ.get("TIDEMARK_ZONE", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder named in the session's settings.

    A session on one machine (tests, local runs) that names none gets a fresh local folder;
    on a cluster that would be a different disk for every task, so it is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if folder is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)


def dealt(df: DataFrame, *keys: str, share: int = 1) -> DataFrame:
    """Rows dealt by key to the session's number of shuffle partitions, ``LEAST_TASKS`` at least; with
    ``share`` to that part of the number, for fewer and narrower rows.

    The number is spelled out: adaptive execution merges other shuffles down to about one part a
    core, and sorts and tables of a task would then grow with the whole input."""
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(number, LEAST_TASKS) // share, *keys)


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, read again: it outlives executors, and what
    follows doesn't compute it a second time."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
