"""CSV input with rejected rows: what does not fit the schema is set aside, not lost or nulled.

A line is rejected if its number of fields differs from the header's (``fields``; an open quote swallows
the fields behind it and shows as this), if a text is no value of its column's type (``value: columns``), or if
a required column is empty (``missing: columns``). Every line is in exactly one of the two outputs.

The file is parsed once, whole lines at a time, and the outcome is written to the shared folder; both outputs and
their counts read that table. Column pruning is off while parsing, because a line with too many or too few fields
is only seen when all fields are parsed.

Defined results: an empty file (or one with a header only) gives two empty outputs; blank lines are
skipped as Spark's reader does; columns that the schema doesn't name are parsed as text and left out of the accepted
rows; schema columns that the header lacks are left out, and if required, it is an error."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

RAW = "__line"


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame  # line, reason, file

    def counts(self) -> DataFrame:
        """Rows by outcome: ``accepted`` or the reason."""
        good = self.accepted.select(F.lit("accepted").alias("outcome"))
        return good.unionByName(self.rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def read_checked(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> Checked:
    """Rows of a CSV file (or folder) with a header that fit the declared schema, and the others."""
    wanted = T.StructType.fromDDL(schema)
    header = spark.read.option("header", True).csv(path).columns
    absent = [c for c in required if c not in header]
    if absent:
        raise ValueError(f"required columns not in the header of {path}: {absent}")
    by_name = {f.name: f for f in wanted.fields}
    typed = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    names = [f"c{i}" for i in range(len(header))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(RAW, T.StringType())])
    raw = (
        spark.read.options(header=True, columnNameOfCorruptRecord=RAW, columnPruning=False, mode="PERMISSIVE", enforceSchema=True)
        .schema(T.StructType([*typed.fields, T.StructField(RAW, T.StringType())])).csv(path)
        .withColumn("__file", F.input_file_name()))
    # a rejected line is read again as plain text: if that fails too, its fields are too many or too few
    again = F.from_csv(F.col(RAW), text.simpleString()[len("struct<"):-1].replace(":", " "), {"columnNameOfCorruptRecord": RAW, "mode": "PERMISSIVE"})
    bad = [F.when(F.col(f"__again.{n}").isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for n, f in zip(names, typed.fields)]
    missing = [F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in required] or [F.lit(None).cast("string")]
    listed = lambda columns: F.array_join(F.array_compact(F.array(*columns)), ",")
    reason = (
        F.when(F.col(RAW).isNotNull() & F.col(f"__again.{RAW}").isNotNull(), F.lit("fields"))
        .when(F.col(RAW).isNotNull(), F.concat(F.lit("value: "), listed(bad)))
        .when(listed(missing) != "", F.concat(F.lit("missing: "), listed(missing))))
    line = F.coalesce(F.col(RAW), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header])))
    outcome = raw.withColumn("__again", again).withColumn("__reason", reason)
    kept = [c for c in wanted.names if c in header]
    table = written(outcome.select(
        *[F.col(f"`{c}`") for c in kept], "__reason", F.when(F.col("__reason").isNotNull(), line).alias(RAW),
        F.when(F.col("__reason").isNotNull(), F.col("__file")).alias("__file")))
    return Checked(
        table.where("__reason is null").select(*[F.col(f"`{c}`") for c in kept]),
        table.where("__reason is not null").select(F.col(RAW).alias("line"), F.col("__reason").alias("reason"), F.col("__file").alias("file")))
