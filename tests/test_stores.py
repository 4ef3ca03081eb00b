"""Kept state: sketches, streamed totals, rejected rows."""

import datetime as dt
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketches as Sk
from tidemark.operators.cube import cube_distinct
from tidemark.sources import checked
from tidemark.streaming import balances as B


def visits(spark, start, stop):
    """A third of all rows have one a; p decides between the two values of b."""
    one = spark.range(start, stop).select(
        F.pmod(F.xxhash64("id"), F.lit(9000)).alias("u"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("a"),
        F.when(F.col("id") % 11 > 0, (F.col("id") % 2).cast("string")).alias("b"), (F.col("id") % 4).cast("int").alias("p"))
    return one.unionByName(one.withColumn("u", F.lit(7).cast("bigint")).limit(200))


def test_estimates_are_within_the_stated_error(spark):
    rows = visits(spark, 0, 60_000)
    got = Sk.estimated(Sk.rolled_up(Sk.sketch_cells(rows, ["a", "b"], ["p"], "u"), ["a", "b"], ["p"]), "e")
    both = cube_distinct(rows, ["a", "b"], ["p"], "u", "n").join(got, ["a", "b", "p"], "full").collect()
    assert len(both) == 7 * 4 * 3 and {r.b for r in both} == {"all", "unknown", "0", "1"}
    off = [abs(r.e - r.n) / r.n for r in both]
    assert max(off) <= 5 * Sk.standard_error() and sum(o * o for o in off) / len(off) <= (1.5 * Sk.standard_error()) ** 2


def test_united_tables_estimate_as_one_table(spark):
    def same(cells, others, cell):
        both = Sk.estimated(cells, "e").join(Sk.estimated(others, "o"), cell, "full").collect()
        return len(both) > 0 and all(abs(r.e - r.o) <= 3 * Sk.standard_error() * r.o for r in both)

    part = [Sk.sketch_cells(visits(spark, *span), ["a", "b"], ["p"], "u") for span in ((0, 20_000), (20_000, 50_000), (0, 20_000))]
    both = visits(spark, 0, 20_000).unionByName(visits(spark, 20_000, 50_000))
    whole = Sk.sketch_cells(both, ["a", "b"], ["p"], "u")
    assert same(Sk.united(*part), whole, ["a", "b", "p"])
    halves = Sk.coarser(whole, {"p": (F.col("p") / 2).cast("int")})
    assert same(halves, Sk.sketch_cells(both.withColumn("p", (F.col("p") / 2).cast("int")), ["a", "b"], ["p"], "u"), ["a", "b", "p"])


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([(None, "x", 1), (None, None, 1), (3, "y", 1), (3, "y", 1)], "u bigint, a string, p int")
    got = Sk.estimated(Sk.rolled_up(Sk.sketch_cells(rows, ["a"], ["p"], "u"), ["a"], ["p"]), "e")
    assert {(r.a, r.e) for r in got.collect()} == {("x", 0), ("unknown", 0), ("y", 1), ("all", 1)}
    assert Sk.sketch_cells(rows.limit(0), ["a"], ["p"], "u").count() == 0


SCHEMA = "id BIGINT, day TIMESTAMP_NTZ, amount DECIMAL(18,2), place STRING"


def filed(*files):
    folder = Path(tempfile.mkdtemp(prefix="tidemark-test-"))
    for number, text in enumerate(files):
        (folder / f"{number}.csv").write_text(text)
    return f"{folder}/*.csv"


def test_every_line_is_accepted_or_rejected_with_its_reason(spark):
    head = "id,note,day,amount,place\n"
    found = checked.read_checked(spark, filed(
        head + '1,"a, b",2024-01-01T00:00:00,1.50,x\n2,n,2024-01-02T00:00:00,2,y,z\n3,n,2024-01-02T00:00:00\n4,"n,2024-01-02T00:00:00,4,y\n',
        head + "5,n,yesterday,5,x\nsix,n,2024-01-02T00:00:00,much,x\n7,n,2024-01-02T00:00:00,7,\n8,,,,x\n1,\"a, b\",2024-01-01T00:00:00,1.50,x\n"),
        SCHEMA, required=["place", "day"])
    assert found.accepted.columns == ["id", "day", "amount", "place"]
    assert [tuple(r) for r in found.accepted.collect()] == [(1, dt.datetime(2024, 1, 1), pytest.approx(1.5), "x")] * 2
    got = {(r.line.split(",")[0], r.reason, r.file[-5]) for r in found.rejected.collect()}
    assert got == {("2", "fields", "0"), ("3", "fields", "0"), ("4", "fields", "0"), ("5", "value: day", "1"), ("six", "value: id,amount", "1"),
                   ("7", "missing: place", "1"), ("8", "missing: day", "1")}
    assert found.accepted.count() + found.rejected.count() == 9  # counts see whole lines, too
    assert {(r.outcome, r.n) for r in found.counts().collect()} == {
        ("accepted", 2), ("fields", 3), ("value: day", 1), ("value: id,amount", 1), ("missing: place", 1), ("missing: day", 1)}


def test_checked_reading_of_nothing(spark):
    found = checked.read_checked(spark, filed("id,place\n"), SCHEMA)
    assert found.accepted.columns == ["id", "place"] and found.accepted.count() == 0 == found.rejected.count()
    with pytest.raises(ValueError, match="day"):
        checked.read_checked(spark, filed("id,place\n1,x\n"), SCHEMA, required=["day"])


def test_streamed_balances(spark):
    folder = tempfile.mkdtemp(prefix="tidemark-test-")
    table, progress = f"{folder}/table", f"{folder}/progress"
    schema = "k STRING, m INT, v DECIMAL(18,2)"

    def arrive(*rows):
        spark.createDataFrame([(k, m, v) for k, m, v in rows], "k STRING, m INT, v STRING").selectExpr("k", "m", "cast(v as decimal(18,2)) v").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def take(into=table):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        return B.keep_totals(stream, ["k"], F.col("m"), {"v": F.sum("v"), "n": F.count(F.lit(1))}, table=into, progress=progress)

    def shown(at=table):
        return sorted(((r.k or "-", r.date or 0, r.v, r.n, r.balance) for r in B.balances(spark, at, {"balance": "v"}).collect()), key=str)

    def batch():
        rows = spark.read.schema(schema).parquet(f"{folder}/in").groupBy("k", F.col("m").alias("date")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
        return sorted(((r.k or "-", r.date or 0, r.v, r.n, r.balance) for r in B.running_balance(rows, ["k"], ["date"], {"balance": "v"}).collect()), key=str)

    arrive(("a", 1, "1"), ("a", 3, "5"), (None, 1, "2"))
    arrive(("a", 2, "-4"), ("b", None, "3"), ("b", 1, None))
    assert take() == 2 and shown() == batch()
    assert take() == 0 and shown() == batch()  # a restart repeats nothing
    arrive(("a", 1, "100"), ("a", 1, "100"), (None, 1, "1"))  # late and repeated
    assert take() == 1 and shown() == batch()
    assert next(r[4] for r in shown() if r[:2] == ("a", 3)) == 202
    B.compacted(spark, table, f"{folder}/fresh")
    arrive(("a", 2, "7"))
    assert take(f"{folder}/fresh") == 1 and shown(f"{folder}/fresh") == batch()


def test_a_repeated_trigger_replaces_its_rows(spark):
    folder = tempfile.mkdtemp(prefix="tidemark-test-")
    spark.createDataFrame([("a", 1, 5)], "k STRING, m INT, v INT").write.parquet(f"{folder}/in")
    for attempt in ("p1", "p2"):  # a lost checkpoint: the same trigger number is written again
        stream = spark.readStream.schema("k STRING, m INT, v INT").parquet(f"{folder}/in")
        B.keep_totals(stream, ["k"], F.col("m"), {"v": F.sum("v")}, table=f"{folder}/table", progress=f"{folder}/{attempt}")
    assert [tuple(r) for r in B.balances(spark, f"{folder}/table", {"b": "v"}).collect()] == [("a", 1, 5, 5)]
