import tempfile

from pyspark.sql import functions as F

from tidemark.sources import readers


def test_csv_by_header_name(spark):
    folder = tempfile.mkdtemp(prefix="tidemark-test-") + "/market.csv"
    spark.createDataFrame([("A", "note", 5)], "country STRING, extra STRING, population BIGINT").select(
        "population", "extra", "country").write.option("header", True).csv(folder)
    got = readers.load_market(spark, folder)
    assert got.columns == ["country", "population"] and [tuple(r) for r in got.collect()] == [("A", 5)]


def test_cache_is_bounded_and_expires(spark):
    now = [0.0]
    cache, built = readers.FrameCache(max_entries=2, ttl=10, clock=lambda: now[0]), []

    def build(k):
        def make():
            built.append(k)
            return spark.range(3).withColumn("k", F.lit(k))
        return make

    for k in ("a", "a", "b", "c", "a"):
        cache.get(k, build(k)).count()
    assert built == ["a", "b", "c", "a"]
    now[0] = 11
    cache.get("a", build("a"))
    assert built[-1] == "a" and len(built) == 5
    cache.clear()
