"""Queries over kept state: sketches, streamed totals, checked input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.periods import period_start
from tidemark.operators import sketches as Sk
from tidemark.operators.cube import cube_distinct
from tidemark.session import written
from tidemark.sources import checked, schemas
from tidemark.sources import star_schema as star
from tidemark.streaming import balances as B
from workload import sql as Q
from workload.primitives import MONTHLY_SQL
from workload.registry import query, shared_path

DIMS = ["country", "service", "trxn_type"]

# ---------------------------------------------------------------- distinct users by sketches

SKETCHED = """cells as (select coalesce(country, 'unknown') country, coalesce(service, 'unknown') service, coalesce(trxn_type, 'unknown') trxn_type,
 date_trunc('month', trxn_datetime) mon, user_id from ledger),
grains as (select *, 'Monthly' freq, mon date from cells union all select *, 'Quarterly', date_trunc('quarter', mon) from cells),
exact as (select freq, coalesce(country, 'all') country, coalesce(service, 'all') service, coalesce(trxn_type, 'all') trxn_type, date,
 count(distinct user_id) users from grains group by freq, date, cube (country, service, trxn_type))"""


def _sketched(spark, folder):
    """Monthly and quarterly estimates of all grouping sets, from one stored table of monthly cells."""
    ledger = star.ledger(spark, folder).withColumn("date", period_start("trxn_datetime", "Monthly"))
    cells = written(Sk.sketch_cells(ledger, DIMS, ["date"], "user_id"))
    quarters = Sk.coarser(cells, {"date": period_start("date", "Quarterly")})
    grains = {"Monthly": cells, "Quarterly": quarters}
    made = [Sk.estimated(Sk.rolled_up(c, DIMS, ["date"]), "estimate").withColumn("freq", F.lit(f)) for f, c in grains.items()]
    return made[0].unionByName(made[1])


@query("a3_sketch_users")
def _(spark, folder):
    return _sketched(spark, folder)


# the estimates beside the exact cube: no cell is farther off than five standard errors
@query("a3_sketch_error", Q.with_(Q.LEDGER, SKETCHED) + f"select freq, country, service, trxn_type, {Q.label('date')} date, users, true near from exact")
def _(spark, folder):
    ledger = star.ledger(spark, folder)
    exact = [
        cube_distinct(ledger.withColumn("date", period_start("trxn_datetime", f)), DIMS, ["date"], "user_id", "users").withColumn("freq", F.lit(f))
        for f in ("Monthly", "Quarterly")]
    both = exact[0].unionByName(exact[1]).join(_sketched(spark, folder), ["freq", *DIMS, "date"], "full")
    most = F.greatest(F.lit(1.0), 5 * Sk.standard_error() * F.col("users"))
    return both.select("freq", *DIMS, "date", "users", (F.abs(F.col("users") - F.col("estimate")) <= most).alias("near"))


# ---------------------------------------------------------------- totals of arriving files

@query("w2_streamed_balance", Q.with_(Q.LEDGER, MONTHLY_SQL) + f"""select country, service, {Q.label('date')} date, cast(tpv as double) tpv, n,
 cast(sum(tpv) over w as double) balance, cast(sum(n) over w as bigint) trxns from m window w as (partition by country, service order by date)""")
def _(spark, folder):
    arriving, table, progress = (shared_path(spark, name) for name in ("arriving", "totals", "progress"))
    columns = ["trxn_id", "trxn_datetime", "country", "service", "tpv"]
    ledger = star.ledger(spark, folder).select(*columns)
    # two deliveries: the second one has rows of all periods, so most of it is late
    for late in (False, True):
        ledger.where((F.col("trxn_id") % 5 == 0) == late).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 4).parquet(arriving)
        B.keep_totals(stream, ["country", "service"], period_start("trxn_datetime", "Monthly"),
                      {"tpv": F.sum("tpv"), "n": F.count(F.lit(1))}, table=table, progress=progress)
    return B.balances(spark, table, {"balance": "tpv", "trxns": "n"})


# ---------------------------------------------------------------- rejected rows

@query("s1_rejected_rows", Q.with_(Q.LEDGER) + """select case trxn_id % 16 when 1 then 'fields' when 3 then 'fields' when 5 then 'value: trxn_datetime'
 when 7 then 'value: user_id,balance' when 9 then 'missing: country' when 11 then 'fields' else 'accepted' end outcome,
 count(*) n, cast(sum(case when trxn_id % 16 in (1, 3, 5, 7, 9, 11) then null else balance end) as double) balance from ledger group by 1""")
def _(spark, folder):
    path = shared_path(spark, "delivered.csv")
    kind = F.col("trxn_id") % 16
    text = {
        "user_id": F.when(kind == 7, F.lit("u7")).otherwise(F.col("user_id").cast("string")),
        "trxn_datetime": F.when(kind == 5, F.lit("no date")).otherwise(F.date_format("trxn_datetime", "yyyy-MM-dd'T'HH:mm:ss")),
        "balance": F.when(kind == 7, F.lit("much")).otherwise(F.col("balance").cast("string")),
        # an open quote takes in the fields behind it
        "country": F.when(kind == 9, F.lit("")).when(kind == 3, F.concat(F.lit('"'), F.col("country"))).otherwise(F.col("country")),
        "service": F.col("service"),
    }
    line = F.concat_ws(",", F.col("trxn_id").cast("string"), *text.values())
    line = F.when(kind == 1, F.concat(line, F.lit(",extra"))).when(kind == 11, F.substring_index(line, ",", 3)).otherwise(line)
    # a header for every file, as each one is read on its own
    header = F.lit("trxn_id," + ",".join(text))
    lines = star.ledger(spark, folder).select(F.pmod(F.xxhash64("user_id"), F.lit(8)).alias("part"), line.alias("value"))
    one = spark.range(8).select(F.col("id").alias("part"), header.alias("value"))
    marked = one.withColumn("first", F.lit(0)).unionByName(lines.withColumn("first", F.lit(1)))
    marked.repartition("part").sortWithinPartitions("part", "first").select("part", "value").write.partitionBy("part").text(path)
    found = checked.read_checked(spark, f"{path}/*/*.txt", schemas.LEDGER, required=["country"])
    sums = found.accepted.agg(F.lit("accepted").alias("outcome"), F.sum("balance").alias("balance"))
    return found.counts().join(sums, "outcome", "left")
