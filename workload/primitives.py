"""Queries for the single steps the products are made of, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import lookup, ratio, remap, right_closed_bin, round_half_up, short_number
from tidemark.functions.periods import (
    period_label,
    period_start,
    plus_seconds,
    utc_to_local,
    whole_hours,
    whole_seconds,
)
from tidemark.operators import frames as Fr
from tidemark.operators.cube import cube_sums, weighted_rollup
from tidemark.operators.scan import ordered_scan
from tidemark.plans import calendar as Cal
from tidemark.plans import clusters as Cl
from tidemark.plans import flows as Fl
from tidemark.plans import kpis as K
from tidemark.plans import ledger as L
from tidemark.plans import power as P
from tidemark.plans import segments as Seg
from tidemark.plans import sessions as S
from tidemark.plans import stats as St
from tidemark.sources import readers as R
from tidemark.session import use_checkpoints
from tidemark.sources import star_schema as star
from workload import sql as Q
from workload.products import SFLOW_SQL, _facts, _facts_sql, _ward_groups, curve, features, span, workspace
from workload.registry import query, rounded, shared_path

LED, ENR, REG, EVT, SES, FEA = (Q.with_(x) for x in (Q.LEDGER, Q.ENRICHED, Q.REGISTRATIONS, Q.EVENTS, Q.SESSIONS, Q.FEATURES))

# ---------------------------------------------------------------- sources


@query("s1_csv_scan", LED + f"""select user_id, trxn_id, trxn_type, {Q.stamp('trxn_datetime')} trxn_datetime,
 cast(balance as double) balance, cast(tpv as double) tpv, service, country, channel from ledger""")
def _(spark, folder):
    path = shared_path(spark, "ledger.csv")
    star.ledger(spark, folder).write.option("header", True).csv(path)
    return R.load_ledger(spark, path).select(
        "user_id", "trxn_id", "trxn_type", "trxn_datetime", "balance", "tpv", "service", "country", "channel")


@query("s2_csv_sessions", SES + f"""select TransactionId, {Q.stamp("date_trunc('minute', UTCTransactionStart)")} UTCTransactionStart,
 ConnectedTime, ChargeTime, TotalEnergy, MaxPower from sessions""")
def _(spark, folder):
    path = shared_path(spark, "sessions.csv")
    text = {c: F.date_format(c, "dd/MM/yyyy HH:mm") for c in ("UTCTransactionStart", "UTCTransactionStop")}
    star.sessions(spark, folder).withColumns(text).write.option("header", True).csv(path)
    return S.clean_sessions(R.load_sessions(spark, path)).select(
        "TransactionId", "UTCTransactionStart", "ConnectedTime", "ChargeTime", "TotalEnergy", "MaxPower")


@query("s3_replaceable_input", SES + """select count(*) n, sum(TransactionId) ids from sessions""")
def _(spark, folder):
    path = shared_path(spark, "sessions")
    star.sessions(spark, folder).write.parquet(path)
    return R.load_sessions(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("TransactionId").alias("ids"))


@query("s4_parse_iso", LED + f"select trxn_id, {Q.stamp('trxn_datetime')} parsed from ledger")
def _(spark, folder):
    text = F.date_format("trxn_datetime", "yyyy-MM-dd'T'HH:mm:ss")
    return star.ledger(spark, folder).select("trxn_id", R.parse_iso(text).alias("parsed"))


@query("s5_parse_day_first", SES + f"""select TransactionId, {Q.stamp("date_trunc('minute', UTCTransactionStart)")} tight,
 {Q.stamp("date_trunc('minute', UTCTransactionStop)")} spaced from sessions""")
def _(spark, folder):
    tight, spaced = F.date_format("UTCTransactionStart", "dd/MM/yyyyHH:mm"), F.date_format("UTCTransactionStop", "dd/MM/yyyy HH:mm")
    return star.sessions(spark, folder).select(
        "TransactionId", R.parse_session_time(tight).alias("tight"), R.parse_session_time(spaced).alias("spaced"))


KINDS_SQL = "select trxn_type, count(*) n, cast(sum(balance) as double) balance from ledger group by 1"


@query("s6_materialise", LED + KINDS_SQL)
def _(spark, folder):
    # written to the shared folder and read from there; Spark removes it when nothing refers to it
    use_checkpoints(spark)
    kept = star.ledger(spark, folder).checkpoint()
    return kept.groupBy("trxn_type").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance"))


CACHE = R.FrameCache(max_entries=1)


@query("s7_frame_cache", LED + KINDS_SQL)
def _(spark, folder):
    def kinds():
        return star.ledger(spark, folder).groupBy("trxn_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance"))

    CACHE.get((spark.sparkContext.applicationId, folder), kinds)
    return CACHE.get((spark.sparkContext.applicationId, folder), kinds)


@query("s8_scalar_and_list", LED + """select (select count(distinct service) from ledger) services,
 (select string_agg(service, ',' order by service) from (select distinct service from ledger)) names""")
def _(spark, folder):
    exported = R.to_local(Fr.distinct_values(star.ledger(spark, folder), "service"), most=1000)
    names = sorted(exported["service"].dropna())
    return spark.createDataFrame([(len(names), ",".join(names))], "services BIGINT, names STRING")


@query("s9_filter_values", LED + "select distinct channel from ledger where channel is not null order by channel")
def _(spark, folder):
    return Fr.distinct_values(star.ledger(spark, folder), "channel")


@query("s10_local_frame", SES + f"""select {Q.label("date")} date, count(TransactionId) n
 from (select unnest([date '2024-01-01', date '2024-03-29', date '2024-04-01']) as date) h
 left join sessions on cast(UTCTransactionStart as date) = date group by 1""")
def _(spark, folder):
    import pandas as pd

    local = pd.DataFrame({"date": pd.to_datetime(star.HOLIDAY_DATES).date})
    days = spark.createDataFrame(local, "date DATE")
    started = star.sessions(spark, folder).groupBy(F.to_date("UTCTransactionStart").alias("date")).agg(F.count("TransactionId").alias("n"))
    return days.join(started, "date", "left").na.fill(0, ["n"])


# ---------------------------------------------------------------- projection and filter

@query("p1_add_columns", ENR + "select trxn_id, trxn_group, cast(atpv as double) atpv, account_status from enriched")
def _(spark, folder):
    return L.add_groups(star.ledger(spark, folder)).select("trxn_id", "trxn_group", "atpv", "account_status")


@query("p2_select", LED + "select user_id, trxn_id, country from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("user_id", "trxn_id", "country")


@query("p3_rename", Q.with_(Q.MARKET) + "select country, population market_size from market")
def _(spark, folder):
    return star.market(spark, folder).withColumnsRenamed({"population": "market_size"})


@query("p4_prefix_rename", Q.with_(Q.MARKET) + 'select country "S1_country", population "S1_population" from market')
def _(spark, folder):
    return Fr.prefixed(star.market(spark, folder), "S1_")


@query("p5_drop", Q.with_(Q.MARKET) + "select country from market")
def _(spark, folder):
    return star.market(spark, folder).drop("population")


@query("p6_literal", LED + f"select user_id, trxn_id, {Q.stamp('trxn_datetime')} trxn_datetime, 'activate' trxn_type from ledger where trxn_type = 'open'")
def _(spark, folder):
    return L.activations(star.ledger(spark, folder))


@query("p7_apply_to_columns", LED + f"select trxn_id, {Q.label('trxn_datetime')} trxn_datetime, {Q.label('acc_maturity_datetime')} acc_maturity_datetime from ledger")
def _(spark, folder):
    times = ["trxn_datetime", "acc_maturity_datetime"]
    return star.ledger(spark, folder).select("trxn_id", *[F.to_date(c).alias(c) for c in times])


@query("p8_numeric_columns", Q.with_(Q.LEDGER, "q as (select country, service, date_trunc('quarter', trxn_datetime) date, sum(tpv) tpv, count(*) n from ledger group by all)")
       + f"select country, service, {Q.label('date')} date, cast(tpv as double) tpv, n, {Q.pct('tpv', 'country, service', 'date', 1)}, {Q.pct('n', 'country, service', 'date', 1)} from q")
def _(spark, folder):
    periods = star.ledger(spark, folder).groupBy("country", "service", period_start("trxn_datetime", "Quarterly").alias("date")).agg(
        F.sum("tpv").alias("tpv"), F.count(F.lit(1)).alias("n"))
    return Fr.percent_change(periods, ["country", "service"], ["date"], Fr.numeric_columns(periods), places=1)


@query("p9_filter_chain", ENR + "select trxn_id from enriched where trxn_group = 'gain' and channel <> 'ch0' and account_status = 1")
def _(spark, folder):
    rows = L.add_groups(star.ledger(spark, folder))
    return rows.where((F.col("trxn_group") == "gain") & (F.col("channel") != "ch0") & (F.col("account_status") == 1)).select("trxn_id")


@query("p10_in_and_not_in", LED + "select trxn_id from ledger where country in ('NATION_1','NATION_2') and trxn_type not in ('top_up','withdraw')")
def _(spark, folder):
    return star.ledger(spark, folder).where(
        F.col("country").isin("NATION_1", "NATION_2") & ~F.col("trxn_type").isin("top_up", "withdraw")).select("trxn_id")


NULLED_SQL = "nulled as (select *, case when trxn_type = 'top_up' then null else service end svc from ledger)"


def _nulled(spark, folder):
    rows = star.ledger(spark, folder)
    return rows.withColumn("service", F.when(F.col("trxn_type") != "top_up", F.col("service")))


@query("p11_in_or_null", Q.with_(Q.LEDGER, NULLED_SQL) + "select trxn_id, svc service from nulled where svc in ('Fixed') or svc is null")
def _(spark, folder):
    rows = _nulled(spark, folder)
    return L.apply_filters(rows, rows, services=["Fixed"])[0].select("trxn_id", "service")


@query("p12_at_column_maximum", LED + "select trxn_id from ledger where trxn_datetime = (select max(trxn_datetime) from ledger)")
def _(spark, folder):
    return Fr.at_maximum(star.ledger(spark, folder), "trxn_datetime").select("trxn_id")


@query("p13_beyond_column_maximum", LED + f"select trxn_id, {Q.stamp('acc_maturity_datetime')} acc_maturity_datetime from ledger where acc_maturity_datetime > (select max(trxn_datetime) from ledger)")
def _(spark, folder):
    return Fr.beyond_maximum(star.ledger(spark, folder), "acc_maturity_datetime", "trxn_datetime").select("trxn_id", "acc_maturity_datetime")


@query("p14_column_inequality", LED + "select trxn_id from ledger where date_trunc('quarter', acc_maturity_datetime) <> date_trunc('quarter', trxn_datetime)")
def _(spark, folder):
    rows = star.ledger(spark, folder)
    due, done = (period_start(c, "Quarterly") for c in ("acc_maturity_datetime", "trxn_datetime"))
    return rows.where(due != done).select("trxn_id")


@query("p15_nonzero", LED + "select trxn_id, cast(tpv as double) tpv from ledger where tpv <> 0")
def _(spark, folder):
    return star.ledger(spark, folder).where(F.col("tpv") != 0).select("trxn_id", "tpv")


@query("p16_parameter_filter", LED + "select channel, country, count(*) n from ledger where channel = 'ch1' and balance > 1000 group by all")
def _(spark, folder):
    return spark.sql(
        "select channel, country, count(*) as n from {ledger} where channel = :channel and balance > :least group by channel, country",
        args={"channel": "ch1", "least": 1000}, ledger=star.ledger(spark, folder))


@query("p17_drop_nulls", Q.with_(Q.LEDGER, NULLED_SQL) + "select trxn_id, svc service from nulled where svc is not null")
def _(spark, folder):
    return _nulled(spark, folder).select("trxn_id", "service").na.drop("any")


@query("p18_optional_filters", REG + "select country, channel, count(*) n from registrations where channel in ('ch1') group by all")
def _(spark, folder):
    rows = star.registrations(spark, folder)
    _, kept = L.apply_filters(rows, rows, countries=None, channels=["ch1"])
    return kept.groupBy("country", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("p19_case_chain", ENR + "select user_id, trxn_id, user_status from enriched")
def _(spark, folder):
    return L.enrich_ledger(star.ledger(spark, folder)).select("user_id", "trxn_id", "user_status")


@query("p20_remap", LED + "select trxn_id, case trxn_type when 'open' then 'Opened' when 'break' then 'Broken' else trxn_type end label from ledger")
def _(spark, folder):
    named = remap(F.col("trxn_type"), {"open": "Opened", "break": "Broken"})
    return star.ledger(spark, folder).select("trxn_id", named.alias("label"))


@query("p21_conditional_update", LED + "select trxn_id, case when tpv < 0 then 'out' else service end service from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", F.when(F.col("tpv") < 0, "out").otherwise(F.col("service")).alias("service"))


@query("p22_empty_test", LED + """select 'ledger' frame, count(*) = 0 "empty" from ledger union all
 select 'refunds', count(*) = 0 from ledger where trxn_type = 'refund'""")
def _(spark, folder):
    rows = star.ledger(spark, folder)

    def empty(frame, name):  # one row decides
        return frame.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") == 0).alias("empty")).withColumn("frame", F.lit(name))

    return empty(rows, "ledger").unionByName(empty(rows.where(F.col("trxn_type") == "refund"), "refunds"))


# ---------------------------------------------------------------- joins

@query("j1_left_chain", Q.with_(Q.MARKET, Q.LEDGER, Q.REGISTRATIONS) + """select country, population, trxns, cast(steps as bigint) steps from market
 left join (select country, count(*) trxns from ledger group by 1) using (country)
 left join (select country, count(*) steps from registrations group by 1) using (country)""")
def _(spark, folder):
    trxns = star.ledger(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("trxns"))
    steps = star.registrations(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("steps"))
    return star.market(spark, folder).join(trxns, "country", "left").join(steps, "country", "left")


@query("j2_inner_other_names", Q.with_(Q.LEDGER, Q.MARKET) + "select trxn_id, population from ledger l join (select country place, population from market) m on l.country = m.place")
def _(spark, folder):
    places = star.market(spark, folder).withColumnRenamed("country", "place")
    return star.ledger(spark, folder).join(places, F.col("country") == F.col("place")).select("trxn_id", "population")


@query("j3_full_on_timestamp", Q.with_(Q.FEATURES, Q.CALENDAR, Q.CHANGES) + f"""select {Q.stamp('UTCDatetime')} UTCDatetime, AvgChargePower_Mean, Peakhour
 from buckets full join calendar using (UTCDatetime)""")
def _(spark, folder):
    buckets = P.bucket_power(P.power_changes(features(spark, folder)))
    switches = Cal.peak_calendar(span(spark, folder), star.holidays(spark))
    return buckets.join(switches, "UTCDatetime", "full").select("UTCDatetime", "AvgChargePower_Mean", "Peakhour")


NODE_IDS_SQL = """names as (select service, source node from edges union select service, target from edges),
nodes as (select *, row_number() over (partition by service order by node) - 1 node_id from names)"""


@query("j4_edge_node_ids", Q.with_(Q.ENRICHED, SFLOW_SQL, NODE_IDS_SQL) + """select e.service, e.source, e.target, e.len, s.node_id source_id, t.node_id target_id
 from edges e left join nodes s on e.service = s.service and e.source = s.node left join nodes t on e.service = t.service and e.target = t.node""")
def _(spark, folder):
    edges = Fl.service_flow(L.add_groups(star.ledger(spark, folder)))
    names = edges.select("service", F.col("source").alias("node")).unionByName(edges.select("service", F.col("target").alias("node"))).distinct()
    nodes = names.withColumn("node_id", F.row_number().over(Window.partitionBy("service").orderBy("node")) - 1)
    return Fl.numbered_edges(edges, nodes, ["service"])


@query("j5_aligned_arithmetic", Q.with_(Q.LEDGER, Q.REGISTRATIONS) + """select user_id, a.n - b.n diff from
 (select user_id, count(*) n from ledger group by 1) a full join (select user_id, count(*) n from registrations group by 1) b using (user_id)""")
def _(spark, folder):
    a = star.ledger(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("a"))
    b = star.registrations(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "user_id", "full").select("user_id", (F.col("a") - F.col("b")).alias("diff"))


@query("j6_service_pairs", LED + """, c as (select country, service, count(*) n from ledger group by all)
 select a.country, a.service s1, b.service s2, a.n n1, b.n n2 from c a join c b on a.country = b.country and a.service < b.service""")
def _(spark, folder):
    counts = star.ledger(spark, folder).groupBy("country", "service").agg(F.count(F.lit(1)).alias("n"))
    a, b = counts.withColumnsRenamed({"service": "s1", "n": "n1"}), counts.withColumnsRenamed({"service": "s2", "n": "n2"})
    return a.join(b, "country").where(F.col("s1") < F.col("s2"))


@query("j7_label_of_other_frame", Q.with_(Q.FEATURES) + f"""select l.label, count(*) n, {Q.r('avg(f.TotalEnergy)')} energy from features f
 join (select TransactionId, case when Utilization > 50 then 'busy' else 'idle' end as label from features) l using (TransactionId) group by 1""")
def _(spark, folder):
    rows = features(spark, folder)
    labels = rows.select("TransactionId", F.when(F.col("Utilization") > 50, "busy").otherwise("idle").alias("label"))
    joined = star.sessions(spark, folder).join(labels, "TransactionId")
    return rounded(joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("TotalEnergy").alias("energy")), ["energy"])


@query("j8_calendar_anti_join", Q.with_(Q.SESSIONS, Q.HOLIDAYS) + f"""select {Q.label('d')} "day", count(*) n from (select cast(UTCTransactionStart as date) d from sessions)
 where isodow(d) < 6 and not exists (select 1 from holidays where date = d) group by d""")
def _(spark, folder):
    started = star.sessions(spark, folder).groupBy(F.to_date("UTCTransactionStart").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    closed = star.holidays(spark).withColumnRenamed("date", "day")
    return started.where(F.weekday("day") < 5).join(closed, "day", "left_anti")


# ---------------------------------------------------------------- aggregation

@query("a1_grouped_aggregate", LED + "select country, channel, cast(sum(tpv) as double) tpv, count(*) n from ledger group by country, channel")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("country", "channel").agg(F.sum("tpv").alias("tpv"), F.count(F.lit(1)).alias("n"))


@query("a2_count_nonnull", Q.with_(Q.LEDGER, NULLED_SQL) + "select country, count(svc) n from nulled group by country")
def _(spark, folder):
    return _nulled(spark, folder).groupBy("country").agg(F.count("service").alias("n"))


@query("a3_distinct_count", LED + "select country, service, count(distinct user_id) users from ledger group by all")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("country", "service").agg(F.count_distinct("user_id").alias("users"))


@query("a4_row_count", LED + "select service, trxn_type, count(*) len from ledger group by all")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("service", "trxn_type").agg(F.count(F.lit(1)).alias("len"))


@query("a5_sum", ENR + "select country, cast(sum(tpv) as double) tpv, cast(sum(atpv) as double) atpv from enriched group by country")
def _(spark, folder):
    return L.add_groups(star.ledger(spark, folder)).groupBy("country").agg(F.sum("tpv").alias("tpv"), F.sum("atpv").alias("atpv"))


@query("a6_conditional_count", ENR + "select country, count(*) filter (where account_status > 0) up, count(*) filter (where account_status < 0) down from enriched group by country")
def _(spark, folder):
    status = F.col("account_status")
    return L.add_groups(star.ledger(spark, folder)).groupBy("country").agg(F.count_if(status > 0).alias("up"), F.count_if(status < 0).alias("down"))


@query("a7_mean_min_max", SES + f"select ConnectedTime, {Q.r('avg(TotalEnergy)')} mean, min(TotalEnergy) low, max(TotalEnergy) high from sessions group by 1")
def _(spark, folder):
    e = "TotalEnergy"
    return rounded(star.sessions(spark, folder).groupBy("ConnectedTime").agg(F.avg(e).alias("mean"), F.min(e).alias("low"), F.max(e).alias("high")), ["mean"])


@query("a8_last_in_order", LED + "select country, cast(arg_max(balance, {'a': trxn_datetime, 'b': trxn_id}) as double) balance from ledger group by country")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("country").agg(F.max_by("balance", F.struct("trxn_datetime", "trxn_id")).alias("balance"))


@query("a9_mean_whole_hours", REG + f"""select trxn_type, {Q.ratio("sum(datediff('second', signup_datetime, trxn_datetime) // 3600)", 'count(*)')} as "hours"
 from registrations group by 1""")
def _(spark, folder):
    hours = whole_hours(F.col("signup_datetime"), F.col("trxn_datetime"))
    return star.registrations(spark, folder).groupBy("trxn_type").agg(ratio(F.sum(hours), F.count(hours)).alias("hours"))


@query("a10_cube_kpis", LED + f"""select {Q.cube_labels(['country', 'service', 'channel'])}, {Q.label("date_trunc('month', trxn_datetime)")} date,
 count(trxn_id) T, cast(sum(tpv) as double) TPV from ledger group by date_trunc('month', trxn_datetime), cube(country, service, channel)""")
def _(spark, folder):
    rows = star.ledger(spark, folder).withColumn("date", period_start("trxn_datetime", "Monthly"))
    return cube_sums(rows, ["country", "service", "channel"], ["date"], {"T": F.count("trxn_id"), "TPV": F.sum("tpv")})


STEP_COUNTS = [(k, f"count(*) filter (where trxn_type = '{k}') {k}") for k in K.STEPS]


@query("a11_pivot", EVT + f"select country, channel, {', '.join(x for _, x in STEP_COUNTS)} from events_ group by country, channel")
def _(spark, folder):
    w = workspace(spark, folder)
    return w.registrations.groupBy("country", "channel").pivot("trxn_type", K.STEPS).agg(F.count(F.lit(1))).na.fill(0, K.STEPS)


@query("a12_unpivot", SES + "select TransactionId, unnest(['ConnectedTime','ChargeTime','TotalEnergy','MaxPower']) variable, unnest([ConnectedTime, ChargeTime, TotalEnergy, MaxPower]) \"value\" from sessions")
def _(spark, folder):
    return St.long_form(star.sessions(spark, folder), S.RAW_VARS, ["TransactionId"])


@query("a13_global_min_max", Q.with_(Q.SESSIONS, Q.SPAN) + f"select {Q.stamp('start')} start, {Q.stamp('stop')} stop from span")
def _(spark, folder):
    return span(spark, folder)


@query("a14_percent_of_total", LED + f"select country, {Q.ratio('count(*)', '(select count(*) from ledger)')} * 100 n from ledger group by country")
def _(spark, folder):
    return Fr.percent_of_total(star.ledger(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("n")), ["n"])


@query("a15_share_in_group", LED + f"select country, service, {Q.ratio('count(*)', 'sum(count(*)) over (partition by country)')} share, count(*) n from ledger group by country, service")
def _(spark, folder):
    return Fr.share_within(star.ledger(spark, folder).groupBy("country", "service").agg(F.count(F.lit(1)).alias("n")), ["country"], "n", "share")


@query("a16_percentiles", SES + "select " + ", ".join(
    f"quantile_cont(TotalEnergy, {p}) p{i}" for i, p in enumerate(St.PERCENTILES)) + " from sessions")
def _(spark, folder):
    rows = star.sessions(spark, folder)
    found = St.exact_percentiles(rows, ["TotalEnergy"], St.PERCENTILES)["TotalEnergy"]
    return spark.range(1).select(*[F.lit(x).cast("double").alias(f"p{i}") for i, x in enumerate(found)])


@query("a17_histogram", SES + """, b as (select least(cast(floor((TotalEnergy - (select min(TotalEnergy) from sessions))
 / (select max(TotalEnergy) - min(TotalEnergy) from sessions) * 50) as bigint), 49) bin from sessions)
 select 'TotalEnergy' variable, bin, count(*) n, """ + Q.ratio("count(*)", "(select count(*) from b)") + " * 100 pct from b group by bin")
def _(spark, folder):
    return St.histograms(star.sessions(spark, folder), ["TotalEnergy"], 50)


BUSY_SQL = "busy as (select *, case when Utilization > 50 then 'busy' else 'idle' end as label from features)"


@query("a18_box_by_group", Q.with_(Q.FEATURES, BUSY_SQL, """q as (select label, quantile_cont(MaxPower, 0.25) q1, quantile_cont(MaxPower, 0.5) median,
 quantile_cont(MaxPower, 0.75) q3 from busy group by label)""") + "select q.label, " + ", ".join(f"{Q.r(f'any_value({c})')} {c}" for c in ("q1", "median", "q3")) + f""",
 {Q.r('min(MaxPower) filter (where MaxPower >= q1 - 1.5 * (q3 - q1))')} low, {Q.r('max(MaxPower) filter (where MaxPower <= q3 + 1.5 * (q3 - q1))')} high
 from busy join q using (label) group by q.label""")
def _(spark, folder):
    rows = features(spark, folder).withColumn("label", F.when(F.col("Utilization") > 50, "busy").otherwise("idle"))
    return rounded(St.box_by_group(rows, "label", "MaxPower"), ["q1", "median", "q3", "low", "high"])


@query("a19_weighted_rollup", LED + f""", c as (select country, service, count(*) n, cast(avg(balance) as double) b from ledger group by all)
 select 'Europe' root, case when grouping(country) = 1 then 'all' else country end country, case when grouping(service) = 1 then 'all' else service end service,
 cast((1 - grouping(country)) + (1 - grouping(service)) as bigint) "level", cast(sum(n) as double) n, {Q.r('cast(sum(cast(n as decimal(18,0)) * cast(b as decimal(19,10))) as double) / sum(n)', 4)} b,
 {Q.r('sum(n) * 100.0 / (select sum(n) from c)')} share_of_root from c group by rollup(country, service)""")
def _(spark, folder):
    cells = star.ledger(spark, folder).groupBy("country", "service").agg(
        F.count(F.lit(1)).alias("n"), ratio(F.sum("balance"), F.count("balance")).alias("b"))
    return rounded(rounded(weighted_rollup(cells, ["country", "service"], "n", "b", "Europe"), ["b"], 4), ["share_of_root"])


@query("a20_percent_of_maximum", EVT + f"select channel, trxn_type, U, {Q.ratio('U', 'max(U) over (partition by channel)')} * 100 pct from (select channel, trxn_type, count(*) U from events_ group by all)")
def _(spark, folder):
    steps = workspace(spark, folder).registrations.groupBy("channel", "trxn_type").agg(F.count(F.lit(1)).alias("U"))
    return Fr.percent_of_group_maximum(steps, ["channel"], "U", "pct")


@query("a21_cumulative_series", LED + f"""select service, {Q.label("date_trunc('week', trxn_datetime)")} date, cast(sum(sum(tpv)) over (partition by service
 order by date_trunc('week', trxn_datetime) rows between unbounded preceding and current row) as double) total from ledger group by service, date_trunc('week', trxn_datetime)""")
def _(spark, folder):
    weekly = star.ledger(spark, folder).groupBy("service", period_start("trxn_datetime", "Weekly").alias("date")).agg(F.sum("tpv").alias("tpv"))
    return Fr.running_balance(weekly, ["service"], ["date"], {"total": "tpv"}).drop("tpv")


@query("a22_distinct_rows", LED + "select distinct country, channel, service from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("country", "channel", "service").distinct()


@query("a23_first_and_last_per_key", LED + """select 'first' which, user_id, arg_min(trxn_id, {'a': trxn_datetime, 'b': trxn_id}) trxn_id from ledger group by user_id
 union all select 'last', user_id, arg_max(trxn_id, {'a': trxn_datetime, 'b': trxn_id}) from ledger group by user_id""")
def _(spark, folder):
    rows = star.ledger(spark, folder).select("user_id", "trxn_id", "trxn_datetime")
    both = [Fr.first_per(rows, ["user_id"], L.LEDGER_ORDER, last=last).select(F.lit(name).alias("which"), "user_id", "trxn_id")
            for name, last in (("first", False), ("last", True))]
    return both[0].unionByName(both[1])


@query("a24_group_sum", Q.with_(Q.ENRICHED, SFLOW_SQL) + "select target, cast(sum(len) as bigint) len from edges group by target")
def _(spark, folder):
    return Fl.service_flow(L.add_groups(star.ledger(spark, folder))).groupBy("target").agg(F.sum("len").alias("len"))


@query("a25_column_extremes", LED + """, c as (select country, count(*) n, count(distinct user_id) users from ledger group by country)
 select *, case when n = max(n) over () then 'max' when n = min(n) over () then 'min' end n_extreme,
 case when users = max(users) over () then 'max' when users = min(users) over () then 'min' end users_extreme from c""")
def _(spark, folder):
    counts = star.ledger(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return Fr.flag_extremes(counts, ["n", "users"])


# ---------------------------------------------------------------- windows

@query("w1_running_sum_per_user", ENR + "select trxn_id, account_count from enriched")
def _(spark, folder):
    return L.enrich_ledger(star.ledger(spark, folder)).select("trxn_id", "account_count")


MONTHLY_SQL = "m as (select country, service, date_trunc('month', trxn_datetime) date, sum(tpv) tpv, count(*) n from ledger group by all)"


def _monthly(spark, folder):
    return star.ledger(spark, folder).groupBy("country", "service", period_start("trxn_datetime", "Monthly").alias("date")).agg(
        F.sum("tpv").alias("tpv"), F.count(F.lit(1)).alias("n"))


@query("w2_running_balance", Q.with_(Q.LEDGER, MONTHLY_SQL) + f"""select country, service, {Q.label('date')} date, cast(sum(tpv) over (partition by country, service order by date
 rows between unbounded preceding and current row) as double) balance from m""")
def _(spark, folder):
    return Fr.running_balance(_monthly(spark, folder), ["country", "service"], ["date"], {"balance": "tpv"}).drop("tpv", "n")


@query("w3_global_running_sum", Q.with_(Q.FEATURES, Q.CHANGES) + "select TransactionId, Point, cast(AvgChargePower as double) AvgChargePower from running")
def _(spark, folder):
    return P.running_power(P.power_changes(features(spark, folder))).select("TransactionId", "Point", "AvgChargePower")


@query("w4_pct_change", Q.with_(Q.LEDGER, MONTHLY_SQL) + f"""select country, service, {Q.label('date')} date, cast(tpv as double) tpv, n,
 {Q.pct('tpv', 'country, service', 'date', 1)}, {Q.pct('n', 'country, service', 'date', 1)} from m""")
def _(spark, folder):
    return Fr.percent_change(_monthly(spark, folder), ["country", "service"], ["date"], places=1)


@query("w5_lag_per_user", LED + "select trxn_id, lag(trxn_type) over (partition by service, user_id order by trxn_datetime, trxn_id) source from ledger")
def _(spark, folder):
    return ordered_scan(star.ledger(spark, folder), ["service", "user_id"], L.LEDGER_ORDER, L.event_slices(),
                        previous={"source": F.col("trxn_type")}).select("trxn_id", "source")


@query("w6_forward_fill", Q.with_(Q.FEATURES, Q.CALENDAR, Q.CHANGES, Q.CURVE) + f"select {Q.stamp('UTCDatetime')} UTCDatetime, AvgChargePower_Max, Peakhour from curve")
def _(spark, folder):
    return curve(spark, folder).select("UTCDatetime", "AvgChargePower_Max", "Peakhour")


@query("w7_rank_share", SES + """select TotalEnergy, cast(sum(x) as bigint) total, count(*) n
 from (select TotalEnergy, row_number() over (order by TotalEnergy) x from sessions) group by 1""")
def _(spark, folder):
    # the order among equal values is random, the sum of their ranks is not
    rows = star.sessions(spark, folder)
    ranked = Seg.rank_share(rows, "TotalEnergy")
    rank = F.round(F.col("rank_share") * rows.select(F.count("TotalEnergy")).scalar()).cast("bigint")
    return ranked.groupBy("TotalEnergy").agg(F.sum(rank).alias("total"), F.count(F.lit(1)).alias("n"))


PLACES_SQL = "pl as (select country, service, count(*) n from ledger group by all)"


def _places(spark, folder):
    return star.ledger(spark, folder).groupBy("country", "service").agg(F.count(F.lit(1)).alias("n"))


@query("w8_number_in_group", Q.with_(Q.LEDGER, PLACES_SQL) + "select country, service, row_number() over (partition by country order by n, service) - 1 k from pl")
def _(spark, folder):
    w = Window.partitionBy("country").orderBy("n", "service")
    return _places(spark, folder).select("country", "service", (F.row_number().over(w) - 1).alias("k"))


@query("w9_normalised_position", Q.with_(Q.LEDGER, PLACES_SQL, "nk as (select *, row_number() over (partition by country order by n, service) - 1 k from pl)")
       + "select country, service, least(greatest(cast(k + 1 as double) / (max(k) over (partition by country) + 2), 0.05), 0.95) y from nk")
def _(spark, folder):
    w = Window.partitionBy("country")
    numbered = _places(spark, folder).withColumn("k", F.row_number().over(w.orderBy("n", "service")) - 1)
    return numbered.select("country", "service", Fl.clip((F.col("k") + 1) / (F.max("k").over(w) + 2)).alias("y"))


@query("w10_dense_ids", Q.with_(Q.ENRICHED, SFLOW_SQL, NODE_IDS_SQL) + "select service, node, node_id from nodes")
def _(spark, folder):
    edges = Fl.service_flow(L.add_groups(star.ledger(spark, folder)))
    names = edges.unpivot(["service"], ["source", "target"], "side", "node").drop("side").distinct()
    return names.withColumn("node_id", F.row_number().over(Window.partitionBy("service").orderBy("node")) - 1)


@query("w11_min_max_scaling", SES + "select TransactionId, (TotalEnergy - min(TotalEnergy) over ()) / (max(TotalEnergy) over () - min(TotalEnergy) over ()) scaled from sessions")
def _(spark, folder):
    rows = star.sessions(spark, folder)
    b = rows.agg(F.struct(F.min("TotalEnergy").alias("lo"), F.max("TotalEnergy").alias("hi")).alias("b")).scalar()
    x = F.try_divide(F.col("TotalEnergy") - b.getField("lo"), b.getField("hi") - b.getField("lo"))
    return rows.select("TransactionId", x.alias("scaled"))


# ---------------------------------------------------------------- sorts and sets

@query("o1_sort_columns", REG + f"select user_id, {Q.stamp('trxn_datetime')} trxn_datetime, trxn_type from registrations order by user_id, trxn_datetime")
def _(spark, folder):
    return star.registrations(spark, folder).select("user_id", "trxn_datetime", "trxn_type").orderBy("user_id", "trxn_datetime")


@query("o2_sort_descending", LED + "select country, count(*) U from ledger group by country order by U desc, country")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("U")).orderBy(F.desc("U"), "country")


@query("o3_sort_frame_by_key", Q.with_(Q.MARKET) + "select * from market order by country")
def _(spark, folder):
    return star.market(spark, folder).orderBy("country")


@query("o4_last_row", LED + f"select trxn_id, {Q.stamp('trxn_datetime')} trxn_datetime, cast(balance as double) balance from ledger order by trxn_datetime desc, trxn_id desc limit 1")
def _(spark, folder):
    return star.ledger(spark, folder).orderBy(F.desc("trxn_datetime"), F.desc("trxn_id")).limit(1).select("trxn_id", "trxn_datetime", "balance")


@query("o5_sort_by_index", LED + "select country, cast(sum(tpv) as double) DUM from ledger group by country order by country")
def _(spark, folder):
    return star.ledger(spark, folder).groupBy("country").agg(F.sum("tpv").alias("DUM")).orderBy("country")


@query("u1_union_by_name", Q.with_(Q.LEDGER, Q.REGISTRATIONS) + f"""select user_id, null trxn_id, trxn_type, country, {Q.stamp('signup_datetime')} signup_datetime from registrations
 union all select user_id, trxn_id, 'activate', null, null from ledger where trxn_type = 'open'""")
def _(spark, folder):
    steps = star.registrations(spark, folder).select("user_id", "trxn_type", "country", "signup_datetime")
    opened = L.activations(star.ledger(spark, folder)).drop("trxn_datetime")
    return steps.unionByName(opened, allowMissingColumns=True)


@query("u2_union_all", Q.with_(Q.LEDGER, Q.REGISTRATIONS) + "select user_id, trxn_type from ledger union all select user_id, trxn_type from registrations")
def _(spark, folder):
    return star.ledger(spark, folder).select("user_id", "trxn_type").unionByName(star.registrations(spark, folder).select("user_id", "trxn_type"))


@query("u3_set_difference", FEA + f", s as (select distinct 'ACgPwr' || cast(least(floor(AvgChargePower / 100), 9) as int) SubSegment from features) select SubSegment from s where SubSegment not in ('ACgPwr0','ACgPwr3')")
def _(spark, folder):
    label = F.concat(F.lit("ACgPwr"), F.least(F.floor(F.col("AvgChargePower") / 100), F.lit(9)).cast("int").cast("string"))
    return Seg.unassigned(features(spark, folder).select(label.alias("SubSegment")), {"ACgPwr0": "Low", "ACgPwr3": "Mid"})


# ---------------------------------------------------------------- scalar functions

@query("f1_arithmetic", SES + "select TransactionId, TotalEnergy + MaxPower a, TotalEnergy - MaxPower s, TotalEnergy * 0.001 m, TotalEnergy / ConnectedTime d from sessions")
def _(spark, folder):
    e, p = F.col("TotalEnergy"), F.col("MaxPower")
    return star.sessions(spark, folder).select("TransactionId", (e + p).alias("a"), (e - p).alias("s"), (e * 0.001).alias("m"), ratio(e, F.col("ConnectedTime")).alias("d"))


@query("f2_log1p", SES + f"select TransactionId, {Q.r('ln(1 + ConnectedTimeRC)')} x from sessions")
def _(spark, folder):
    return S.clean_sessions(star.sessions(spark, folder)).select("TransactionId", round_half_up(F.log1p("ConnectedTimeRC"), 6).alias("x"))


@query("f3_signed_log10", LED + f"select trxn_id, {Q.r('case when tpv > 0 then log10(cast(tpv as double)) when tpv < 0 then -log10(cast(-tpv as double)) end')} x from ledger")
def _(spark, folder):
    v = F.col("tpv").cast("double")
    return star.ledger(spark, folder).select("trxn_id", round_half_up(F.when(v > 0, F.log10(v)).when(v < 0, -F.log10(-v)), 6).alias("x"))


@query("f4_abs", LED + "select trxn_id, cast(abs(tpv) as double) x from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", F.abs("tpv").alias("x"))


@query("f5_round", SES + f"select TransactionId, {Q.r('MaxPower', 1)} r1, {Q.r('MaxPower', 2)} r2 from sessions")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", round_half_up(F.col("MaxPower"), 1).alias("r1"), round_half_up(F.col("MaxPower"), 2).alias("r2"))


@query("f6_clip", SES + "select TransactionId, least(greatest(TotalEnergy, 10), 50) fixed, least(ChargeTime, ConnectedTime) against from sessions")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", Fl.clip(F.col("TotalEnergy"), 10.0, 50.0).alias("fixed"), F.least("ChargeTime", "ConnectedTime").alias("against"))


@query("f7_fill_null", Q.with_(Q.LEDGER, NULLED_SQL) + "select trxn_id, coalesce(svc, 'unknown') service from nulled")
def _(spark, folder):
    return _nulled(spark, folder).na.fill("unknown", ["service"]).select("trxn_id", "service")


@query("f8_zero_for_undefined", ENR + f"select trxn_id, coalesce({Q.ratio('balance', 'account_count')}, 0) per_account from enriched")
def _(spark, folder):
    share = ratio(F.col("balance"), F.col("account_count"))
    return L.enrich_ledger(star.ledger(spark, folder)).select("trxn_id", F.coalesce(share, F.lit(0.0)).alias("per_account"))


@query("f9_is_null", Q.with_(Q.LEDGER, NULLED_SQL) + "select trxn_id, svc is null missing from nulled")
def _(spark, folder):
    return _nulled(spark, folder).select("trxn_id", F.col("service").isNull().alias("missing"))


@query("f10_cast", LED + "select trxn_id, cast(user_id as varchar) text, cast(balance as double) number from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", F.col("user_id").cast("string").alias("text"), F.col("balance").cast("double").alias("number"))


PERIODS = {"q": "Quarterly", "m": "Monthly", "w": "Weekly", "d": "Daily"}


@query("f11_truncate", LED + "select trxn_id, " + ", ".join(Q.label(f"date_trunc('{Q.TRUNC[p]}', acc_maturity_datetime)") + f" {c}" for c, p in PERIODS.items()) + " from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", *[period_start("acc_maturity_datetime", p).alias(c) for c, p in PERIODS.items()])


@query("f12_period_label", SES + f"select TransactionId, {Q.label('UTCTransactionStart')} \"day\" from sessions")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", period_label("UTCTransactionStart").alias("day"))


@query("f13_zones", Q.with_(Q.LEDGER) + f"select trxn_id, {Q.stamp("acc_maturity_datetime at time zone 'UTC' at time zone 'CET'")} local from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", utc_to_local(F.col("acc_maturity_datetime")).alias("local"))


@query("f14_add_hours", SES + f"select TransactionId, {Q.stamp('UTCTransactionStart + to_seconds(cast(floor(ChargeTime * 3600) as bigint))')} stop from sessions")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", plus_seconds(F.col("UTCTransactionStart"), F.floor(F.col("ChargeTime") * 3600)).alias("stop"))


@query("f15_durations", REG + "select user_id, trxn_type, datediff('second', signup_datetime, trxn_datetime) as \"seconds\", datediff('second', signup_datetime, trxn_datetime) // 3600 as \"hours\" from registrations")
def _(spark, folder):
    a, b = F.col("signup_datetime"), F.col("trxn_datetime")
    return star.registrations(spark, folder).select("user_id", "trxn_type", whole_seconds(a, b).alias("seconds"), whole_hours(a, b).alias("hours"))


@query("f16_date_parts", LED + f"select trxn_id, {Q.label('trxn_datetime')} \"day\", year(trxn_datetime) \"year\" from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", F.to_date("trxn_datetime").alias("day"), F.year("trxn_datetime").alias("year"))


@query("f17_year_range", LED + "select unnest(generate_series(min(year(trxn_datetime)), max(year(acc_maturity_datetime)))) \"year\" from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select(
        F.explode(F.sequence(F.min(F.year("trxn_datetime")), F.max(F.year("acc_maturity_datetime")))).alias("year"))


@query("f18_concat", Q.with_(Q.LEDGER, NULLED_SQL) + "select trxn_id, channel || '_' || svc label from nulled")
def _(spark, folder):
    return _nulled(spark, folder).select("trxn_id", F.concat("channel", F.lit("_"), "service").alias("label"))


@query("f19_short_number", LED + f""", x as (select trxn_id, cast(tpv as double) v from ledger),
 y as (select *, length(printf('%.0f', floor(v + 0.5))) n from x),
 z as (select *, least((n - 1) // 3, 3) m, 2 - (n - 1) % 3 p, v * pow(cast(0.001 as double), least((n - 1) // 3, 3)) s from y),
 t as (select *, case p when 0 then printf('%.0f', floor(s + 0.5)) when 1 then printf('%.1f', {Q.r('s', 1)}) else printf('%.2f', {Q.r('s', 2)}) end txt from z)
 select trxn_id, case when length(txt) >= 3 then txt when v < 0 then '-' || lpad(substr(txt, 2), 2, '0') else lpad(txt, 3, '0') end
 || case m when 0 then '' when 1 then 'K' when 2 then 'M' else 'B' end shown from t""")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", short_number(F.col("tpv")).alias("shown"))


@query("f20_right_closed_bins", SES + "select TransactionId, 1 + cast(u > 0.25 as int) + cast(u > 0.5 as int) + cast(u > 0.75 as int) bin from (select TransactionId, ChargeTime / 15 u from sessions)")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", right_closed_bin(F.col("ChargeTime") / 15, 4).alias("bin"))


@query("f21_horizontal_extremes", SES + f"select TransactionId, least(ConnectedTime, ChargeTime, MaxPower) low, greatest(ConnectedTime, ChargeTime, MaxPower) high from sessions")
def _(spark, folder):
    three = ["ConnectedTime", "ChargeTime", "MaxPower"]
    return star.sessions(spark, folder).select("TransactionId", F.least(*three).alias("low"), F.greatest(*three).alias("high"))


@query("f22_struct", LED + "select user_id, arg_max(trxn_type, {'a': trxn_datetime, 'b': trxn_id}) trxn_type, arg_max(service, {'a': trxn_datetime, 'b': trxn_id}) service from ledger group by 1")
def _(spark, folder):
    both = F.max_by(F.struct("trxn_type", "service"), F.struct(*L.LEDGER_ORDER)).alias("last")
    return star.ledger(spark, folder).groupBy("user_id").agg(both).select("user_id", "last.*")


@query("f23_dict_lookup", LED + "select trxn_id, case trxn_type when 'open' then 1 when 'cross-open' then 1 when 'renew' then 2 when 'mature' then 3 when 'break' then 3 when 're-open' then 4 end place from ledger")
def _(spark, folder):
    return star.ledger(spark, folder).select("trxn_id", lookup(F.col("trxn_type"), Fl.SERVICE_LEVELS).alias("place"))


# ---------------------------------------------------------------- time series and calendar

@query("t1_tumbling_window", Q.with_(Q.FEATURES, Q.CHANGES) + f"select {Q.stamp('UTCDatetime')} UTCDatetime, AvgChargePower_Mean, AvgChargePower_Max, AvgChargePower_Min from buckets")
def _(spark, folder):
    return P.bucket_power(P.power_changes(features(spark, folder))).drop("AvgChargeVolume")


@query("t2_upsample", SES + f"""select {Q.stamp('g')} UTCDatetime from (select unnest(generate_series(min(b), max(b), interval 5 minutes)) g
 from (select time_bucket(interval 5 minutes, UTCTransactionStart) b from sessions))""")
def _(spark, folder):
    starts = star.sessions(spark, folder).select(F.window("UTCTransactionStart", P.BUCKET)["start"].alias("UTCDatetime"))
    return P.regular_grid(starts)


@query("t3_business_days", Q.with_(Q.SESSIONS, Q.HOLIDAYS, Q.CALENDAR) + f"select {Q.label('d')} \"day\" from business")
def _(spark, folder):
    return Cal.business_days(span(spark, folder), star.holidays(spark))


@query("t4_switch_points", Q.with_(Q.SESSIONS, Q.HOLIDAYS, Q.CALENDAR) + f"select {Q.stamp('UTCDatetime')} UTCDatetime, Peakhour from calendar order by 1")
def _(spark, folder):
    return Cal.peak_calendar(span(spark, folder), star.holidays(spark)).orderBy("UTCDatetime")


@query("t5_next_opening", Q.with_(Q.SESSIONS, Q.HOLIDAYS, Q.CALENDAR) + f"""select {Q.label('d')} "day", {Q.stamp('(select min(o.d) from open_days o where o.d >= days.d) + interval 7 hours')} opening
 from days, span where d <= cast(stop as date)""")
def _(spark, folder):
    return Cal.next_opening(span(spark, folder), star.holidays(spark))


@query("t6_peak_overlap", FEA + "select TransactionId, PeakConnectedTime from features0")
def _(spark, folder):
    return S.peak_connected_hours(S.clean_sessions(star.sessions(spark, folder)), star.holidays(spark)).select("TransactionId", "PeakConnectedTime")


@query("t7_holiday_sessions", Q.with_(Q.SESSIONS, Q.HOLIDAYS) + f"select {Q.label('date')} date, count(*) n from sessions join holidays on cast(CETTransactionStart as date) = date group by date")
def _(spark, folder):
    started = S.clean_sessions(star.sessions(spark, folder)).select(F.to_date("CETTransactionStart").alias("date"))
    return started.join(star.holidays(spark), "date").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- clustering

@query("m1_kmeans_centers", SES + _facts_sql(3, ["TotalEnergy"], "sessions"))
def _(spark, folder):
    rows = star.sessions(spark, folder)
    centers, _ = Cl.kmeans_centers(Cl.feature_matrix(rows, ["TotalEnergy"]), 3)
    return _facts(rows.withColumn("SubSegment", Cl.group_label(Cl.nearest_center(["TotalEnergy"], centers))), ["TotalEnergy"])


@query("m2_agglomerative", Q.recursive(Q.with_(Q.SESSIONS, Q.ward("sessions", ["ConnectedTime"], 4))))
def _(spark, folder):
    return _ward_groups(Cl.hierarchical_segments(star.sessions(spark, folder), ["ConnectedTime"], 4), ["ConnectedTime"])


@query("m3_feature_matrix", SES + "select TotalEnergy, ConnectedTime, MaxPower from sessions")
def _(spark, folder):
    return Cl.feature_matrix(star.sessions(spark, folder), ["TotalEnergy", "ConnectedTime", "MaxPower"])


@query("m4_group_label", SES + "select TransactionId, 'Grp' || (TransactionId % 4) SubSegment from sessions")
def _(spark, folder):
    return star.sessions(spark, folder).select("TransactionId", Cl.group_label(F.col("TransactionId") % 4).alias("SubSegment"))
