"""Hand-made cases for the deposit side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import right_closed_bin, short_number, signed_short_number
from tidemark.operators.cube import cube_distinct, cube_sums, weighted_rollup
from tidemark.operators.frames import densified, first_per, flag_extremes, percent_change, percent_of_total, running_balance
from tidemark.plans import cards, flows, kpis, ledger, views
from tidemark.plans.workspace import DepositWorkspace
from tidemark.sources import star_schema as star

SMALL = "/root/testdata/sf0.001"
LEDGER = ("user_id BIGINT, trxn_id BIGINT, trxn_type STRING, trxn_datetime TIMESTAMP_NTZ, "
          "acc_maturity_datetime TIMESTAMP_NTZ, balance MONEY, tpv MONEY, service STRING, country STRING, channel STRING")


def trxn(user, key, kind, day, due=None, balance="10", tpv="10", service="Fixed", country="A", channel="web"):
    return (user, key, kind, day, due, balance, tpv, service, country, channel)


def test_account_and_user_status(frame, rows):
    got = ledger.enrich_ledger(frame(
        LEDGER,
        trxn(1, 1, "open", "2024-01-01"), trxn(1, 2, "open", "2024-01-02"), trxn(1, 3, "break", "2024-01-03"),
        trxn(1, 4, "mature", "2024-01-04"), trxn(1, 5, "re-open", "2024-01-05"), trxn(1, 6, "renew", "2024-01-06", tpv="0")))
    assert rows(got, "trxn_id", "trxn_group", "atpv", "account_count", "user_status") == [
        (1, "gain", 10, 1, 1), (2, "gain", 10, 2, 0), (3, "lose", 10, 1, 0),
        (4, "lose", 10, 0, -1), (5, "gain", 10, 1, 1), (6, "gain", 10, 1, 0)]


def test_null_dimension_stays_apart_from_the_total(frame, rows):
    cells = frame("service STRING, date INT, v INT", ("x", 1, 1), (None, 1, 2), ("x", 1, 4), (None, 1, 8))
    assert rows(cube_sums(cells, ["service"], ["date"], {"v": F.sum("v")}), "service", "v") == [
        ("all", 15), ("unknown", 10), ("x", 5)]


def test_distinct_cube_equals_brute_force(spark):
    df = spark.range(3000).select(
        (F.col("id") % 40).alias("u"), (F.col("id") * 31 % 5).cast("string").alias("a"),
        (F.col("id") * 17 % 3).cast("string").alias("b"), (F.col("id") % 2).alias("p"))
    df = df.unionByName(df.withColumn("u", F.lit(7)))  # one id with more than half of the rows
    got = cube_distinct(df, ["a", "b"], ["p"], "u", "n")
    sets = [[F.col(c) for c in s] for s in (["a", "b", "p"], ["a", "p"], ["b", "p"], ["p"])]
    want = df.groupingSets(sets, "a", "b", "p").agg(F.count_distinct("u").alias("n")).na.fill("all", ["a", "b"])
    got = got.select("a", "b", "p", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_distinct_cube_moves_rows_once_and_cells_once(spark):
    df = spark.range(100).select((F.col("id") % 9).alias("u"), (F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 2).alias("p"))
    plan = cube_distinct(df, ["a"], ["p"], "u", "n")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len([line for line in exchanges if "(u#" in line]) == 2


def test_percent_change_rules(frame, rows):
    got = percent_change(frame("s STRING, d INT, v DOUBLE", ("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, None), ("a", 5, 10.0), ("b", 1, 2.0), ("b", 9, 3.0)), ["s"], ["d"], ["v"])
    # first row and after a zero: none; a null repeats the last value; a missing period is skipped
    assert [r.pct_change_v for r in got.orderBy("s", "d").collect()] == [None, None, 0.0, 100.0, None, 50.0]


def test_activation_without_registration_inherits_nothing(frame, rows):
    reg = frame("user_id BIGINT, trxn_datetime TIMESTAMP_NTZ, signup_datetime TIMESTAMP_NTZ, trxn_type STRING, country STRING, channel STRING, customer_acquisition_cost DOUBLE",
                (1, "2024-01-01", "2024-01-01", "signup", "A", "web", 3.0))
    got = ledger.registration_events(reg, frame(LEDGER, trxn(1, 5, "open", "2024-01-03"), trxn(2, 6, "open", "2024-01-04", country="B")))
    assert rows(got, "user_id", "trxn_type", "country", "customer_acquisition_cost")[1:] == [(1, "signup", "A", 3.0), (2, "activate", None, None)]
    assert rows(got, "user_id", "trxn_type", "country", "customer_acquisition_cost")[0] == (1, "activate", "A", 3.0)


def test_due_deposits(frame, rows):
    rows_ = [
        trxn(1, 1, "open", "2024-01-05", "2024-03-10", balance="100", tpv="100"),
        trxn(1, 2, "top_up", "2024-02-05", "2024-03-20", balance="50", tpv="50"),
        trxn(2, 3, "open", "2024-03-02", "2024-03-25", balance="7", tpv="7"),  # due in its own period
        trxn(2, 4, "open", "2024-02-02", None)]
    due = kpis.due_kpis(ledger.add_groups(frame(LEDGER, *rows_)), "Monthly")
    total = due.where((F.col("country") == "all") & (F.col("service") == "all") & (F.col("trxn_group") == "all") & (F.col("trxn_type") == "all"))
    assert rows(total, "mdate", "date", "DD", "T") == [(dt.date(2024, 3, 1), dt.date(2024, 2, 1), 150, 1)]


@pytest.mark.parametrize("value,text", [
    (0, "000#"), (7, "007#"), (999, "999#"), (1000, "1.00K#"), (1234567, "1.23M#"), (12_345_678_901_234, "12.3B#")])
def test_short_number(spark, value, text):
    got = spark.range(1).select(F.concat(short_number(F.lit(value), whole=F.lit(True)), F.lit("#"))).first()[0]
    # beyond the last suffix the number keeps growing in billions
    assert got == text or (value > 10**12 and got.endswith("B#"))


def test_short_number_signs(spark):
    got = spark.range(1).select(
        short_number(F.lit(7)), short_number(F.lit(-5)), short_number(F.lit(-123.0)), signed_short_number(F.lit(-12.34)),
        signed_short_number(F.lit(1200.0)), signed_short_number(F.lit(None).cast("double"))).first()
    assert list(got) == ["7.00", "-5.0", "-0.12K", "-12.3", "+1.20K", None]


def test_cards_cover_the_catalogue(spark):
    w = DepositWorkspace(star.ledger(spark, SMALL), star.registrations(spark, SMALL), star.market(spark, SMALL), "Quarterly")
    got = cards.kpi_cards(w.transactions, w.dues, w.acquisition, w.conversion, w.freq).collect()
    assert len(got) == len(cards.CATALOGUE)
    none = w.transactions.where("false")
    empty = cards.kpi_cards(none, w.dues.where("false"), w.acquisition.where("false"), w.conversion.where("false"), w.freq).collect()
    assert {r.status for r in empty} == {"No Record"} and {r.trend for r in empty} == {"No prev. stat"}
    total = w.transactions.where(views.level(country="all", service="all", trxn_group="all", trxn_type="all"))
    last = kpis.latest_period(total).first()
    assert last.DUM == star.ledger(spark, SMALL).agg(F.sum("tpv")).first()[0]
    w.close()


def test_flow_balance(frame, rows):
    steps = [trxn(u, u * 10 + i, k, f"2024-01-0{i + 1}") for u, kinds in ((1, ["open", "renew", "mature"]), (2, ["open", "renew"]), (3, ["open"])) for i, k in enumerate(kinds)]
    edges = flows.service_flow(frame(LEDGER, *steps))
    assert rows(edges, "source", "target", "len") == [
        ("open", "ongoing", 1), ("open", "renew", 2), ("renew", "mature", 1), ("renew", "ongoing", 1), ("web", "open", 3)]


def test_flow_keeps_negative_differences(frame, rows):
    edges = frame("source STRING, target STRING, len BIGINT", ("a", "verify", 1), ("verify", "b", 3), ("b", "a", 3))
    done = flows.complete_edges(edges, [], F.when(F.col("source") == "verify", "dropped"))
    assert ("verify", "dropped", -2) in rows(done, "source", "target", "len") and done.count() == 4


def test_market_classes(frame, rows):
    got = ledger.market_dim(frame("country STRING, population BIGINT", ("A", 30_000_000), ("B", 20_000_000), ("C", 7_000_000), ("D", 5_000_000)))
    assert rows(got, "country", "country_category") == [("A", "XBig"), ("B", "Big"), ("C", "Med"), ("D", "Small")]


def test_rollup_extremes_and_shares(frame, rows):
    cells = frame("a STRING, b STRING, v DOUBLE, w DOUBLE", ("x", "p", 1.0, 10.0), ("x", "q", 3.0, 2.0), ("y", "p", 4.0, 1.0))
    tree = weighted_rollup(cells, ["a", "b"], "v", "w", "root")
    assert rows(tree.where("level < 2"), "a", "v", "w", "share_of_root") == [("all", 8.0, 2.5, 100.0), ("x", 4.0, 4.0, 50.0), ("y", 4.0, 1.0, 50.0)]
    assert rows(percent_of_total(cells, ["v"]), "v") == [(12.5,), (37.5,), (50.0,)]
    assert rows(flag_extremes(cells, ["v"]).na.fill("-"), "v", "v_extreme") == [(1.0, "min"), (3.0, "-"), (4.0, "max")]
    assert rows(first_per(cells, ["a"], ["v"], last=True), "a", "v") == [("x", 3.0), ("y", 4.0)]


def test_value_on_a_bin_edge_goes_left(spark):
    got = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.5,), (1.0,)], "x DOUBLE").select(right_closed_bin(F.col("x"), 4))
    assert [r[0] for r in got.collect()] == [1, 1, 2, 2, 4]


def test_dense_frames_keep_balances_of_idle_segments(frame):
    cells = frame("s STRING, date DATE, U INT, TPV INT, A DOUBLE", ("a", "2024-01-01", 2, 5, 1.5), ("a", "2024-04-01", 1, -2, None), ("b", "2024-03-01", 4, 7, 2.0))
    dense = densified(cells, ["s"], "date", "1 month", ["U", "TPV"])
    rows = running_balance(dense, ["s"], ["date"], {"DUM": "TPV"}).orderBy("s", "date").collect()
    assert [(r.s, r.date.month, r.U, r.TPV, r.A, r.DUM) for r in rows] == [
        ("a", 1, 2, 5, 1.5, 5), ("a", 2, 0, 0, None, 5), ("a", 3, 0, 0, None, 5), ("a", 4, 1, -2, None, 3), ("b", 3, 4, 7, 2.0, 7), ("b", 4, 0, 0, None, 7)]
    assert densified(cells.limit(0), ["s"], "date", "1 month", ["U"]).count() == 0
