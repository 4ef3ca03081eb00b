"""Hand-made cases for the session side."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import agglomerate
from tidemark.operators.quantiles import exact_percentiles, values_at_ranks
from tidemark.plans import calendar, clusters, power, segments, sessions, stats
from tidemark.sources import star_schema as star

SMALL = "/root/testdata/sf0.001"
SESSION = "TransactionId BIGINT, UTCTransactionStart TIMESTAMP_NTZ, UTCTransactionStop TIMESTAMP_NTZ, ChargeTime DOUBLE, TotalEnergy DOUBLE"


@pytest.fixture(scope="module")
def features(spark):
    return sessions.prepare(star.sessions(spark, SMALL), star.holidays(spark)).persist()


def test_peak_hours_over_weekends_holidays_and_summer_time(frame, rows):
    got = sessions.peak_connected_hours(sessions.clean_sessions(frame(
        SESSION,
        (1, "2024-01-02 05:00", "2024-01-02 07:30", 1.0, 1.0),   # opening at 07:00 local = 06:00 UTC
        (2, "2024-01-01 05:00", "2024-01-02 07:00", 1.0, 1.0),   # holiday, then one hour of peak
        (3, "2024-01-05 20:00", "2024-01-08 07:00", 1.0, 1.0),   # Friday night to Monday: 2 + 1 hours
        (4, "2024-03-29 20:00", "2024-04-02 06:00", 1.0, 1.0),   # holidays around a weekend, then summer time
        (5, "2024-01-03 21:30", "2024-01-04 00:30", 1.0, 1.0),   # across local midnight
        (6, "2024-01-03 08:00", "2024-01-10 08:00", 1.0, 1.0),   # a whole week: 5 peak days
    )), frame("date DATE", ("2024-01-01",), ("2024-03-29",), ("2024-04-01",)))
    assert rows(got, "TransactionId", "PeakConnectedTime") == [(1, 1.5), (2, 1.0), (3, 3.0), (4, 1.0), (5, 0.5), (6, 80.0)]


def test_text_times_and_charge_clip(frame):
    got = sessions.clean_sessions(frame(
        "TransactionId BIGINT, UTCTransactionStart STRING, UTCTransactionStop STRING, ChargeTime DOUBLE",
        (1, "31/01/202423:30", "01/02/2024 00:30", 5.0), (2, "05/07/2024 10:00", "05/07/202412:00", 0.5))).orderBy("TransactionId").collect()
    assert got[0].UTCChargeStop == dt.datetime(2024, 2, 1, 0, 30) and got[0].ChargeTimeRC == 1.0
    assert got[1].CETTransactionStart == dt.datetime(2024, 7, 5, 12) and got[1].ChargeTimeRC == 0.5


def test_business_days_roll_past_the_end(frame, rows):
    span = frame("start TIMESTAMP_NTZ, stop TIMESTAMP_NTZ", ("2024-01-06 10:00", "2024-01-13 10:00"))
    got = rows(calendar.business_days(span, frame("date DATE", ("2024-01-15",), ("2024-01-10",))), "day")
    assert [d.day for (d,) in got] == [8, 9, 11, 12, 16]


def changes(spark, *rows):
    df = spark.createDataFrame([tuple(r) for r in rows], "t STRING, p DOUBLE, Point INT, TransactionId BIGINT")
    return df.select(F.col("t").cast("timestamp_ntz").alias("UTCDatetime"), F.col("p").cast(power.POWER).alias("AvgChargePowerChange"), "Point", "TransactionId")


def test_starts_precede_stops_of_one_instant(spark):
    got = power.bucket_power(changes(
        spark, ("2024-01-01 00:01", 5.0, 0, 1), ("2024-01-01 00:02", -5.0, 1, 1), ("2024-01-01 00:02", 3.0, 0, 2))).first()
    assert (got.AvgChargePower_Max, got.AvgChargePower_Min, got.AvgChargePower_Mean) == (8.0, 3.0, 16 / 3)


def test_power_curve_fills_gaps(spark, frame):
    switches = frame("UTCDatetime TIMESTAMP_NTZ, Peakhour INT", ("2024-01-02 00:00", 1), ("2024-01-03 01:00", 0))
    curve = power.power_curve(changes(spark, ("2024-01-01 23:58", 4.0, 0, 1), ("2024-01-03 00:31", -4.0, 1, 1)), switches)
    got = {r.UTCDatetime: r for r in curve.collect()}
    assert len(got) == 24 * 12 + 12 + 1 + 1  # 23:55 to 01:00 two days later
    assert got[dt.datetime(2024, 1, 2, 12)].AvgChargePower_Mean == 4.0 and got[dt.datetime(2024, 1, 1, 23, 55)].Peakhour == 0
    assert got[dt.datetime(2024, 1, 2, 12)].Peakhour == 1 and got[dt.datetime(2024, 1, 3, 0, 30)].AvgChargePower_Mean == 0.0
    assert got[dt.datetime(2024, 1, 3, 1)].AvgChargeVolume == 0.0 and got[dt.datetime(2024, 1, 3, 1)].Peakhour == 0


def test_heavy_buckets_do_not_change_the_curve(spark, features):
    moved = power.power_changes(features)
    # half of all changes at two instants of one bucket
    crowd = moved.withColumn("UTCDatetime", F.when(F.col("TransactionId") % 2 == 0, F.when(
        F.col("Point") == 0, F.lit("2024-01-05 10:01:00.5")).otherwise("2024-01-05 10:03:07").cast("timestamp_ntz")).otherwise(F.col("UTCDatetime")))
    crowd = crowd.withColumn("TransactionId", F.col("TransactionId") * 3_000_017).persist()
    got = {r.UTCDatetime: r for r in power.bucket_power(crowd).collect()}
    level, want = 0, {}
    for r in sorted(crowd.collect(), key=lambda r: (r.UTCDatetime, r.Point, r.TransactionId)):
        level += r.AvgChargePowerChange
        bucket = r.UTCDatetime.replace(minute=r.UTCDatetime.minute // 5 * 5, second=0, microsecond=0)
        want.setdefault(bucket, []).append(level)
    assert set(got) == set(want)
    for bucket, levels in want.items():
        row = got[bucket]
        assert (row.AvgChargePower_Max, row.AvgChargePower_Min) == (float(max(levels)), float(min(levels)))
        assert row.AvgChargePower_Mean == pytest.approx(float(sum(levels)) / len(levels))


def test_running_power_equals_plain_window(features):
    from pyspark.sql import Window

    moved = power.power_changes(features)
    w = Window.partitionBy(F.lit(1)).orderBy(*power.CHANGE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = moved.withColumn("AvgChargePower", F.sum("AvgChargePowerChange").over(w))
    got = power.running_power(moved).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    last = got.orderBy(F.desc("UTCDatetime"), F.desc("Point"), F.desc("TransactionId")).first()
    assert last.AvgChargePower == 0


def test_no_python_and_no_whole_frame_window_on_changes(spark):
    moved = spark.range(100).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("UTCDatetime"),
        F.col("id").cast(power.POWER).alias("AvgChargePowerChange"), F.lit(0).alias("Point"), F.col("id").alias("TransactionId"))
    plan = power.bucket_power(moved)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("SinglePartition") == 1  # the day totals


@pytest.mark.parametrize("column", ["ConnectedTime", "AvgChargePower", "TotalEnergy"])
def test_narrowed_percentiles_equal_built_in(features, column):
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    want = features.select(F.percentile(column, probs)).first()[0]
    got = exact_percentiles(features, [column, "MaxPower"], probs)
    assert got[column] == pytest.approx(want, rel=1e-12)


def test_ranks_with_a_crowded_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 5.0).otherwise(F.col("id") * 1.5).alias("v"))
    ordered = sorted(r.v for r in df.collect())
    ranks = [0, 333, 699, 700, 701, 999]
    assert values_at_ranks(df, "v", ranks) == {r: ordered[r] for r in ranks}


def test_ranks_of_extreme_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [inf, -inf, 1e308, -1e308, 5e-324, -5e-324, 0.0, -0.0, 1.0, -1.0, 3.5, inf]
    df = spark.createDataFrame([(v,) for v in [*values, nan, None]], "v double")
    ordered = sorted(values)
    assert values_at_ranks(df, "v", range(len(values))) == dict(enumerate(ordered))
    found = exact_percentiles(df, ["v"], [0.0, 0.5, 1.0])["v"]
    assert found == [-inf, ordered[5] / 2 + ordered[6] / 2, inf]
    assert exact_percentiles(df.where("isnan(v)"), ["v"], [0.5]) == {"v": [None]}


def test_rank_bins_equal_ranking_all_rows(features):
    n = features.count()
    for column, k in (("ConnectedTime", 3), ("TotalEnergy", 4), ("Utilization", 2), ("MaxPower", 1)):
        bin_ = segments.rank_bins(features, column, k)
        got = features.select(F.col(column).alias("v"), segments.tie_break().alias("t"), bin_.alias("bin")).collect()
        for rank, r in enumerate(sorted(got, key=lambda r: (r.v, r.t)), 1):
            assert r.bin == -(-rank * k // n)


def test_rank_share_follows_value_and_tie_break(features):
    got = segments.rank_share(features, "ConnectedTime").select(
        "ConnectedTime", segments.tie_break().alias("t"), "rank_share").collect()
    n = len(got)
    assert [r.rank_share for r in sorted(got)] == [i / n for i in range(1, n + 1)]


def test_box_by_group_equals_each_group_alone(features):
    rows = features.withColumn("label", F.when(F.col("TransactionId") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("TransactionId") % 7)))
    got = {r.label: tuple(r)[1:] for r in stats.box_by_group(rows, "label", "TotalEnergy").collect()}
    assert set(got) == {f"g{i}" for i in range(1, 7)}
    for label in ("g1", "g6"):
        assert got[label] == pytest.approx(tuple(stats.box_statistics(rows.where(F.col("label") == label), ["TotalEnergy"]).first())[1:])
    assert stats.box_by_group(rows.where("label is null"), "label", "TotalEnergy").count() == 0


def test_as_many_groups_as_asked_for(spark):
    few = spark.range(20_000).select("id", F.when(F.col("id") < 4, F.col("id").cast("double")).otherwise(9.0).alias("a"))
    assert clusters.kmeans_segments(few, ["a"], 4, restarts=3).select("SubSegment").distinct().count() == 4
    assert clusters.kmeans_segments(few, ["a"], 9, restarts=3).select("SubSegment").distinct().count() == 5
    none = few.withColumn("a", F.lit(None).cast("double"))
    for label in (clusters.kmeans_segments(none, ["a"], 3), clusters.hierarchical_segments(none, ["a"], 3), clusters.kmeans_segments(few.limit(0), ["a"], 3)):
        assert label.where("SubSegment is not null").isEmpty()


def test_constant_column_and_missing_value(frame, rows):
    df = frame("TransactionId BIGINT, a DOUBLE, b DOUBLE", (1, 3.0, 0.0), (2, 3.0, 10.0), (3, 3.0, None))
    got = segments.fixed_segments(df, {"a": 4, "b": 2})
    assert sorted((r.TransactionId, r.SubSegment) for r in got.collect()) == [(1, "a1_b1"), (2, "a1_b2"), (3, None)]


def test_profile_and_regrouping(features):
    labelled = segments.fixed_segments(features, {"TotalEnergy": 2, "Utilization": 3})
    profile = segments.segment_profile(labelled).toPandas()
    assert profile.SegmentShare.sum() == pytest.approx(100) and profile.EnergyShare.sum() == pytest.approx(100)
    some = profile.SubSegment.tolist()
    merged = segments.regroup_segments(labelled, {some[0]: "One", some[1]: "One"}).toPandas()
    assert set(merged.Segment) == {"One", *some[2:]}
    assert [r[0] for r in segments.unassigned(labelled, {some[0]: "One"}).collect()] == some[1:]
    assert segments.regroup_segments(labelled, {}).count() == len(some)


def test_peak_hours_within_connected_hours(features):
    assert features.where("PeakConnectedTime > ConnectedTimeRC + 1e-9 or PeakConnectedTime < 0").isEmpty()


def test_box_and_describe(frame):
    df = frame("x DOUBLE", *[(float(v),) for v in [1, 2, 3, 4, 100]])
    box = stats.box_statistics(df, ["x"]).first()
    assert (box.q1, box.median, box.q3, box.low, box.high) == (2.0, 3.0, 4.0, 1.0, 4.0)
    assert [r.statistic for r in stats.describe_features(df, ["x"]).collect()] == ["mean", "std", "min", "5%", "50%", "95%", "max"]
    constant = stats.histograms(frame("x DOUBLE", (2.0,), (2.0,)), ["x"], 10).collect()
    assert [(r.bin, r.n, r.pct) for r in constant] == [(0, 2, 100.0)]


def test_levels_are_weighted_by_how_long_they_hold(frame, rows):
    """Two steps of one instant, an empty bucket, a change on a bucket's border, levels from before."""
    at = lambda t: f"2024-01-01 {t}"
    changes = frame(
        "UTCDatetime TIMESTAMP_NTZ, AvgChargePowerChange DOUBLE, Point INT, TransactionId INT",
        (at("10:01:00"), 100.0, 0, 1), (at("10:02:30.500000"), 60.0, 0, 2), (at("10:02:30.500000"), -100.0, 1, 1), (at("10:15:00"), 40.0, 0, 3),
        (at("10:17:00"), -60.0, 1, 2), (at("10:17:00"), 500.0, 0, 4), (at("10:17:00"), -500.0, 1, 4), (at("10:22:00"), -40.0, 1, 3), (None, 1.0, 0, 9))
    changes = changes.withColumn("AvgChargePowerChange", F.col("AvgChargePowerChange").cast(power.POWER))
    calendar = frame("UTCDatetime TIMESTAMP_NTZ, Peakhour INT", (at("10:10:00"), 1), (at("10:30:00"), 0))
    got = power.level_curve(changes, calendar).orderBy("UTCDatetime").collect()
    assert [r.UTCDatetime.strftime("%H:%M") for r in got] == ["10:00", "10:05", "10:10", "10:15", "10:20", "10:25", "10:30"]
    assert [(r.AvgChargePower_Max, r.AvgChargePower_Min, r.Level) for r in got] == [
        (100.0, 0.0, 60.0), (60.0, 60.0, 60.0), (60.0, 60.0, 60.0), (100.0, 40.0, 40.0), (40.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    means = [(100 * 90.5 + 60 * 149.5) / 300, 60, 60, (100 * 120 + 40 * 180) / 300, 40 * 120 / 300, 0, 0]
    assert np.allclose([r.AvgChargePower_Mean for r in got], means)
    assert [r.Peakhour for r in got] == [0, 0, 1, 1, 1, 1, 0]


def test_volumes_of_levels_are_the_energy_of_sessions(spark, features):
    span = calendar.interval(features)
    volume = power.session_level_curve(features, span, star.holidays(spark)).agg(F.sum("AvgChargeVolume")).first()[0]
    hours = F.timestamp_diff("MICROSECOND", "UTCTransactionStart", "UTCChargeStop") / 3.6e9
    energy = features.agg(F.sum(F.col("AvgChargePower") * hours)).first()[0]
    assert np.isclose(volume / 1000, energy, rtol=1e-9)


def test_kmeans_restarts_never_hurt_and_labels_match(features):
    matrix = clusters.feature_matrix(features, ["TotalEnergy", "ConnectedTime"])
    _, one = clusters.kmeans_centers(matrix, 4, restarts=1)
    centers, many = clusters.kmeans_centers(matrix, 4, restarts=8)
    assert many <= one * (1 + 1e-9)
    x = matrix.toPandas().to_numpy()
    cost = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert cost <= many * (1 + 1e-9)
    labelled = clusters.kmeans_segments(features, ["TotalEnergy", "ConnectedTime"], 4, restarts=3)
    assert labelled.select("SubSegment").distinct().count() == 4


def test_kmeans_equals_plain_passes_from_the_same_starts(features, monkeypatch):
    """Lloyd's passes over all rows give the same centers; few rows are looked at in each pass."""
    monkeypatch.setattr(clusters, "BOXES", 256)
    matrix = clusters.feature_matrix(features.unionByName(features.where("TransactionId % 3 = 0")), ["TotalEnergy", "ConnectedTime"])
    x, report = matrix.toPandas().to_numpy(), []
    got, cost = clusters.kmeans_centers(matrix, 4, restarts=1, report=report)
    plain = clusters._starts(matrix, 1, 4, 7)[0]
    limit = clusters.TOLERANCE * x.var(axis=0).mean()
    for _ in range(len(report)):
        gap = ((x[:, None] - plain) ** 2).sum(axis=2)
        near = gap.argmin(axis=1)
        moved = np.array([x[near == i].mean(axis=0) for i in range(4)])
        shift, plain = ((moved - plain) ** 2).sum(), moved
    assert shift <= limit
    assert np.allclose(got, plain, rtol=1e-9)
    assert np.isclose(cost, gap.min(axis=1).sum())
    assert all(compared < 0.5 * whole for whole, compared in report)


def test_decided_boxes_have_one_nearest_center():
    draw = np.random.default_rng(4)
    low = draw.uniform(0, 10, (200, 3))
    high = low + draw.uniform(0, 2, (200, 3)) * draw.integers(0, 2, (200, 3))
    centers = draw.uniform(0, 10, (5, 4, 3))
    owner = clusters._decided(low, high, centers)
    assert (owner >= 0).mean() > 0.2
    for at in np.linspace(0, 1, 5)[np.array(np.meshgrid(*[range(5)] * 3)).reshape(3, -1).T]:
        gap = (((low + (high - low) * at)[None, :, None] - centers[:, None]) ** 2).sum(axis=3)
        assert ((owner < 0) | (owner == gap.argmin(axis=2))).all()


def ward_by_definition(x, k):
    """Merge the two groups whose union adds least to the sum of squares."""
    def spread(rows):
        p = x[rows]
        return ((p - p.mean(axis=0)) ** 2).sum()

    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        pairs = [(spread(a + b) - spread(a) - spread(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_ward_merge_equals_definition():
    x = np.random.default_rng(3).normal(size=(25, 2))
    labels = clusters.ward_merge(x, np.ones(25), 4)
    got = sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in range(4))
    assert got == ward_by_definition(x, 4)


def test_hierarchical_exact_on_few_points(spark):
    x = np.random.default_rng(5).normal(size=(30, 2)).round(3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "TransactionId BIGINT, a DOUBLE, b DOUBLE")
    got = clusters.hierarchical_segments(df, ["a", "b"], 3).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.SubSegment, []).append(r.TransactionId)
    assert sorted(sorted(g) for g in groups.values()) == ward_by_definition(x, 3)
    assert clusters.hierarchical_segments(df, ["a", "b"], 3, at_once=20).select("SubSegment").distinct().count() == 3


def ward_by_pairs(x, w, k):
    """The closest pair of all merges, again and again."""
    x, w, members = x.copy(), w.copy(), [[i] for i in range(len(x))]
    gap = ((x[:, None] - x) ** 2).sum(axis=2) * (w[:, None] * w / (w[:, None] + w))
    np.fill_diagonal(gap, np.inf)
    for _ in range(len(x) - k):
        a, b = sorted(np.unravel_index(gap.argmin(), gap.shape))
        x[a], w[a] = (x[a] * w[a] + x[b] * w[b]) / (w[a] + w[b]), w[a] + w[b]
        members[a] += members[b]
        members[b], w[b] = [], 1.0
        gap[b] = gap[:, b] = np.inf
        alive = np.array([bool(m) for m in members])
        gap[a] = np.where(alive, ((x - x[a]) ** 2).sum(axis=1) * (w * w[a] / (w + w[a])), np.inf)
        gap[a, a] = np.inf
        gap[:, a] = gap[a]
    return sorted(sorted(m) for m in members if m)


@pytest.mark.parametrize(("width", "first_limit"), [(1, 1 / 2000), (2, 1 / 2000), (3, 1 / 200), (2, 0.5)])
def test_ward_in_passes_equals_the_closest_pair(spark, width, first_limit):
    """2000 points in clumps of several densities and far strays, some heavy, in boxes of few points; a first
    limit that is too high is lowered."""
    draw = np.random.default_rng(width)
    x = np.concatenate([draw.normal(size=(1200, width)), 8 + 0.3 * draw.normal(size=(770, width)), 40 * draw.normal(size=(30, width))]).round(6)
    times = np.where(np.arange(2000) % 97 == 0, 40, 1)
    x, first = np.unique(x, axis=0, return_index=True)
    times = times[first]
    columns = [f"v{i}" for i in range(width)]
    df = spark.createDataFrame(pd.DataFrame(np.repeat(x, times, axis=0), columns=columns))
    for k in (2, 6):
        got = agglomerate.ward_labels(df, k, at_once=150, cell=100, first_limit=first_limit).toPandas().sort_values(columns)
        assert np.array_equal(got[columns].to_numpy(), x)
        groups = [np.flatnonzero(got["label"].to_numpy() == c).tolist() for c in range(k)]
        assert sorted(groups) == ward_by_pairs(x, times.astype(float), k)
        means = [np.average(x[g], axis=0, weights=times[g]).tolist() for g in groups]
        assert means == sorted(means)


def test_ward_ties_and_few_points(spark):
    line = spark.createDataFrame([(float(i),) for i in range(40)], "a DOUBLE")
    sizes = agglomerate.ward_labels(line, 5, at_once=10, cell=8).groupBy("label").count().collect()
    assert len(sizes) == 5 and sum(r["count"] for r in sizes) == 40
    assert agglomerate.ward_labels(line.limit(3), 5).count() == 3
    assert agglomerate.ward_labels(line.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(1, 1.0, "x"), (1, 1.0, "y"), (2, None, "z"), (3, float("nan"), "n"), (4, 9.0, None), (5, -0.0, ""), (6, 0.0, "")], "id INT, a DOUBLE, SubSegment STRING")
    found = {(r.id, r.SubSegment) for r in clusters.hierarchical_segments(odd, ["a"], 2).collect()}
    assert found == {(1, "Grp0"), (2, None), (3, None), (4, "Grp1"), (5, "Grp0"), (6, "Grp0")}
