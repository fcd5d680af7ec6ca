"""Operators on small frames with exact values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.functions.kernels import average_rank, correlation, lroll, normal_cdf, roll
from panelforge.operators import actions, calendar, detect, graphs, recursive, runs, select
from panelforge.operators.asof import asof_join

D = dt.date


def day(n):
    return D(2020, 1, 1) + dt.timedelta(days=n)


def bars(spark, values, code=1):
    return spark.createDataFrame([(code, day(i), float(v)) for i, v in enumerate(values)], "code long, date date, close double")


def test_asof_takes_the_last_record_and_never_a_later_one(spark):
    left = spark.createDataFrame([(1, day(5)), (1, day(2)), (2, day(9))], "code long, date date")
    right = spark.createDataFrame([(1, day(1), "a"), (1, day(5), "b"), (1, day(6), "c")], "code long, date date, v string")
    got = {(r.code, r.date): r.v for r in asof_join(left, right, ["code"], "date", ["v"]).collect()}
    assert got == {(1, day(5)): "b", (1, day(2)): "a", (2, day(9)): None}
    strict = {(r.code, r.date): r.v for r in asof_join(left, right, ["code"], "date", ["v"], strict=True).collect()}
    assert strict[(1, day(5))] == "a"
    forward = {(r.code, r.date): r.v for r in asof_join(left, right, ["code"], "date", ["v"], forward=True).collect()}
    assert forward == {(1, day(5)): "b", (1, day(2)): "b", (2, day(9)): None}


def test_published_on_friday_before_a_holiday_is_visible_on_tuesday(spark):
    days = [D(2024, 2, 8), D(2024, 2, 9), D(2024, 2, 13)]
    cal = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, idx int")
    records = spark.createDataFrame([(D(2024, 2, 9),)], "published date")
    assert calendar.next_business_day(records, "published", cal, "n").first()["n"] == D(2024, 2, 13)


def test_windows_do_not_reach_into_another_code(spark):
    both = bars(spark, [1, 2, 3]).unionByName(bars(spark, [10, 20, 30], code=2))
    got = {(r.code, r.date): r.m for r in both.select("code", "date", lroll(F.avg, "close", 2, 1).alias("m")).collect()}
    assert got[(2, day(0))] is None and got[(2, day(2))] == 15.0 and got[(1, day(1))] == 1.0


def test_unsorted_input_gives_the_same_windows(spark):
    b = bars(spark, [3, 1, 2, 5, 4])
    f = lambda x: sorted((r.date, r.m) for r in x.select("date", roll(F.sum, "close", 3).alias("m")).collect())
    order = lambda rows: [(d, m) for d, m in rows]
    key = lambda r: r[0]
    one = sorted(((r.date, r.m) for r in b.select("date", roll(F.sum, "close", 3).alias("m")).collect()), key=key)
    two = sorted(((r.date, r.m) for r in b.orderBy(F.desc("date")).select("date", roll(F.sum, "close", 3).alias("m")).collect()), key=key)
    assert order(one) == order(two) and [m for _, m in one] == [None, None, 6.0, 8.0, 11.0]


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None)], "k int, x double")
    assert sorted((r.x or 0, r.r or 0) for r in df.select("x", average_rank("x", "k").alias("r")).collect()) == [(0, 0), (1.0, 1.0), (5.0, 2.5), (5.0, 2.5)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 3.0)], "x double, y double")
    assert df.agg(correlation("x", "y").alias("c")).first()["c"] is None


def test_normal_cdf(spark):
    row = spark.range(1).select(normal_cdf(F.lit(0.0)).alias("a"), normal_cdf(F.lit(1.96)).alias("b"), normal_cdf(F.lit(-1.96)).alias("c")).first()
    assert row.a == pytest.approx(0.5, abs=1e-6) and row.b == pytest.approx(0.9750021, abs=1e-6) and row.c == pytest.approx(0.0249979, abs=1e-6)


def test_exponential_mean_starts_at_the_first_value(spark):
    got = [r.e for r in recursive.smooth(bars(spark, [1, 2, 3]), {"e": ("close", 0.5)}).orderBy("date").collect()]
    assert got == [1.0, 1.5, 2.25]


def test_islands(spark):
    got = [r.island for r in runs.islands(bars(spark, [1, 1, 2, 2, 1]), "code", "date", F.col("close")).orderBy("date").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_splits_before_the_action_date_are_adjusted(spark):
    act = spark.createDataFrame([(1, day(2), 2.0)], "code long, date date, ratio double")
    b = bars(spark, [10, 10, 5, 5]).withColumn("volume", F.lit(100.0))
    assert [r.close for r in actions.adjusted(b, act).orderBy("date").collect()] == [5.0, 5.0, 5.0, 5.0]


def test_global_rank_equals_a_sorted_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 5, 3, 2, 2, 9)], "x double")
    got = sorted((r.x, r.r) for r in select.global_rank(df, "x", "r", slices=3).collect())
    assert got == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0), (5.0, 5.5), (5.0, 5.5), (9.0, 7.0)]


def edges(spark, pairs):
    return spark.createDataFrame([(1, a, b, 9, 0.5) for a, b in pairs], "win int, src long, dst long, n long, w double")


def test_components_cores_and_ranks(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (7, 8)])
    assert {r.code: r.label for r in graphs.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert {r.code: r.core for r in graphs.core_numbers(e).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 7: 1, 8: 1}
    ranks = {r.code: r["rank"] for r in graphs.pagerank(e, 40).collect()}
    n, d = 6, 0.85
    near = {1: [2, 3], 2: [1, 3], 3: [1, 2, 4], 4: [3], 7: [8], 8: [7]}
    expected = dict.fromkeys(near, 1 / n)
    for _ in range(40):
        expected = {k: (1 - d) / n + d * sum(expected[j] / len(near[j]) for j in near[k]) for k in near}
    assert ranks == pytest.approx(expected, abs=1e-9)


def test_spectral_residual_finds_a_spike(spark):
    rows = [(1, i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), 10.0 if i == 20 else 1.0 + 0.01 * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, eid long, ts timestamp, x double")
    assert max(detect.spectral_residual(df).collect(), key=lambda r: r.score).eid == 20


def test_platt_separates(spark):
    df = spark.createDataFrame([(s / 10, int(s > 5)) for s in range(11)] + [(0.3, 1), (0.7, 0)], "score double, y int")
    assert detect.platt(df, 10).first()["slope"] > 0
