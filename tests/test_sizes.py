"""Sums, rows and plans that must not fail or grow where tables do."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.kernels import rank01
from panelforge.operators import graphs, recursive
from panelforge.plans import registry
from panelforge.sources import files, tables


def test_checksums_beyond_64_bits_keep_their_last_bits(spark, sf, monkeypatch):
    sums = {199701: 5, 199702: 2**63 - 1, 199703: 2**63, 199704: 3 * 2**64 + 7}
    index = spark.createDataFrame([(1, None, None, Decimal(v), "x", k) for k, v in sums.items()], "rows long, first date, last date, checksum decimal(38,0), schema string, yyyymm int")
    monkeypatch.setattr(files, "read_index", lambda spark, path: index)
    got = {r.yyyymm: r.checksum for r in registry.queries()["s5_shard_index"](spark, sf).collect()}
    assert got == {199701: 5, 199702: 2**63 - 1, 199703: -(2**63), 199704: 7}


def test_recursions_send_their_inputs_only_to_python(spark):
    x = spark.createDataFrame([(c, t, float(c * t), "text") for c in range(1, 4) for t in (3, 1, 2)], "code long, date long, close double, other string").repartition("code")
    s = recursive.smooth(x, {"e": ("close", 0.5), "f": (lambda p: p["e"] * 2, 0.5)})
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1
    got = {(r.code, r.date): (r.other, r.e, r.f) for r in s.collect()}
    assert got == {(c, t): ("text", c * e, c * f) for c in range(1, 4) for t, e, f in ((1, 1.0, 2.0), (2, 1.5, 2.5), (3, 2.25, 3.5))}


def test_a_rank_takes_one_sort_and_one_window(spark):
    x = [5.0, None, 1.0, 5.0, 0.0, -0.0, 7.0, float("nan")]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, 8, 3.0), (3, 9, None)], "code long, i long, x double").repartition("code")
    ranked = df.withColumn("r", rank01("x", "code"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Window [") == 1
    got = {r.i: r.r for r in ranked.collect()}
    assert got == {0: 3.5 / 6, 1: None, 2: 2 / 6, 3: 3.5 / 6, 4: 0.5 / 6, 5: 0.5 / 6, 6: 5 / 6, 7: 1.0, 8: 0.5, 9: None}


@pytest.mark.parametrize("name", ["w11_rolling_quantiles", "w15_robust_z"])
def test_rolling_quantiles_keep_an_ordered_frame(spark, sf, name):
    assert "Window [" not in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_rolling_quantiles_equal_plain_quantiles_of_each_frame(spark):
    x = [3.0, None, 3.0, -1.0, 8.0, 2.5, None, None, None, 4.0, 4.0]
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(x)], "code long, date long, x double").repartition("code")
    specs = {"a": ("x", 4, 2, 0.1, "linear"), "b": ("x", 4, 2, 0.5, "higher"), "c": (lambda p: p["x"] - p["a"], 3, 1, 0.5, "linear")}
    got = {r.date: (r.a, r.b, r.c) for r in recursive.rolling_quantiles(df, specs).collect()}

    def plain(values, t, n, least, q, method):
        v = [y for y in values[max(t - n + 1, 0) : t + 1] if y is not None]
        return pytest.approx(np.quantile(v, q, method=method)) if len(v) >= least else None

    for t in got:
        rest = [None if v is None or got[i][0] is None else v - got[i][0] for i, v in enumerate(x)]
        assert got[t] == (plain(x, t, 4, 2, 0.1, "linear"), plain(x, t, 4, 2, 0.5, "higher"), plain(rest, t, 3, 1, 0.5, "linear"))


def test_nearest_vectors_are_found_by_blocks_of_vectors_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(graphs, "VECTORS", 4)
    rng = np.random.default_rng(3)
    x = {i: [float(v) for v in rng.integers(1, 4, 3)] for i in range(40)} | {5: None, 20: None, 7: [1.0, None, 2.0]}
    df = spark.createDataFrame(list(x.items()), "vec_id long, e array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in x.items() if v and None not in v}
    expected = set()
    for q in range(0, 40, 10):
        sims = {i: round(float(unit[q] @ unit[i]), 9) if q in unit and i in unit else None for i in x if i != q}
        best = sorted(sims, key=lambda i: (sims[i] is None, -(sims[i] or 0), i))[:6]
        expected |= {(q, i, k + 1, sims[i]) for k, i in enumerate(best)}
    found = graphs.nearest(df, F.col("vec_id") % 10 == 0, 6, blocks=3)
    assert {tuple(r) for r in found.collect()} == expected
    # the vectors meet as blocks, not as pairs of rows
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j13_semi_anti", "m14_ablation", "p3_uncertainty_filter"])
def test_shuffle_partitions_rise_with_the_records(spark, sf, monkeypatch, name):
    before = spark.conf.get(tables.PARTITIONS)
    small = registry.queries()[name](spark, sf)
    expected = sorted(map(tuple, small.collect()))
    assert spark.conf.get(tables.PARTITIONS) == before
    monkeypatch.setattr(tables, "RECORDS", 500)
    monkeypatch.setattr(tables, "SMALL", 1000)
    try:
        df = registry.queries()[name](spark, sf)
        n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
        assert n > int(before) and int(spark.conf.get(tables.PARTITIONS)) == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in plan
        assert sorted(map(tuple, df.collect())) == expected
    finally:
        spark.conf.set(tables.PARTITIONS, before)


def test_rolling_scores_equal_plain_ones_and_sum_no_frame_anew(spark, sf):
    x = [3.0, None, 3.0, -1.0, 8.0, 2.5, None, None, None, 4.0, 4.0]
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(x)], "code long, date long, x double").repartition("code")
    got = {r.date: r.z for r in recursive.rolling_scores(df, {"z": ("x", 4, 2, 0.5)}).collect()}
    for t, value in enumerate(x):
        v = [y for y in x[max(t - 3, 0) : t + 1] if y is not None]
        expected = (value - np.mean(v)) / (np.std(v, ddof=1) + 0.5) if value is not None and len(v) >= 2 else None
        assert got[t] == (expected if expected is None else pytest.approx(expected))
    assert "stddev_samp" not in registry.queries()["d30_continuous_contract"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r27_products", "x14_sector_beta"])
def test_series_of_dates_and_sectors_do_not_move_the_bars(spark, sf, monkeypatch, name):
    monkeypatch.setattr(tables, "SMALL", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("strategy=broadcast") >= {"r27_products": 3, "x14_sector_beta": 1}[name]


def test_rank_correlations_find_the_marks_of_all_columns_in_one_pass(spark, sf, monkeypatch):
    calls = []
    kind = type(spark.range(0))
    plain = kind.approxQuantile
    monkeypatch.setattr(kind, "approxQuantile", lambda self, col, *a: calls.append(col) or plain(self, col, *a))
    registry.queries()["t6_feature_pairs"](spark, sf)
    assert calls == [["close", "volume", "turnover", "high"]]
