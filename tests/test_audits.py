"""Audits on rows with planted faults: each must find exactly what was planted, and nothing in clean rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import audit, select
from panelforge.plans import registry

START = dt.date(2020, 1, 1)


def prices(codes=3, days=12):
    rows = [(c, START + dt.timedelta(days=t), 100.0 + 7 * c + (t * (c + 3)) % 11) for c in range(codes) for t in range(days)]
    label = {(c, d): r for c, d, r in rows}
    ahead = lambda c, d, n: label.get((c, d + dt.timedelta(days=n)))
    return [(c, d, p, None if ahead(c, d, 3) is None else ahead(c, d, 3) / p - 1) for c, d, p in rows]


LABELS = "code int, date date, close double, y double"


def mismatches(spark, rows):
    return {r["code"]: (r["mismatches"], r["tail_nulls"]) for r in audit.label_mismatches(spark.createDataFrame(rows, LABELS), "y", 3).collect()}


def test_clean_labels_have_no_mismatches(spark):
    assert mismatches(spark, prices()) == {0: (0, 3), 1: (0, 3), 2: (0, 3)}


def test_planted_label_faults_are_found(spark):
    rows = [list(r) for r in prices()]
    rows[0][3] += 0.01  # a wrong label
    rows[13][3] = None  # a missing one
    rows[-1][3] = 0.0  # one that looks beyond the last row
    assert mismatches(spark, [tuple(r) for r in rows]) == {0: (1, 3), 1: (1, 3), 2: (1, 2)}


def test_labels_of_no_rows(spark):
    assert mismatches(spark, []) == {}


@pytest.mark.parametrize(("rows", "want"), [
    ([(2.0, 1.0, 2.0), (6.0, 2.0, 3.0)], (2, 0, 0.0)),
    ([(2.0, 1.0, 2.0), (6.5, 2.0, 3.0), (1.0, None, 1.0), (None, 1.0, 1.0)], (3, 2, 0.5)),
    ([], (0, 0, None)),
])
def test_identity(spark, rows, want):
    got = audit.identity(spark.createDataFrame(rows, "a double, b double, c double"), "a", ["b", "c"]).first()
    assert tuple(got) == want


def test_coverage_counts_nulls_and_bad_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,), (-2.0,)], "x double")
    assert [tuple(r) for r in audit.coverage(df, {"x": ("x", "x < 0")}).collect()] == [("x", 0.75, 2)]


def test_selections_keep_the_keys_apart(spark):
    """The best of one set do not push out those of another."""
    rows = [(s, START, c, float(c if s == 1 else -c)) for s in (1, 2) for c in range(10)]
    df = spark.createDataFrame(rows, "set int, date date, code int, score double")
    best = {(r["set"], r["code"]) for r in select.top_k(df, "score", k=2, by=("set", "date")).collect()}
    assert best == {(1, 9), (1, 8), (2, 0), (2, 1)}
    sides = {(r["set"], r["code"], r["side"], r["weight"]) for r in select.long_short(df, "score", 0.1, by=("set", "date")).collect()}
    assert sides == {(1, 9, "long", 1.0), (1, 0, "short", -1.0), (2, 0, "long", 1.0), (2, 9, "short", -1.0)}


#: Audits and what must be found in the tables: a column that is the same in every row proves nothing.
FOUND = {
    "y12_return_identity": "bad > 0 and bad < rows", "y16_label_validation": "mismatches > 0", "c7_gap_check": "not ok", "m15_target_variance": "zero", "y13_coverage": "coverage < 1", "y4_asof_violations": "due < published",
    "y6_ohlc_checks": "rule = 'limit_move' and n > 0", "y18_target_leakage": "leak",
}


@pytest.mark.parametrize("name", FOUND)
def test_audits_meet_faults_and_clean_rows(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.where(F.expr(FOUND[name])).count() > 0
    if df.count() > 1 and name != "y4_asof_violations":
        assert df.where(~F.expr(FOUND[name])).count() > 0


#: Block queries in which no number may be the same in every row, and one that is: in the smallest tables a sector has one code.
ALONE = {"x_rel_sec_mom"}
VARIED = ("d15_margin_daily", "d15_margin_weekly", "d43_regime_block", "d44_coin_series", "p18_regime_signals", "r27_products", "r_technical_block")


@pytest.mark.parametrize("name", VARIED)
def test_no_number_is_constant(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.LongType, T.IntegerType))]
    row = df.agg(*[F.countDistinct(c).alias(c) for c in numbers]).first()
    assert [c for c in numbers if row[c] < 2 and c not in ALONE] == []
