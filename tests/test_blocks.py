"""Technical block, macro blocks, regimes and products against plain pandas and loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import interactions, macro, margin, technical

START = dt.date(2020, 1, 1)
BARS = "code long, date date, open double, high double, low double, close double, volume double, turnover double"


def walk(codes=2, days=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        close = 100.0
        for t in range(days):
            start = close * math.exp(rng.normal(0, 0.01))
            close = start * math.exp(rng.normal(0, 0.02))
            high, low = max(start, close) * (1 + rng.random() * 0.01), min(start, close) * (1 - rng.random() * 0.01)
            volume = float(rng.integers(100, 1000))
            rows.append((c, START + dt.timedelta(days=t), start, high, low, close, volume, volume * close))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), BARS).cache()


def one(df, code=0):
    return df.where(F.col("code") == code).orderBy("date").toPandas()


def close_to(got, want, places=9):
    got, want = pd.to_numeric(got).to_numpy(float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, rtol=10**-places, atol=10**-places, equal_nan=True)


def test_technical_block_equals_pandas(bars):
    p, got = one(bars), one(technical.technical_block(bars))
    assert list(got.columns) == ["code", "date", *technical.NAMES]
    c, h, l = p["close"], p["high"], p["low"]  # noqa: E741
    r = c.pct_change()
    close_to(got["ret_20"], c / c.shift(20) - 1)
    close_to(got["sma_60"], c.rolling(60).mean())
    mean = lambda x, a: x.ewm(alpha=a, adjust=False, ignore_na=True).mean()
    macd = mean(c, 2 / 13) - mean(c, 2 / 27)
    close_to(got["macd_hist"], macd - mean(macd, 2 / 10))
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    close_to(got["natr"], mean(tr, 1 / 14) / c)
    up, down = h.diff(), -l.diff()
    plus, minus = (mean(a.where((a > b) & (a > 0), 0.0), 1 / 14) for a, b in ((up, down), (down, up)))
    close_to(got["adx"], mean(100 * (plus - minus).abs() / (plus + minus + 1e-12), 1 / 14))
    change = c.diff()
    gain, loss = change.clip(lower=0).rolling(14).mean(), (-change).clip(lower=0).rolling(14).mean()
    close_to(got["rsi_14"], 100 - 100 / (1 + gain / (loss + 1e-12)))
    close_to(got["vol_20"], r.rolling(20, min_periods=10).std() * math.sqrt(252))
    close_to(got["obv"], (np.sign(r).fillna(0) * p["volume"]).cumsum())
    typical = (h + l + c) / 3
    flow = typical * p["volume"]
    into, out = flow.where(typical.diff() > 0, 0.0).rolling(14).sum(), flow.where(typical.diff() < 0, 0.0).rolling(14).sum()
    close_to(got["mfi"], 100 - 100 / (1 + into / (out + 1e-12)), 7)
    low, high = l.rolling(252, min_periods=1).min(), h.rolling(252, min_periods=1).max()
    close_to(got["pos_252"], (c - low) / (high - low))
    close_to(got["auto_20"], [np.nan] * 11 + [np.corrcoef(r[max(t - 19, 2) : t + 1], r.shift()[max(t - 19, 2) : t + 1])[0, 1] for t in range(11, len(r))], 7)


def test_technical_block_is_shift_safe_and_takes_no_rows(spark, bars):
    """Values of a date do not change when later rows are cut off."""
    cut = START + dt.timedelta(days=150)
    whole, part = one(technical.technical_block(bars)).iloc[:150], one(technical.technical_block(bars.where(F.col("date") < cut)))
    for name in technical.NAMES:
        close_to(part[name], pd.to_numeric(whole[name]))
    assert technical.technical_block(spark.createDataFrame([], BARS)).count() == 0


@pytest.mark.parametrize("style", [macro.VOLATILITY, macro.EXCHANGE, macro.COIN], ids=["volatility", "exchange", "coin"])
def test_series_block_equals_pandas(bars, style):
    p, got = one(bars), one(macro.series_block(bars, style))
    c = p["close"]
    roll = lambda x, w: x.rolling(w[0], min_periods=w[1])
    fast, slow = roll(c, style.fast).mean(), roll(c, style.slow).mean()
    close_to(got["trend"], (fast - slow) / (slow + 1e-9))
    close_to(got["slope_3"], fast / (fast.shift(3) + 1e-9) - 1)
    z = {k: (c - roll(c, w).mean()) / (roll(c, w).std() + 1e-9) for k, w in (("long", style.long), ("short", style.short))}
    close_to(got["z_long"], z["long"], 7)
    vol = c.pct_change().rolling(20, min_periods=10).std() * math.sqrt(style.year)
    vol_z = (vol - vol.rolling(252, min_periods=60).mean()) / (vol.rolling(252, min_periods=60).std() + 1e-9)
    spike = {macro.VOLATILITY: vol_z > 1.5, macro.EXCHANGE: z["long"].abs() > 1.5, macro.COIN: z["short"].abs() > 2}[style]
    assert got["spike"].tolist() == spike.astype(int).tolist()
    assert got["trend_up"].tolist() == (fast > slow).astype(int).tolist()
    assert 0 < sum(got["shock"]) < len(got)


def test_wide_carries_values_over_missing_dates(spark):
    day = lambda t: START + dt.timedelta(days=t)
    rows = [(k, day(t), 1.0 * t, 0.0, 0.0, 10.0 * k + t, 5.0 + t, 0.0) for t, k in ((0, 0), (1, 1), (2, 0), (3, 2))]
    w = macro.wide(spark.createDataFrame(rows, BARS), {0: "equity", 1: "growth", 2: "coin"}).orderBy("date").collect()
    assert [r["equity"] for r in w] == [0.0, 0.0, 2.0, 2.0]
    assert [r["growth"] for r in w] == [11.0] * 4  # before the first value that value
    assert [r["coin"] for r in w] == [23.0] * 4
    assert [r["equity_open"] for r in w] == [0.0, 0.0, 2.0, 2.0]
    assert [r["growth_volume"] for r in w] == [6.0] * 4


def test_regime_signals_equal_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(c, START + dt.timedelta(days=t), float(rng.normal(0, 0.02))) for c in range(4) for t in range(60) if rng.random() < 0.7]
    got = {r["date"]: r for r in macro.regime_signals(spark.createDataFrame(rows, "code long, date date, r double"), 20).collect()}
    assert set(got) == {r[1] for r in rows}
    for date, row in got.items():
        devs, moms, falls = [], [], []
        for c in {r[0] for r in rows if r[1] == date}:
            rs = [r for k, d, r in rows if k == c and 0 <= (date - d).days <= 20]
            level = np.exp(np.concatenate(([0.0], np.cumsum(rs[1:]))))
            if len(rs) > 1:
                devs.append(np.std(rs, ddof=1))
            moms.append(level[-1] - 1)
            falls.append(min(level[j] / level[: j + 1].max() - 1 for j in range(len(level))))
        assert row["mom"] == pytest.approx(np.mean(moms))
        assert row["max_dd"] == pytest.approx(-min(falls), abs=1e-12)
        assert (row["vol"] is None) if not devs else row["vol"] == pytest.approx(np.mean(devs) * math.sqrt(252))


def test_regimes_of_planted_signals(spark):
    cases = [
        (0.40, -0.10, 0.20, "crisis", 1.0, 0.1),  # 0.2 * 0.15 / 0.4 is below the least exposure
        (0.20, -0.08, 0.05, "bear", 0.20 / 0.18 * 0.8, 0.5 * 0.15 / 0.20),
        (0.10, 0.08, 0.02, "bull", (1 - 0.10 / 0.15) * 0.8, 0.7),
        (0.16, 0.01, 0.02, "sideways", 0.8, 0.15 / 0.16),
        (0.16, 0.15, 0.02, "sideways", 0.3, 0.7 * 0.15 / 0.16),
        (None, 0.0, 0.0, "sideways", 0.8, 1.0),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, vol double, mom double, max_dd double")
    for r in macro.regimes(df, macro.Limits()).orderBy("i").collect():
        *_, regime, confidence, exposure = cases[r["i"]]
        assert (r["regime"], pytest.approx(r["confidence"]), pytest.approx(r["exposure"])) == (regime, confidence, exposure)


FACTORS = ("ma_gap", "market_gap", "rel_sector", "sector_mom", "r", "r_5", "vol", "volume_ratio", "short_days", "rel_strength", "credit", "z_close", "revision", "progress", "days_since", "alpha", "beta_stability", "smart")


def test_products_hinge_and_decay(spark):
    base = dict.fromkeys(FACTORS, 1.0) | {"code": 1, "date": START, "high_vol": True}
    rows = [
        base | {"z_close": -2.0, "rel_strength": -3.0, "days_since": 5.0},
        base | {"date": START + dt.timedelta(days=1), "z_close": 2.0, "rel_strength": 3.0, "revision": None, "progress": None, "r": -1.0},
        base | {"date": START + dt.timedelta(days=2), "z_close": None, "short_days": None, "high_vol": False},
    ]
    schema = "code long, date date, high_vol boolean, " + ", ".join(f"{c} double" for c in FACTORS)
    names = [c.split()[0] for c in schema.split(", ")]
    a, b, c = interactions.products(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)).orderBy("date").collect()
    assert (a["x_squeeze_pressure"], a["x_rev_gate"], a["x_flow_smart_rel"]) == (0.0, 2.0, -3.0)
    assert a["x_pead_effect"] == pytest.approx(2 * math.exp(-1))
    assert a["x_credit_rev_bias"] == 0.0  # fewer than 26 rows of credit count as none
    assert (b["x_squeeze_pressure"], b["x_rev_gate"], b["x_pead_effect"], b["x_rvol5_dir"]) == (3.0, 0.0, 0.0, -1.0)
    assert (c["x_squeeze_pressure"], c["x_rev_gate"], c["x_credit_rev_bias"]) == (None, None, None)


def test_balances_equal_pandas(spark):
    rng = np.random.default_rng(9)
    rows = [(c, START + dt.timedelta(days=3 * t), float(rng.integers(0, 50)) * 10, float(rng.integers(0, 50)) * 10) for c in range(2) for t in range(40)]
    df = spark.createDataFrame(rows, "code int, date date, lg double, sh double")
    p, got = one(df), one(margin.balances(df, 26))
    z = lambda x: (x - x.rolling(26).mean()) / (x.rolling(26).std() + 1e-8)
    close_to(got["z_short"], z(p["sh"]))
    close_to(got["z_credit"], z(p["lg"] / (p["sh"] + 1)))
    close_to(got["z_d_short"], z(p["sh"].diff()))
    close_to(got["total_mom"], p["lg"] + p["sh"] - (p["lg"] + p["sh"]).rolling(4).mean())
    days = one(margin.scaled(margin.balances(df, 26).withColumn("adv20", F.when(F.col("lg") > 100, 20.0).otherwise(0.0))))
    close_to(days["short_adv"], np.where(p["lg"] > 100, p["sh"] / 20, np.nan))


def test_setups_of_planted_rows(spark):
    rows = [(1, 5.0, 0.0, 1.0, 0.1, 0.2), (2, 5.0, 2.0, -1.0, -0.1, 0.2), (3, 1.0, 2.0, -1.0, 0.1, -0.2), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, short_adv double, z_long double, d_net double, r_1 double, r_3 double")
    got = [(r["squeeze"], r["unwinding"], r["with_trend"]) for r in margin.setups(df, F.lit(4.0)).orderBy("i").collect()]
    assert got == [(1, 0, 1), (0, 1, 0), (0, 0, 1), (0, 0, 1)]
