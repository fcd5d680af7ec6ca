"""Macro series: the block of one series in the style of its kind, and regimes across series.

Series are the codes of a frame (code, date, open, high, low, close, volume), or
columns of a frame with one row for each date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import by_code, frame, lag, roll

TINY = 1e-9


@dataclass(frozen=True)
class Style:
    """Windows (rows, least values) of a kind of series, days of its year, and what counts as a spike."""

    fast: tuple[int, int] = (5, 5)
    slow: tuple[int, int] = (20, 20)
    long: tuple[int, int] = (252, 126)
    short: tuple[int, int] = (60, 30)
    year: float = 252.0
    spike: str = "abs(z_long) > 1.5"
    shock: float = 0.01
    turbulent: float = 0.9


VOLATILITY = Style(spike="vol_z > 1.5")
EXCHANGE = Style()
COIN = Style(fast=(7, 5), slow=(30, 10), long=(120, 40), short=(60, 20), year=365.0, spike="abs(z_short) > 2")

NUMBERS = ("log_close", "ret_1", "ret_5", "ret_10", "ret_20", "abs_ret", "trend", "slope_3", "gap_slow", "gap_short", "range_pct", "vol_20", "vol_60", "vol_z", "z_long", "z_short", "volume_ratio")
FLAGS = ("trend_up", "spike", "shock", "turbulent")


def standard(x: Column | str, n: int, least: int) -> Column:
    """Deviations of x from its mean over n rows."""
    x = F.col(x) if isinstance(x, str) else x
    return (x - roll(F.avg, x, n, least)) / (roll(F.stddev_samp, x, n, least) + TINY)


def with_robust(df: DataFrame, x: str, out: str, n: int = 252, least: int = 60) -> DataFrame:
    """df with out: the distance of x from its median over n rows, in medians of such distances."""
    half = lambda c: F.percentile(c, 0.5)
    df = df.withColumn("_median", roll(half, x, n, least)).withColumn("_distance", F.abs(F.col(x) - F.col("_median")))
    return df.withColumn(out, (F.col(x) - F.col("_median")) / (roll(half, "_distance", n, least) + TINY)).drop("_median", "_distance")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def series_block(s: DataFrame, style: Style) -> DataFrame:
    """s with NUMBERS and FLAGS of every series by date; values are null until a window has its least number of rows, flags 0."""
    close = F.col("close")
    s = s.withColumns({f"ret_{n}": close / lag("close", n) - 1 for n in (1, 5, 10, 20)})
    s = s.withColumns({
        "_fast": roll(F.avg, "close", *style.fast), "_slow": roll(F.avg, "close", *style.slow), "_short": roll(F.avg, "close", *style.short),
        "vol_20": roll(F.stddev_samp, "ret_1", 20, 10) * style.year**0.5, "vol_60": roll(F.stddev_samp, "ret_1", 60, 20) * style.year**0.5,
        "z_long": standard("close", *style.long), "z_short": standard("close", *style.short),
    })
    s = s.withColumns({
        "log_close": F.log(close + TINY), "abs_ret": F.abs("ret_1"), "trend": (F.col("_fast") - F.col("_slow")) / (F.col("_slow") + TINY), "slope_3": F.col("_fast") / (lag("_fast", 3) + TINY) - 1,
        "gap_slow": close / F.col("_slow") - 1, "gap_short": close / F.col("_short") - 1, "range_pct": (F.col("high") - F.col("low")) / (close + TINY),
        "vol_z": standard("vol_20", 252, 60), "volume_ratio": (F.col("volume") + TINY) / (roll(F.avg, "volume", 20, 10) + TINY),
    })
    return s.withColumns({"trend_up": flag(F.col("_fast") > F.col("_slow")), "spike": flag(F.expr(style.spike)), "shock": flag(F.col("abs_ret") > style.shock), "turbulent": flag(F.col("vol_20") > style.turbulent)}).drop("_fast", "_slow", "_short")


#: Series of the regime block by their role.
ROLES = ("equity", "growth", "coin", "dollar", "fx", "credit_high", "credit_low", "rates_long", "rates_mid", "vi", "vi_short", "vi_long")


def wide(s: DataFrame, roles: dict[int, str]) -> DataFrame:
    """One row for each date: close of every series by its role, with the opening of equity and the volumes of equity and growth.

    A date without a value keeps the last one, dates before the first one take that. Code 0 marks the rows as one series.
    """
    at = lambda code, c: F.max(F.when(F.col("code") == code, F.col(c)))
    code = {role: k for k, role in roles.items()}
    columns = {role: at(k, "close") for k, role in roles.items()} | {"equity_open": at(code["equity"], "open"), "equity_volume": at(code["equity"], "volume"), "growth_volume": at(code["growth"], "volume")}
    w = s.groupBy("date").agg(*[c.alias(name) for name, c in columns.items()])
    before, after = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)  # one row for each date
    return w.select(F.lit(0).alias("code"), "date", *[F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)).alias(c) for c in columns])


REGIME = ("equity_rv20", "equity_drv", "growth_rv20", "vi_z", "equity_surge", "growth_surge", "equity_mom63", "growth_mom63", "equity_gap", "growth_gap", "equity_pos52", "dollar_z", "coin_rel", "coin_rv20", "vrp", "vrp_z",
          "credit", "credit_z", "term_rates", "term_rates_z", "vi_slope", "vi_ratio", "vi_slope_z", "overnight", "intraday", "fx_ret_1", "fx_ret_5", "fx_ret_20", "fx_z")


def regime_block(w: DataFrame) -> DataFrame:
    """w (see wide) with REGIME and vrp_high: volatility, volume, momentum, demand, variance premium, credit, rates, volatility term, sessions and exchange rate."""
    col = F.col
    change = lambda x, n: col(x) / lag(x, n) - 1
    w = w.withColumns({f"_{x}": change(x, 1) for x in ("equity", "growth", "coin")})
    rv = lambda x, n, least: roll(F.stddev_samp, f"_{x}", n, least) * 252.0**0.5
    middle = lambda x: roll(lambda c: F.percentile(c, 0.5), x, 20, 10)
    mean = lambda x, n, least: roll(F.avg, x, n, least)
    year = frame(-251, 0)
    low, high, enough = F.min("equity").over(year), F.max("equity").over(year), F.count("equity").over(year) >= 126
    w = w.withColumns({f"{x}_rv20": rv(x, 20, 10) for x in ("equity", "growth", "coin")} | {f"{x}_mom63": change(x, 63) for x in ("equity", "growth")} | {
        "equity_drv": rv("equity", 20, 10) - rv("equity", 63, 30),
        **{f"{x}_surge": col(f"{x}_volume") / (middle(f"{x}_volume") + TINY) - 1 for x in ("equity", "growth")},
        **{f"{x}_gap": (mean(x, 20, 20) - mean(x, 100, 50)) / (mean(x, 100, 50) + TINY) for x in ("equity", "growth")},
        "equity_pos52": F.when(enough, (col("equity") - low) / (high - low + TINY)),
        "credit": col("credit_high") / (col("credit_low") + TINY) - 1, "term_rates": col("rates_long") / (col("rates_mid") + TINY) - 1,
        "vi_slope": col("vi_long") - col("vi"), "vi_ratio": col("vi_short") / (col("vi_long") + TINY) - 1,
        "overnight": col("equity_open") / lag("equity") - 1, "intraday": col("equity") / (col("equity_open") + TINY) - 1,
        **{f"fx_ret_{n}": change("fx", n) for n in (1, 5, 20)}, "fx_z": standard("fx", 20, 10),
    })
    w = w.withColumns({"coin_rel": change("coin", 63) / (col("equity_mom63") + TINY) - 1, "vrp": F.pow(col("vi") / 100, 2) - F.pow("equity_rv20", 2)})
    w = w.withColumns({"vrp_z": standard("vrp", 252, 126), "credit_z": standard("credit", 63, 30), "term_rates_z": standard("term_rates", 63, 30), "vi_slope_z": standard("vi_slope", 126, 60)})
    w = with_robust(with_robust(w, "vi", "vi_z"), "dollar", "dollar_z")
    return w.withColumn("vrp_high", flag(col("vrp_z") > 1)).drop("_equity", "_growth", "_coin")


@dataclass(frozen=True)
class Limits:
    """Annual volatilities and drawdown that part the regimes, and the momentum that counts."""

    crisis_vol: float = 0.25
    crisis_drawdown: float = 0.10
    bear_vol: float = 0.18
    bull_vol: float = 0.15
    momentum: float = 0.05


def regime_signals(x: DataFrame, span: int) -> DataFrame:
    """(date, vol, mom, max_dd) of x(code, date, r), r being log returns, over the span days before a date and its own.

    vol is the mean deviation of a code's returns for a year, mom the mean return from
    the first row of the window to the last, max_dd the deepest fall of a code from a
    peak to a later row, both inside the window. A code counts on the dates that it has a row on.
    """
    w = by_code().orderBy(F.unix_date("date")).rangeBetween(-span, 0)
    values = F.collect_list("r").over(w)
    # levels of the window against its first row
    level = F.transform("_rs", lambda r, i: F.when(i == 0, 0.0).otherwise(F.aggregate(F.slice("_rs", F.lit(2), i), F.lit(0.0), lambda s, v: s + v)))
    own = x.select("code", "date", values.alias("_rs"), F.stddev_samp("r").over(w).alias("_dev")).withColumn("_level", level)
    fall = F.array_min(F.transform("_level", lambda v, i: v - F.array_max(F.slice("_level", F.lit(1), i + 1))))
    own = own.select("date", "_dev", F.expm1(F.element_at("_level", -1)).alias("_mom"), F.expm1(fall).alias("_fall"))
    return own.groupBy("date").agg((F.avg("_dev") * 252.0**0.5).alias("vol"), F.avg("_mom").alias("mom"), F.abs(F.min("_fall")).alias("max_dd"))


def regimes(signals: DataFrame, limits: Limits, target_vol: float = 0.15) -> DataFrame:
    """signals(vol, mom, max_dd, ...) with regime, confidence (0 to 1) and exposure (0.1 to 1).

    Exposure falls with the volatility above target_vol and where the regime is unsure. Without a volatility (one row in
    the window) the regime is sideways.
    """
    vol, mom, dd = F.col("vol"), F.col("mom"), F.col("max_dd")
    one = F.lit(1.0)
    crisis = (vol > limits.crisis_vol) & (dd > limits.crisis_drawdown)
    bear = (vol > limits.bear_vol) & (mom < -limits.momentum)
    bull = (vol < limits.bull_vol) & (mom > limits.momentum)
    pick = lambda a, b, c, d: F.when(crisis, a).when(bear, b).when(bull, c).otherwise(d)
    sure = pick(
        F.least(one, vol / limits.crisis_vol * (dd / limits.crisis_drawdown)), F.least(one, vol / limits.bear_vol * F.abs(mom) * 10), F.least(one, (1 - vol / limits.bull_vol) * mom * 10),
        F.greatest(F.lit(0.3), F.least(F.lit(0.8), 1 - F.abs(mom) * 5)),
    )
    s = signals.withColumns({"regime": pick(F.lit("crisis"), F.lit("bear"), F.lit("bull"), F.lit("sideways")), "confidence": sure})
    base = pick(F.lit(0.2), F.lit(0.5), one, one) * F.when(vol > 0, F.least(one, target_vol / vol)).otherwise(one)
    return s.withColumn("exposure", F.greatest(F.lit(0.1), F.least(one, base * F.when(F.col("confidence") < 0.5, 0.7).otherwise(1.0))))
