"""Per-code windows: returns, rolling kernels, labels, runs and flags (W rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_code, EPS, clip, correlation, frame, lag, lead, lroll, ratio, ret, roll, zscore
from ..operators import recursive, runs
from ..sources.tables import Data
from .registry import query
from .sql import clip as sclip
from .sql import lag as slag
from .sql import lead as slead
from .sql import lroll as slroll
from .sql import over
from .sql import roll as sroll
from .sql import z as sz

W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _returns(d: Data):
    return d.bars.withColumn("r", F.col("close") / lag("close") - 1)


RETURNS = "b AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) ;;"
H = (1, 5, 10, 20, 60, 120)


@query("w1_past_returns", "code date", " ".join(f"ret_{h}" for h in H) + " dollar_volume",
       "SELECT code, date, " + ", ".join(f"close / ({slag('close', h)} + 1e-12) - 1 AS ret_{h}" for h in H) + ", coalesce(turnover, close * volume) AS dollar_volume FROM bars")
def w1(d: Data):
    return d.bars.select("code", "date", *[ret("close", h).alias(f"ret_{h}") for h in H], F.coalesce("turnover", F.col("close") * F.col("volume")).alias("dollar_volume"))


@query("w2_forward_returns", "code date", "fwd_1 fwd_5 fwd_10 fwd_20",
       "SELECT code, date, " + ", ".join(f"{slead('close', h)} / (close + 1e-12) - 1 AS fwd_{h}" for h in (1, 5, 10, 20)) + " FROM bars")
def w2(d: Data):
    return d.bars.select("code", "date", *[(lead("close", h) / (F.col("close") + EPS) - 1).alias(f"fwd_{h}") for h in (1, 5, 10, 20)])


@query("w3_log_returns", "code date", "lr_1 lr_5 lr_20",
       "SELECT code, date, " + ", ".join(f"ln(close) - ln({slag('close', h)}) AS lr_{h}" for h in (1, 5, 20)) + " FROM bars")
def w3(d: Data):
    return d.bars.select("code", "date", *[(F.log("close") - F.log(lag("close", h))).alias(f"lr_{h}") for h in (1, 5, 20)])


for _id, _f, _name, _sql in (("w4", F.avg, "mean", "avg"), ("w5", F.stddev_samp, "std", "stddev_samp"), ("w6", F.var_samp, "var", "var_samp"), ("w7", F.sum, "sum", "sum")):

    @query(f"{_id}_left_closed_{_name}", "code date", "x_20 x_60",
           f"SELECT code, date, {slroll(_sql, 'close', 20, 10)} AS x_20, {slroll(_sql, 'close', 60, 20)} AS x_60 FROM bars")
    def _left_closed(d: Data, f=_f):
        return d.bars.select("code", "date", lroll(f, "close", 20, 10).alias("x_20"), lroll(f, "close", 60, 20).alias("x_60"))


def nearest_quantile(x, q: float, over):
    """The value at round(q * (n - 1)) of the sorted frame."""
    values = F.sort_array(F.collect_list(x).over(over))
    return F.get(values, F.round(q * (F.size(values) - 1)).cast("int"))


@query("w8_left_closed_quantile", "code date", "q10_nearest q90_nearest q50_linear",
       f"""v AS (SELECT code, date, list_sort(list(close) OVER {over(-20, -1)}) AS a, quantile_cont(close, 0.5) OVER {over(-20, -1)} AS m, count(close) OVER {over(-20, -1)} AS n FROM bars) ;;
SELECT code, date, CASE WHEN n >= 10 THEN a[CAST(round(0.1::DOUBLE * (n - 1)) AS INT) + 1] END AS q10_nearest, CASE WHEN n >= 10 THEN a[CAST(round(0.9::DOUBLE * (n - 1)) AS INT) + 1] END AS q90_nearest,
CASE WHEN n >= 10 THEN m END AS q50_linear FROM v""")  # fmt: skip
def w8(d: Data):
    w = frame(-20, -1)
    enough = F.count("close").over(w) >= 10
    return d.bars.select(
        "code", "date",
        F.when(enough, nearest_quantile("close", 0.1, w)).alias("q10_nearest"),
        F.when(enough, nearest_quantile("close", 0.9, w)).alias("q90_nearest"),
        F.when(enough, F.percentile("close", 0.5).over(w)).alias("q50_linear"),
    )


@query("w10_rolling_inclusive", "code date", "mean_20 std_20 sum_20 min_20 max_20",
       "SELECT code, date, " + ", ".join(f"{sroll(f, 'close', 20, 10)} AS {n}_20" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("sum", "sum"), ("min", "min"), ("max", "max"))) + " FROM bars")
def w10(d: Data):
    kernels = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}
    return d.bars.select("code", "date", *[roll(f, "close", 20, 10).alias(f"{n}_20") for n, f in kernels.items()])


@query("w11_rolling_quantiles", "code date", "rq10 rq50 rq90 lr50",
       f"""b AS (SELECT *, ln(close) - ln({slag('close')}) AS lr FROM bars),
v AS (SELECT *, list_sort(list(lr) FILTER (lr IS NOT NULL) OVER {over(-62, 0)}) AS a FROM b) ;;
SELECT code, date, {', '.join(sroll(f'quantile_cont({{}}, {q})', 'close', 63, 63) + f' AS rq{int(q * 100)}' for q in (0.1, 0.5, 0.9))},
CASE WHEN len(a) >= 25 THEN a[CAST(round(0.5::DOUBLE * (len(a) - 1)) AS INT) + 1] END AS lr50 FROM v""")  # fmt: skip
def w11(d: Data):
    specs = {f"rq{int(q * 100)}": ("close", 63, 63, q, "linear") for q in (0.1, 0.5, 0.9)}
    # the value at round(0.5 * (n - 1)) is the higher one of two in the middle
    specs["lr50"] = (lambda p: np.log(p["close"]).diff(), 63, 25, 0.5, "higher")
    return recursive.rolling_quantiles(d.bars.select("code", "date", "close"), specs)


@query("w12_rolling_z_outlier", "code date outlier", "z20",
       f"z AS (SELECT code, date, {sz('close', 20, 10, left=True)} AS z20 FROM bars) ;; SELECT code, date, z20, abs(z20) > 2.0 AS outlier FROM z")
def w12(d: Data):
    return d.bars.select("code", "date", zscore("close", 20, 10, left=True).alias("z20")).withColumn("outlier", F.abs("z20") > 2.0)


@query("w13_vol_and_sharpe", "code date", "vol20 sharpe20",
       RETURNS + f"SELECT code, date, {slroll('stddev_samp', 'r', 20, 10)} AS vol20, ({slroll('avg', 'r', 20, 10)}) / (({slroll('stddev_samp', 'r', 20, 10)}) + 1e-8) AS sharpe20 FROM b")
def w13(d: Data):
    std = lroll(F.stddev_samp, "r", 20, 10)
    return _returns(d).select("code", "date", std.alias("vol20"), (lroll(F.avg, "r", 20, 10) / (std + 1e-8)).alias("sharpe20"))


@query("w14_adv_ratio_z", "code date", "adv_ratio z260",
       f"SELECT code, date, turnover / nullif({sroll('avg', 'turnover', 20, 10)}, 0) AS adv_ratio, {sz('turnover', 260, 130)} AS z260 FROM bars")
def w14(d: Data):
    return d.bars.select("code", "date", ratio("turnover", roll(F.avg, "turnover", 20, 10)).alias("adv_ratio"), zscore("turnover", 260, 130).alias("z260"))


@query("w15_robust_z", "code date", "robust_z",
       f"""m AS (SELECT *, {sroll('median', 'close', 252, 60)} AS med FROM bars), a AS (SELECT *, abs(close - med) AS dev FROM m) ;;
SELECT code, date, (close - med) / (({sroll('median', 'dev', 252, 60)}) + 1e-8) AS robust_z FROM a""")  # fmt: skip
def w15(d: Data):
    specs = {"med": ("close", 252, 60, 0.5, "linear"), "mad": (lambda p: (p["close"] - p["med"]).abs(), 252, 60, 0.5, "linear")}
    m = recursive.rolling_quantiles(d.bars.select("code", "date", "close"), specs)
    return m.select("code", "date", ((F.col("close") - F.col("med")) / (F.col("mad") + 1e-8)).alias("robust_z"))


def with_market(d: Data):
    """Bars with their return and the market's, whose return is taken over the dates of the market."""
    by_date = Window.orderBy("date")  # one row for each date
    market = d.market.select("date", "m_close", (F.col("m_close") / F.lag("m_close").over(by_date) - 1).alias("mr"))
    return _returns(d).join(market, "date")


WITH_MARKET = RETURNS.replace(";;", "") + ", mk AS (SELECT date, m_close, m_close / lag(m_close) OVER (ORDER BY date) - 1 AS mr FROM market), bm AS (SELECT b.*, m_close, mr FROM b JOIN mk USING (date))"


@query("w16_beta_alpha", "code date", "cov60 mvar60 beta60 alpha60",
       WITH_MARKET + f""", l AS (SELECT code, date, {slag('r')} AS x, {slag('mr')} AS y FROM bm), p AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS px, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS py FROM l),
q AS (SELECT code, date, CASE WHEN count(px) OVER o >= 30 THEN covar_samp(px, py) OVER o END AS cov60, CASE WHEN count(px) OVER o >= 30 THEN var_samp(py) OVER o END AS mvar60,
 avg(px) OVER o AS mx, avg(py) OVER o AS my FROM p WINDOW o AS {over(-59, 0)}) ;;
SELECT code, date, cov60, mvar60, cov60 / (mvar60 + 1e-12) AS beta60, mx - cov60 / (mvar60 + 1e-12) * my AS alpha60 FROM q""", "bars market")  # fmt: skip
def w16(d: Data):
    o = frame(-59, 0)
    b = with_market(d).select("code", "date", lag("r").alias("x"), lag("mr").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    b = b.withColumns({"px": F.when(both, F.col("x")), "py": F.when(both, F.col("y"))})
    enough = F.count("px").over(o) >= 30
    b = b.select("code", "date", F.when(enough, F.covar_samp("px", "py").over(o)).alias("cov60"), F.when(enough, F.var_samp("py").over(o)).alias("mvar60"), F.avg("px").over(o).alias("mx"), F.avg("py").over(o).alias("my"))
    b = b.withColumn("beta60", F.col("cov60") / (F.col("mvar60") + EPS))
    return b.withColumn("alpha60", F.col("mx") - F.col("beta60") * F.col("my"))


def _moment_beta(n: int, least: int):
    m = lambda x: roll(F.avg, x, n, least)
    return ratio(m(F.col("r") * F.col("ml")) - m("r") * m("ml"), m(F.col("ml") * F.col("ml")) - m("ml") * m("ml") + EPS)


def _smoment_beta(n: int, least: int) -> str:
    m = lambda x: "(" + sroll("avg", x, n, least) + ")"
    return f"({m('r * ml')} - {m('r')} * {m('ml')}) / nullif({m('ml * ml')} - {m('ml')} * {m('ml')} + 1e-12, 0)"


@query("w17_moment_beta", "code date aligned fallback", "beta beta20 alpha rel_strength idio_ratio beta_stability",
       WITH_MARKET + f""", l AS (SELECT *, {slag('mr')} AS ml FROM bm), g AS (SELECT *, {_smoment_beta(60, 60)} AS b60, {_smoment_beta(20, 20)} AS beta20, {sroll('avg', 'r', 20, 20)} AS a, {sroll('avg', 'ml', 20, 20)} AS m FROM l), f AS (SELECT *, coalesce(b60, beta20) AS beta FROM g),
h AS (SELECT *, r - beta * ml AS idio FROM f) ;;
SELECT code, date, beta, beta20, CAST(b60 IS NULL AND beta20 IS NOT NULL AS INT) AS fallback, CAST(coalesce(sign(a) = sign(m), false) AS INT) AS aligned, a - beta * m AS alpha, ({sroll('sum', 'r', 20, 20)}) - ({sroll('sum', 'ml', 20, 20)}) AS rel_strength,
({sroll('stddev_samp', 'idio', 20, 10)}) / (({sroll('stddev_samp', 'r', 20, 10)}) + 1e-12) AS idio_ratio, {sroll('stddev_samp', 'beta', 20, 10)} AS beta_stability FROM h""", "bars market")  # fmt: skip
def w17(d: Data):
    b = with_market(d).withColumn("ml", lag("mr")).withColumns({"b60": _moment_beta(60, 60), "beta20": _moment_beta(20, 20), "a": roll(F.avg, "r", 20), "m": roll(F.avg, "ml", 20)})
    b = b.withColumn("beta", F.coalesce("b60", "beta20"))
    b = b.withColumn("idio", F.col("r") - F.col("beta") * F.col("ml"))
    return b.select(
        "code", "date", "beta", "beta20",
        (F.col("b60").isNull() & F.col("beta20").isNotNull()).cast("int").alias("fallback"),
        F.coalesce(F.signum("a") == F.signum("m"), F.lit(False)).cast("int").alias("aligned"),
        (F.col("a") - F.col("beta") * F.col("m")).alias("alpha"),
        (roll(F.sum, "r", 20) - roll(F.sum, "ml", 20)).alias("rel_strength"),
        (roll(F.stddev_samp, "idio", 20, 10) / (roll(F.stddev_samp, "r", 20, 10) + EPS)).alias("idio_ratio"),
        roll(F.stddev_samp, "beta", 20, 10).alias("beta_stability"),
    )


@query("w18_future_realised_vol", "code date", "rv_5 rv_20",
       RETURNS + "SELECT code, date, " + ", ".join(f"CASE WHEN count(r) OVER {over(1, h)} >= {h} THEN sqrt(sum(r * r) OVER {over(1, h)} * 252.0 / {h}) END AS rv_{h}" for h in (5, 20)) + " FROM b")
def w18(d: Data):
    future = {f"rv_{h}": F.when(F.count("r").over(frame(1, h)) >= h, F.sqrt(F.sum(F.col("r") * F.col("r")).over(frame(1, h)) * 252.0 / h)) for h in (5, 20)}
    return _returns(d).select("code", "date", *[c.alias(n) for n, c in future.items()])


@query("w19_blend_labels", "code date", "blend",
       RETURNS + f""", v AS (SELECT code, date, {slroll('stddev_samp', 'r', 20, 10)} AS rv, {slroll('stddev_samp', 'r', 60, 20)} AS iv, CASE WHEN count(r) OVER {over(1, 5)} >= 5 THEN stddev_samp(r) OVER {over(1, 5)} END AS y FROM b) ;;
SELECT code, date, CASE WHEN y IS NULL OR rv IS NULL OR iv IS NULL THEN NULL WHEN abs(iv - rv) < 1e-8 THEN 0.5 ELSE greatest(0, least(1, (y - rv) / (iv - rv))) END AS blend FROM v""")  # fmt: skip
def w19(d: Data):
    v = _returns(d).select("code", "date", lroll(F.stddev_samp, "r", 20, 10).alias("rv"), lroll(F.stddev_samp, "r", 60, 20).alias("iv"), F.when(F.count("r").over(frame(1, 5)) >= 5, F.stddev_samp("r").over(frame(1, 5))).alias("y"))
    gap = F.col("iv") - F.col("rv")
    known = F.col("y").isNotNull() & gap.isNotNull()
    return v.select("code", "date", F.when(known & (F.abs(gap) < 1e-8), 0.5).when(known, clip(F.try_divide(F.col("y") - F.col("rv"), gap), 0.0, 1.0)).alias("blend"))


@query("w20_residual_rank_labels", "code date", "residual rank_date rank_sector",
       f"""f AS (SELECT code, date, sector, {slead('close', 5)} / close - 1 AS y FROM panel) ;;
SELECT code, date, y - avg(y) OVER (PARTITION BY date, sector) AS residual,
CASE WHEN y IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY y ASC NULLS LAST, code) - 1) / nullif(count(*) OVER (PARTITION BY date) - 1, 0)::DOUBLE END AS rank_date,
CASE WHEN y IS NOT NULL THEN (row_number() OVER (PARTITION BY date, sector ORDER BY y ASC NULLS LAST, code) - 1) / nullif(count(*) OVER (PARTITION BY date, sector) - 1, 0)::DOUBLE END AS rank_sector FROM f""", "panel")  # fmt: skip
def w20(d: Data):
    f = d.panel.select("code", "date", "sector", (lead("close", 5) / F.col("close") - 1).alias("y"))

    def ordinal(*keys: str):
        w = Window.partitionBy(*keys)
        return F.when(F.col("y").isNotNull(), F.try_divide(F.row_number().over(w.orderBy(F.col("y").asc_nulls_last(), "code")) - 1, F.count(F.lit(1)).over(w) - 1))

    return f.select("code", "date", (F.col("y") - F.avg("y").over(Window.partitionBy("date", "sector"))).alias("residual"), ordinal("date").alias("rank_date"), ordinal("date", "sector").alias("rank_sector"))


@query("w21_gaps", "code date void filled confirmed", "overnight intraday amplify fill_ratio gap_sign mag_z20",
       f"""g AS (SELECT *, open / {slag('close')} - 1 AS overnight, close / open - 1 AS intraday FROM bars),
h AS (SELECT *, abs(overnight) AS mag, abs(overnight) > 0.30 AS void FROM g),
i AS (SELECT *, CASE WHEN NOT void AND overnight <> 0 THEN greatest(0, least(1, -intraday / nullif(overnight, 0))) END AS fill_ratio, {sz('mag', 20, 10, left=True)} AS mag_z20 FROM h) ;;
SELECT code, date, void, overnight, intraday, intraday / nullif(mag, 0) AS amplify, fill_ratio, fill_ratio >= 1 AS filled, sign(overnight) AS gap_sign, mag_z20, (mag_z20 > 1 AND sign(overnight) = sign(intraday)) AS confirmed FROM i""")  # fmt: skip
def w21(d: Data):
    g = d.bars.withColumns({"overnight": F.col("open") / lag("close") - 1, "intraday": F.col("close") / F.col("open") - 1})
    g = g.withColumns({"mag": F.abs("overnight"), "void": F.abs("overnight") > 0.30})
    fill = F.when(~F.col("void") & (F.col("overnight") != 0), clip(F.try_divide(-F.col("intraday"), F.col("overnight")), 0.0, 1.0))
    g = g.withColumns({"fill_ratio": fill, "mag_z20": zscore("mag", 20, 10, left=True), "amplify": F.try_divide("intraday", "mag"), "gap_sign": F.signum("overnight")})
    return g.withColumns({"filled": F.col("fill_ratio") >= 1, "confirmed": (F.col("mag_z20") > 1) & (F.signum("overnight") == F.signum("intraday"))})


@query("w22_ranges", "code date", "day_range close_loc expansion",
       f"""r AS (SELECT *, (high - low) / {slag('close')} AS day_range FROM bars) ;;
SELECT code, date, day_range, (close - low) / nullif(high - low, 0) AS close_loc, day_range / nullif({slroll('avg', 'day_range', 20, 10)}, 0) AS expansion FROM r""")  # fmt: skip
def w22(d: Data):
    r = d.bars.withColumn("day_range", (F.col("high") - F.col("low")) / lag("close"))
    return r.select("code", "date", "day_range", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("close_loc"), ratio("day_range", lroll(F.avg, "day_range", 20, 10)).alias("expansion"))


IDX = "i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM bars)"


def numbered(df):
    return df.withColumn("n", F.row_number().over(by_code()))


def last_at(flag, value="n"):
    """The value at the last row so far where flag holds."""
    return F.last(F.when(flag, F.col(value)), ignorenulls=True).over(frame(Window.unboundedPreceding, 0))


def next_at(flag, value="n"):
    return F.first(F.when(flag, F.col(value)), ignorenulls=True).over(frame(0, Window.unboundedFollowing))


@query("w23_split_events", "code date is_split since_split to_split", "run_up",
       IDX + f""", s AS (SELECT *, (code * 31 + date_diff('day', DATE '1995-01-01', date)) % 97 = 0 AS is_split FROM i) ;;
SELECT code, date, is_split, n - last_value(CASE WHEN is_split THEN n END IGNORE NULLS) OVER {over('all', 0)} AS since_split,
first_value(CASE WHEN is_split THEN n END IGNORE NULLS) OVER {over(0, 'end')} - n AS to_split, close / {slag('close', 5)} - 1 AS run_up FROM s""")  # fmt: skip
def w23(d: Data):
    s = numbered(d.bars).withColumn("is_split", (F.col("code") * 31 + F.datediff("date", F.lit("1995-01-01"))) % 97 == 0)
    return s.select("code", "date", "is_split", (F.col("n") - last_at(F.col("is_split"))).alias("since_split"), (next_at(F.col("is_split")) - F.col("n")).alias("to_split"), (F.col("close") / lag("close", 5) - 1).alias("run_up"))


LIMITS = IDX + f", j AS (SELECT *, {slag('close')} AS pc FROM i), l AS (SELECT *, close >= pc * 1.2 AS up, close <= pc * 0.8 AS down FROM j)"


def limits(d: Data):
    s = numbered(d.bars).withColumn("pc", lag("close"))
    return s.withColumns({"up": F.col("close") >= F.col("pc") * 1.2, "down": F.col("close") <= F.col("pc") * 0.8})


@query("w24_limit_events", "code date up down up_5 down_5 since_limit locked", "",
       LIMITS + f""" ;; SELECT code, date, up, down, CAST({slroll('sum', 'CAST(up AS INT)', 5, 1)} AS BIGINT) AS up_5, CAST({slroll('sum', 'CAST(down AS INT)', 5, 1)} AS BIGINT) AS down_5,
n - last_value(CASE WHEN up OR down THEN n END IGNORE NULLS) OVER {over('all', 0)} AS since_limit, (high = low AND (up OR down)) AS locked FROM l""")  # fmt: skip
def w24(d: Data):
    hit = F.col("up") | F.col("down")
    return limits(d).select("code", "date", "up", "down", *[lroll(F.sum, F.col(c).cast("int"), 5, 1).alias(f"{c}_5") for c in ("up", "down")], (F.col("n") - last_at(hit)).alias("since_limit"), ((F.col("high") == F.col("low")) & hit).alias("locked"))


@query("w25_limit_extension", "code date streak true_streak", "reversal",
       LIMITS + f""", k AS (SELECT *, n - last_value(CASE WHEN up THEN n END IGNORE NULLS) OVER {over('all', 0)} + 1 AS streak, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {over('all', 0)} AS run FROM l) ;;
SELECT code, date, streak, CASE WHEN up THEN sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY code, run ORDER BY date)::BIGINT ELSE 0 END AS true_streak,
CASE WHEN lag(up) OVER (PARTITION BY code ORDER BY date) THEN -(close / pc - 1) END AS reversal FROM k""")  # fmt: skip
def w25(d: Data):
    l = limits(d).withColumn("run", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(frame(Window.unboundedPreceding, 0)))  # noqa: E741
    true = F.sum(F.when(F.col("up"), 1).otherwise(0)).over(Window.partitionBy("code", "run").orderBy("date"))
    return l.select("code", "date", (F.col("n") - last_at(F.col("up")) + 1).alias("streak"), F.when(F.col("up"), true).otherwise(0).alias("true_streak"), F.when(lag("up"), -(F.col("close") / F.col("pc") - 1)).alias("reversal"))


def sessions(d: Data):
    """Morning and afternoon of each bar: the records of odd and even parts."""
    half = F.col("part") % 2
    t = d.trades.groupBy("code", "date").agg(
        *[F.min_by(F.when(half == k, F.col("price")), F.when(half == k, F.col("seq"))).alias(f"{n}_open") for k, n in ((1, "am"), (0, "pm"))],
        *[F.max(F.when(half == k, F.col("price"))).alias(f"{n}_high") for k, n in ((1, "am"), (0, "pm"))],
        *[F.min(F.when(half == k, F.col("price"))).alias(f"{n}_low") for k, n in ((1, "am"), (0, "pm"))],
        *[F.sum(F.when(half == k, F.col("quantity"))).alias(f"{n}_vol") for k, n in ((1, "am"), (0, "pm"))],
    )
    return d.bars.join(t, ["code", "date"])


SESSIONS = "t AS (SELECT code, date, " + ", ".join(
    f"arg_min(price, seq) FILTER (part % 2 = {k}) AS {n}_open, max(price) FILTER (part % 2 = {k}) AS {n}_high, min(price) FILTER (part % 2 = {k}) AS {n}_low, sum(quantity) FILTER (part % 2 = {k}) AS {n}_vol" for k, n in ((1, "am"), (0, "pm"))
) + " FROM trades GROUP BY code, date), s AS (SELECT bars.*, t.* EXCLUDE (code, date) FROM bars JOIN t USING (code, date))"


#: A morning at or beyond this share from the last close is at its limit.
LIMIT = 0.3
FLAGS = "am_up_limit am_down_limit"
SHARES = "am_gap am_range am_range_share am_vol_share pm_gap pm_range"


@query("w26_sessions", "code date " + FLAGS, SHARES,
       SESSIONS + f""", f AS (SELECT code, date, am_open / {slag('close')} - 1 AS am_gap, am_high / am_low - 1 AS am_range, (am_high - am_low) / nullif(high - low, 0) AS am_range_share, am_vol / volume AS am_vol_share,
CAST(coalesce(am_high >= {1 + LIMIT} * {slag('close')}, false) AS INT) AS am_up_limit, CAST(coalesce(am_low <= {1 - LIMIT} * {slag('close')}, false) AS INT) AS am_down_limit,
pm_open / am_low - 1 AS pm_gap, pm_high / pm_low - 1 AS pm_range FROM s) ;; SELECT code, date, {', '.join(f'{slag(c)} AS {c}' for c in (SHARES + " " + FLAGS).split())} FROM f""")  # fmt: skip
def w26(d: Data):
    at_limit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    f = sessions(d).select(
        "code", "date",
        (F.col("am_open") / lag("close") - 1).alias("am_gap"), (F.col("am_high") / F.col("am_low") - 1).alias("am_range"),
        F.try_divide(F.col("am_high") - F.col("am_low"), F.col("high") - F.col("low")).alias("am_range_share"), (F.col("am_vol") / F.col("volume")).alias("am_vol_share"),
        (F.col("pm_open") / F.col("am_low") - 1).alias("pm_gap"), (F.col("pm_high") / F.col("pm_low") - 1).alias("pm_range"),
        at_limit(F.col("am_high") >= (1 + LIMIT) * lag("close")).alias("am_up_limit"), at_limit(F.col("am_low") <= (1 - LIMIT) * lag("close")).alias("am_down_limit"),
    )
    return f.select("code", "date", *[lag(c).alias(c) for c in f.columns[2:]])  # end-of-day mode: known on the next row


@query("w27_morning_position", "code date", "am_pos am_vol_ratio",
       SESSIONS + f" ;; SELECT code, date, (am_high - low) / nullif(high - low, 0) AS am_pos, am_vol / nullif({slroll('avg', 'am_vol', 20, 5)}, 0) AS am_vol_ratio FROM s")
def w27(d: Data):
    return sessions(d).select("code", "date", F.try_divide(F.col("am_high") - F.col("low"), F.col("high") - F.col("low")).alias("am_pos"), ratio("am_vol", lroll(F.avg, "am_vol", 20, 5)).alias("am_vol_ratio"))


@query("w28_changes", "code date changed since_change changed_5", "",
       IDX + f""", a AS (SELECT *, (code + year(date)) % 5 AS segment FROM i), c AS (SELECT *, coalesce(segment <> {slag('segment')}, false) AS changed FROM a) ;;
SELECT code, date, changed, n - last_value(CASE WHEN changed THEN n END IGNORE NULLS) OVER {over('all', 0)} AS since_change, max(CAST(changed AS INT)) OVER {over(-4, 0)} = 1 AS changed_5 FROM c""")  # fmt: skip
def w28(d: Data):
    a = numbered(d.bars).withColumn("segment", (F.col("code") + F.year("date")) % 5)
    c = a.withColumn("changed", F.coalesce(F.col("segment") != lag("segment"), F.lit(False)))
    return c.select("code", "date", "changed", (F.col("n") - last_at(F.col("changed"))).alias("since_change"), (F.max(F.col("changed").cast("int")).over(frame(-4, 0)) == 1).alias("changed_5"))


ISLANDS = f"c AS (SELECT *, floor(close / 100) AS level FROM bars), e AS (SELECT *, CASE WHEN level = {slag('level')} THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER {over('all', 0)} AS island FROM e)"


@query("w29_price_freeze", "code start stop days", "",
       ISLANDS + " ;; SELECT code, min(date) AS start, max(date) AS stop, count(*) AS days FROM g GROUP BY code, island HAVING count(*) >= 3")
def w29(d: Data):
    level = d.bars.withColumn("level", F.floor(F.col("close") / 100))
    return runs.islands(level, "code", "date", F.col("level")).groupBy("code", "island").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("days")).where("days >= 3")


@query("w30_streaks", "code date direction streak", "persistence",
       RETURNS.replace(";;", "") + f""", s AS (SELECT *, CAST(coalesce(sign(r), 0) AS INT) AS direction FROM b), e AS (SELECT *, CASE WHEN direction = {slag('direction')} THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER {over('all', 0)} AS island FROM e) ;; SELECT code, date, direction, row_number() OVER (PARTITION BY code, island ORDER BY date) AS streak,
avg(CASE WHEN direction > 0 THEN 1.0 ELSE 0.0 END) OVER {over(-4, 0)} AS persistence FROM g""")  # fmt: skip
def w30(d: Data):
    s = _returns(d).withColumn("direction", F.coalesce(F.signum("r"), F.lit(0.0)).cast("int"))
    g = runs.islands(s, "code", "date", F.col("direction"))
    return g.select("code", "date", "direction", F.row_number().over(Window.partitionBy("code", "island").orderBy("date")).alias("streak"), F.avg(F.when(F.col("direction") > 0, 1.0).otherwise(0.0)).over(frame(-4, 0)).alias("persistence"))


@query("w31_drawdown", "code date since_peak", "peak drawdown",
       IDX + f", p AS (SELECT *, max(close) OVER {over(-59, 0)} AS peak, max_by(n, struct_pack(c := close, n := n)) OVER {over(-59, 0)} AS pk FROM i) ;; SELECT code, date, peak, close / peak - 1 AS drawdown, n - pk AS since_peak FROM p")
def w31(d: Data):
    w = frame(-59, 0)
    p = numbered(d.bars).withColumns({"peak": F.max("close").over(w), "at": F.max(F.struct("close", "n")).over(w)["n"]})
    return p.select("code", "date", "peak", (F.col("close") / F.col("peak") - 1).alias("drawdown"), (F.col("n") - F.col("at")).alias("since_peak"))


@query("w32_local_extremes", "code date is_max is_min", "",
       f"SELECT code, date, coalesce({' AND '.join(f'close >= {g}' for k in (1, 2, 3) for g in (slag('close', k), slead('close', k)))}, false) AS is_max, coalesce({' AND '.join(f'close <= {g}' for k in (1, 2, 3) for g in (slag('close', k), slead('close', k)))}, false) AS is_min FROM bars")
def w32(d: Data):
    near = [g("close", k) for k in (1, 2, 3) for g in (lag, lead)]
    up, down = F.lit(True), F.lit(True)
    for x in near:
        up, down = up & (F.col("close") >= x), down & (F.col("close") <= x)
    return d.bars.select("code", "date", F.coalesce(up, F.lit(False)).alias("is_max"), F.coalesce(down, F.lit(False)).alias("is_min"))


@query("w33_validity", "code date valid_20 valid_60 core", "",
       IDX + " ;; SELECT code, date, CAST(n >= 20 AS INT) AS valid_20, CAST(n >= 60 AS INT) AS valid_60, least(CAST(n >= 20 AS INT), CAST(n >= 60 AS INT), CAST(volume > 0 AS INT)) AS core FROM i")
def w33(d: Data):
    flags = {"valid_20": (F.col("n") >= 20).cast("int"), "valid_60": (F.col("n") >= 60).cast("int")}
    return numbered(d.bars).select("code", "date", *[c.alias(k) for k, c in flags.items()], F.least(*flags.values(), (F.col("volume") > 0).cast("int")).alias("core"))


@query("w34_lookback_windows", "code date length", "first_close last_close total",
       f"""v AS (SELECT code, date, list(close) OVER {over(-9, 0)} AS a FROM bars) ;; SELECT code, date, len(a) AS length, a[1] AS first_close, a[10] AS last_close, list_sum(a) AS total FROM v WHERE len(a) = 10""")
def w34(d: Data):
    v = d.bars.select("code", "date", F.collect_list(F.array("close", "volume")).over(frame(-9, 0)).alias("window")).where(F.size("window") == 10)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return v.select("code", "date", F.size("window").cast("long").alias("length"), F.col("window")[0][0].alias("first_close"), F.col("window")[9][0].alias("last_close"), total.alias("total"))


@query("w35_calendar_year_sum", "code published", "sum_365",
       "s AS (SELECT code, published, sum(amount) AS a FROM snapshots GROUP BY code, published) ;; SELECT code, published, sum(a) OVER (PARTITION BY code ORDER BY published RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS sum_365 FROM s", "snapshots")
def w35(d: Data):
    s = d.snapshots.groupBy("code", "published").agg(F.sum("amount").alias("a"))
    days = F.datediff("published", F.lit("1970-01-01"))
    return s.withColumn("sum_365", F.sum("a").over(Window.partitionBy("code").orderBy(days).rangeBetween(-365, 0)))


@query("w36_next_amount", "rec code published next_rec", "next_amount",
       """f AS (SELECT *, published + INTERVAL 30 DAY AS ex FROM snapshots), c AS (SELECT code, ex, min(rec) AS rec, arg_min(amount, rec) AS amount FROM f GROUP BY code, ex),
a AS (SELECT s.rec, s.code, s.published, c.rec AS next_rec, c.amount AS next_amount FROM snapshots s ASOF LEFT JOIN c ON s.code = c.code AND s.published <= c.ex) ;; SELECT * FROM a""", "snapshots")  # fmt: skip
def w36(d: Data):
    s = d.snapshots
    ex = s.select("code", F.date_add("published", 30).alias("at"), "rec", "amount").groupBy("code", "at").agg(F.min("rec").alias("next_rec"), F.min_by("amount", "rec").alias("next_amount"))
    from ..operators.asof import asof_join

    return asof_join(s.withColumn("at", F.col("published")), ex, ["code"], "at", ["next_rec", "next_amount"], forward=True)


@query("w37_market_correlation", "code date", "corr20 excess",
       WITH_MARKET + f""", p AS (SELECT *, CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN mr END AS y FROM bm) ;;
SELECT code, date, CASE WHEN count(x) OVER o >= 20 THEN corr(x, y) OVER o END AS corr20, r - mr AS excess FROM p WINDOW o AS {over(-19, 0)}""", "bars market")  # fmt: skip
def w37(d: Data):
    b = with_market(d)
    both = F.col("r").isNotNull() & F.col("mr").isNotNull()
    b = b.withColumns({"x": F.when(both, F.col("r")), "y": F.when(both, F.col("mr"))})
    o = frame(-19, 0)
    return b.select("code", "date", F.when(F.count("x").over(o) >= 20, correlation("x", "y", o)).alias("corr20"), (F.col("r") - F.col("mr")).alias("excess"))
