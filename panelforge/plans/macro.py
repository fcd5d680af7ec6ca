"""Macro blocks: single series in the style of their kind, regimes across series, regime signals of the market (D43, D44, P18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import frame, lag
from ..operators import graphs, macro
from ..sources.tables import Data
from .registry import query
from .sql import lag as slag
from .sql import over
from .sql import roll as sroll

# Series are the parts modulo 12, a role each.
SERIES = "qs AS MATERIALIZED (SELECT part % 12 AS code, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(quantity) AS volume FROM trades GROUP BY ALL)"


def series(d: Data):
    return d.trades.groupBy((F.col("part") % 12).alias("code"), "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume")
    )


def sstandard(x: str, n: int, least: int) -> str:
    return f"({x} - ({sroll('avg', x, n, least)})) / (({sroll('stddev_samp', x, n, least)}) + 1e-9)"


def sblock(s: macro.Style) -> str:
    year = f"sqrt({s.year}::DOUBLE)"
    return SERIES + f""", q1 AS (SELECT *, {', '.join(f"close / {slag('close', n)} - 1 AS ret_{n}" for n in (1, 5, 10, 20))} FROM qs),
q2 AS MATERIALIZED (SELECT *, {sroll('avg', 'close', *s.fast)} AS f, {sroll('avg', 'close', *s.slow)} AS s, {sroll('avg', 'close', *s.short)} AS h, {year} * ({sroll('stddev_samp', 'ret_1', 20, 10)}) AS vol_20, {year} * ({sroll('stddev_samp', 'ret_1', 60, 20)}) AS vol_60,
{sstandard('close', *s.long)} AS z_long, {sstandard('close', *s.short)} AS z_short FROM q1),
q3 AS (SELECT *, ln(close + 1e-9) AS log_close, abs(ret_1) AS abs_ret, (f - s) / (s + 1e-9) AS trend, f / ({slag('f', 3)} + 1e-9) - 1 AS slope_3, close / s - 1 AS gap_slow, close / h - 1 AS gap_short, (high - low) / (close + 1e-9) AS range_pct, {sstandard('vol_20', 252, 60)} AS vol_z,
(volume + 1e-9) / (({sroll('avg', 'volume', 20, 10)}) + 1e-9) AS volume_ratio FROM q2) ;;
SELECT *, CAST(coalesce(f > s, false) AS INT) AS trend_up, CAST(coalesce({s.spike}, false) AS INT) AS spike, CAST(coalesce(abs_ret > {s.shock}, false) AS INT) AS shock, CAST(coalesce(vol_20 > {s.turbulent}, false) AS INT) AS turbulent FROM q3"""


for _name, _style in (("volatility", macro.VOLATILITY), ("exchange", macro.EXCHANGE), ("coin", macro.COIN)):

    @query(f"d44_{_name}_series", "code date " + " ".join(macro.FLAGS), " ".join(macro.NUMBERS), sblock(_style), "trades")
    def _block(d: Data, style=_style):
        return macro.series_block(series(d), style)


ROLES = dict(enumerate(macro.ROLES))


def _schange(x: str, n: int) -> str:
    return f"{x} / {slag(x, n)} - 1"


def _srobust(source: str, name: str, x: str, out: str) -> str:
    return f"{name}_m AS (SELECT *, {sroll('median', x, 252, 60)} AS med_{x} FROM {source}), {name}_d AS (SELECT *, abs({x} - med_{x}) AS off_{x} FROM {name}_m), {name} AS (SELECT *, ({x} - med_{x}) / (({sroll('median', f'off_{x}', 252, 60)}) + 1e-9) AS {out} FROM {name}_d)"


_FILLED = [*macro.ROLES, "equity_open", "equity_volume", "growth_volume"]
_PICKED = [f"max(close) FILTER (code = {k}) AS {role}" for k, role in ROLES.items()] + ["max(open) FILTER (code = 0) AS equity_open", "max(volume) FILTER (code = 0) AS equity_volume", "max(volume) FILTER (code = 1) AS growth_volume"]


@query("d43_regime_block", "date vrp_high", " ".join(macro.REGIME),
       SERIES + f""", w0 AS MATERIALIZED (SELECT date, {', '.join(_PICKED)} FROM qs GROUP BY date),
w1 AS MATERIALIZED (SELECT 0 AS code, date, {', '.join(f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in _FILLED)} FROM w0),
w2 AS MATERIALIZED (SELECT *, {', '.join(f"{_schange(x, 1)} AS r_{x}" for x in ('equity', 'growth', 'coin'))} FROM w1),
w3 AS MATERIALIZED (SELECT *, {', '.join(f"sqrt(252::DOUBLE) * ({sroll('stddev_samp', f'r_{x}', 20, 10)}) AS {x}_rv20" for x in ('equity', 'growth', 'coin'))}, sqrt(252::DOUBLE) * ({sroll('stddev_samp', 'r_equity', 63, 30)}) AS rv63, {', '.join(f"{_schange(x, 63)} AS {x}_mom63" for x in ('equity', 'growth', 'coin'))},
{', '.join(f"{x}_volume / (({sroll('median', f'{x}_volume', 20, 10)}) + 1e-9) - 1 AS {x}_surge, ({sroll('avg', x, 20, 20)}) AS {x}_20, ({sroll('avg', x, 100, 50)}) AS {x}_100" for x in ('equity', 'growth'))},
({sroll('min', 'equity', 252, 126)}) AS lo, ({sroll('max', 'equity', 252, 126)}) AS hi, credit_high / (credit_low + 1e-9) - 1 AS credit, rates_long / (rates_mid + 1e-9) - 1 AS term_rates, vi_long - vi AS vi_slope, vi_short / (vi_long + 1e-9) - 1 AS vi_ratio,
equity_open / {slag('equity')} - 1 AS overnight, equity / (equity_open + 1e-9) - 1 AS intraday, {', '.join(f"{_schange('fx', n)} AS fx_ret_{n}" for n in (1, 5, 20))}, {sstandard('fx', 20, 10)} AS fx_z FROM w2),
w4 AS MATERIALIZED (SELECT *, equity_rv20 - rv63 AS equity_drv, (equity_20 - equity_100) / (equity_100 + 1e-9) AS equity_gap, (growth_20 - growth_100) / (growth_100 + 1e-9) AS growth_gap, (equity - lo) / (hi - lo + 1e-9) AS equity_pos52, coin_mom63 / (equity_mom63 + 1e-9) - 1 AS coin_rel, power(vi / 100, 2) - power(equity_rv20, 2) AS vrp FROM w3),
w5 AS MATERIALIZED (SELECT *, {sstandard('vrp', 252, 126)} AS vrp_z, {sstandard('credit', 63, 30)} AS credit_z, {sstandard('term_rates', 63, 30)} AS term_rates_z, {sstandard('vi_slope', 126, 60)} AS vi_slope_z FROM w4),
{_srobust('w5', 'w6', 'vi', 'vi_z')}, {_srobust('w6', 'w7', 'dollar', 'dollar_z')} ;;
SELECT *, CAST(coalesce(vrp_z > 1, false) AS INT) AS vrp_high FROM w7""", "trades")  # fmt: skip
def d43_block(d: Data):
    """The regime of the twelve series by date."""
    return macro.regime_block(macro.wide(series(d), ROLES))


# Regime signals look SPAN days back; pairs of codes need LEAST common dates and an absolute correlation of EDGE.
SPAN, LEAST, EDGE = 20, 10, 1e-6
# Limits suit the moves of the given tables.
LIMITS = macro.Limits(bear_vol=0.27, bull_vol=0.26, momentum=0.005)
TARGET = 0.15
LEVELS = f"""lv0 AS (SELECT code, date, CASE WHEN count(*) OVER w = 60 THEN sum(turnover) OVER w / sum(volume) OVER w END AS level FROM bars WINDOW w AS {over(-59, 0)}),
lr AS (SELECT * FROM (SELECT code, date, ln(level / {slag('level')}) AS r FROM lv0) WHERE r IS NOT NULL)"""


def level_returns(d: Data):
    """(code, date, r): log returns of a code's index, the mean price of what was traded in its last 60 bars (as in Data.pred)."""
    w = frame(-59, 0)
    level = d.bars.select("code", "date", F.when(F.count(F.lit(1)).over(w) == 60, F.sum("turnover").over(w) / F.sum("volume").over(w)).alias("level"))
    return level.select("code", "date", F.log(F.col("level") / lag("level")).alias("r")).where("r is not null")


@query("p18_regime_signals", "date regime", "vol mom max_dd mean_corr confidence exposure",
       LEVELS + f""", x AS MATERIALIZED (SELECT * FROM dense), o AS (SELECT code, date, list(r) OVER w AS rs, stddev_samp(r) OVER w AS dev FROM lr WINDOW w AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL {SPAN} DAYS PRECEDING AND CURRENT ROW)),
l AS (SELECT date, dev, list_transform(rs, lambda v, i: CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE list_sum(rs[2:i]) END) AS lv FROM o),
k AS (SELECT date, dev, exp(lv[len(lv)]) - 1 AS mom, exp(list_min(list_transform(lv, lambda v, i: v - list_max(lv[1:i])))) - 1 AS fall FROM l),
g AS (SELECT date, avg(dev) * sqrt(252::DOUBLE) AS vol, avg(mom) AS mom, abs(min(fall)) AS max_dd FROM k GROUP BY date),
own AS MATERIALIZED (SELECT code, date, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM x WINDOW w AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL {SPAN} DAYS PRECEDING AND CURRENT ROW)),
fit AS MATERIALIZED (SELECT * FROM own WHERE n >= {LEAST} AND s > {graphs.FLAT!r}),
pr AS (SELECT a.code AS src, b.code AS dst, a.date, count(*) OVER w AS n, sum(a.r * b.r) OVER w AS xy, sum(a.r) OVER w AS sx, sum(b.r) OVER w AS sy FROM x a JOIN x b ON a.date = b.date AND a.code < b.code WINDOW w AS (PARTITION BY a.code, b.code ORDER BY a.date RANGE BETWEEN INTERVAL {SPAN} DAYS PRECEDING AND CURRENT ROW)),
c AS (SELECT date, avg(w) AS mean_corr FROM (SELECT p.date, abs((xy - a.m * sy - b.m * sx + p.n * a.m * b.m) / ((p.n - 1) * a.s * b.s)) AS w FROM pr p JOIN fit a ON a.code = src AND a.date = p.date JOIN fit b ON b.code = dst AND b.date = p.date WHERE p.n >= {LEAST}) WHERE round(w, 9) >= {EDGE!r} GROUP BY date),
s AS (SELECT g.*, coalesce(mean_corr, 0.5) AS mean_corr, coalesce(vol > {LIMITS.crisis_vol} AND max_dd > {LIMITS.crisis_drawdown}, false) AS crisis, coalesce(vol > {LIMITS.bear_vol} AND mom < -{LIMITS.momentum}, false) AS bear, coalesce(vol < {LIMITS.bull_vol} AND mom > {LIMITS.momentum}, false) AS bull FROM g LEFT JOIN c ON c.date = g.date),
f AS (SELECT *, CASE WHEN crisis THEN least(1.0, vol / {LIMITS.crisis_vol} * (max_dd / {LIMITS.crisis_drawdown})) WHEN bear THEN least(1.0, vol / {LIMITS.bear_vol} * abs(mom) * 10) WHEN bull THEN least(1.0, (1 - vol / {LIMITS.bull_vol}) * mom * 10) ELSE greatest(0.3, least(0.8, 1 - abs(mom) * 5)) END AS confidence FROM s) ;;
SELECT *, CASE WHEN crisis THEN 'crisis' WHEN bear THEN 'bear' WHEN bull THEN 'bull' ELSE 'sideways' END AS regime,
greatest(0.1, least(1.0, CASE WHEN crisis THEN 0.2 WHEN bear THEN 0.5 ELSE 1.0 END * CASE WHEN vol > 0 THEN least(1.0, {TARGET} / vol) ELSE 1.0 END * CASE WHEN confidence < 0.5 THEN 0.7 ELSE 1.0 END)) AS exposure FROM f""", "bars dense")  # fmt: skip
def p18_signals(d: Data):
    """Volatility, momentum, deepest fall and mean absolute correlation of the codes by date, with the regime, its confidence and the exposure."""
    pairs = graphs.rolling_mean(d.dense, SPAN, LEAST, EDGE).withColumnRenamed("mean_abs", "_corr")
    s = macro.regime_signals(level_returns(d), SPAN).join(pairs, "date", "left").withColumn("mean_corr", F.coalesce("_corr", F.lit(0.5)))
    return macro.regimes(s, LIMITS, TARGET)
