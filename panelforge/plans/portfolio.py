"""Score post-processing and portfolio accounting (P rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_date, EPS, average_rank, clip, correlation, ratio, roll
from ..operators import book, select
from ..sources.tables import Data
from .registry import query
from .sql import average_rank as saverage_rank
from .sql import over
from .sql import roll as sroll
from .sql import solved


def by_set():
    return Window.partitionBy("set").orderBy("date")


@query("p1_mean_ensemble", "date code", "score", "SELECT date, code, avg(score) AS score FROM pred GROUP BY date, code HAVING count(*) = 3", "pred")
def p1(d: Data):
    return d.pred.groupBy("date", "code").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).where("n = 3")


RANKS = f"rk AS (SELECT *, {saverage_rank('-score', 'set, date')} AS r FROM pred)"


def ranks(d: Data):
    return d.pred.withColumn("r", average_rank(-F.col("score"), "set", "date"))


@query("p2_rank_ensemble", "date code", "score",
       RANKS + ", z AS (SELECT date, code, -(r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0) AS z FROM rk WINDOW w AS (PARTITION BY set, date)) ;; SELECT date, code, avg(coalesce(z, 0)) AS score FROM z GROUP BY date, code", "pred")
def p2(d: Data):
    w = Window.partitionBy("set", "date")
    z = -ratio(F.col("r") - F.avg("r").over(w), F.stddev_pop("r").over(w))
    return ranks(d).select("date", "code", F.coalesce(z, F.lit(0.0)).alias("z")).groupBy("date", "code").agg(F.avg("z").alias("score"))


@query("p3_uncertainty_filter", "date code", "spread",
       RANKS + ", s AS (SELECT date, code, round(stddev_samp(r), 9) AS spread FROM rk GROUP BY date, code), c AS (SELECT date, quantile_cont(spread, 0.5) AS cut FROM s GROUP BY date) ;; SELECT s.date, code, spread FROM s JOIN c ON s.date = c.date WHERE spread <= cut + 1e-9", "pred")
def p3(d: Data):
    r = d.dealt(d.pred, "date").withColumn("r", average_rank(-F.col("score"), "set", "date"))  # all that follows is within dates
    s = r.groupBy("date", "code").agg(F.round(F.stddev_samp("r"), 9).alias("spread"))
    cuts = s.groupBy("date").agg(F.percentile("spread", 0.5).alias("cut"))
    return s.join(cuts, "date").where("spread <= cut + 1e-9")


HELD = "(code + date_diff('day', DATE '1995-01-01', date)) % 4 = 0"


def held():
    return (F.col("code") + F.datediff("date", F.lit("1995-01-01"))) % 4 == 0


@query("p4_hysteresis", "set date code was_held", "score",
       f"""q AS (SELECT *, {HELD} AS was_held, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS r FROM pred), k AS (SELECT * FROM q WHERE (was_held AND r <= 8) OR (NOT was_held AND r <= 5)),
f AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS r2 FROM k) ;; SELECT set, date, code, was_held, score FROM f WHERE r2 <= 5""", "pred")  # fmt: skip
def p4(d: Data):
    holdings = d.pred.where(held()).select("set", "date", "code")
    return book.hysteresis(d.pred, holdings, ["set", "date"], enter=5, leave=8)


FACTORS, ALPHA, GAMMA, CAP = ("volume", "turnover", "ret"), 10.0, 0.3, 0.25
#: Markets are numbered from 0 to 4.
GROUPS = 5


def _p5() -> str:
    w = "WINDOW w AS (PARTITION BY set, date)"
    raw = [f"{c}::DOUBLE" for c in FACTORS] + [f"(market = {g} AND market > min(market) OVER (PARTITION BY set, date))::INT::DOUBLE" for g in range(1, GROUPS)]
    n = len(raw)
    raws = ", ".join(f"{c} AS f{i}" for i, c in enumerate(raw))
    x = ", ".join(f"coalesce((f{i} - avg(f{i}) OVER w) / CASE WHEN coalesce(stddev_samp(f{i}) OVER w, 0) > 1e-12 THEN stddev_samp(f{i}) OVER w ELSE 1 END, 0)" for i in range(n))
    rows = ", ".join("[" + ", ".join([f"sum(x[{i}] * x[{j}]) + {ALPHA if i == j else 0.0}" for j in range(1, n + 1)] + [f"sum(x[{i}] * y)"]) + "]" for i in range(1, n + 1))
    squares = ", ".join(f"sum(x[{i}] * x[{i}])" for i in range(1, n + 1))
    fit = " + ".join(f"b[{i}] * x[{i}]" for i in range(1, n + 1))
    t = ", ".join(f"abs(b[{i}] / (sqrt(rss / (n - p - 1) / (q[{i}] + 1e-10)) + 1e-10))" for i in range(1, n + 1))
    return f"""r AS (SELECT set, date, code, score, market, {raws} FROM pred),
z AS (SELECT set, date, code, score, [{x}] AS x, avg(score) OVER w AS my, stddev_pop(score) OVER w AS sy FROM r {w}),
u AS MATERIALIZED (SELECT *, (score - my) / sy AS y FROM z WHERE sy > 1e-6),
c AS (SELECT set, date, [{rows}] AS m FROM u GROUP BY set, date), k AS (SELECT set, date, count(*) AS n, [{squares}] AS q, any_value(sy) AS sy FROM u GROUP BY set, date),
g AS (SELECT set, date, count(DISTINCT market) - 1 + {len(FACTORS)} AS p FROM pred GROUP BY set, date), {solved("s", "c", "set, date", n)},
f AS (SELECT u.*, {fit} AS fit FROM u JOIN s ON u.set = s.set AND u.date = s.date), e AS (SELECT set, date, sum((y - fit) * (y - fit)) AS rss, sum(y * y) AS tss FROM f GROUP BY set, date),
t AS (SELECT e.set, e.date, round(1 - rss / tss, 9) >= 0.05 AND (n <= p + 1 OR round(greatest({t}), 9) >= 2) AS used FROM e JOIN k ON e.set = k.set AND e.date = k.date JOIN g ON e.set = g.set AND e.date = g.date JOIN s ON e.set = s.set AND e.date = s.date),
v AS (SELECT f.*, used, y - {GAMMA} * fit - avg(y - {GAMMA} * fit) OVER o AS h, stddev_pop(y - {GAMMA} * fit) OVER o AS sh FROM f JOIN t ON f.set = t.set AND f.date = t.date WINDOW o AS (PARTITION BY f.set, f.date)),
d AS (SELECT set, date, code, CASE WHEN used THEN greatest(-{CAP} * sy, least({CAP} * sy, h * CASE WHEN sh > 1e-6 THEN sy / sh ELSE 1 END + my - score)) ELSE 0 END AS shift, used FROM v) ;;
SELECT pred.set, pred.date, pred.code, coalesce(used, false) AS used, score + coalesce(shift, 0) AS neutral FROM pred LEFT JOIN d ON d.set = pred.set AND d.date = pred.date AND d.code = pred.code"""


@query("p5_risk_neutralisation", "set date code used", "neutral", _p5(), "pred")
def p5(d: Data):
    levels = [F.lit(g) for g in range(1, GROUPS)]
    return book.risk_neutral(d.pred, ["set", "date"], "score", list(FACTORS), "market", levels, ALPHA, GAMMA, CAP)


@query("p6_group_neutralise", "set date code", "weight",
       """a AS (SELECT set, date, code, score - avg(score) OVER (PARTITION BY set, date, sector) AS x FROM pred), q AS (SELECT set, date, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM a GROUP BY set, date),
c AS (SELECT a.set, a.date, code, greatest(lo, least(hi, x)) AS x FROM a JOIN q ON a.set = q.set AND a.date = q.date), g AS (SELECT *, x / nullif(sum(abs(x)) OVER (PARTITION BY set, date), 0) AS w FROM c), k AS (SELECT *, greatest(-0.25, least(0.25, w)) AS v FROM g WHERE w IS NOT NULL) ;;
SELECT set, date, code, v / nullif(sum(abs(v)) OVER (PARTITION BY set, date), 0) AS weight FROM k""", "pred")  # fmt: skip
def p6(d: Data):
    w = Window.partitionBy("set", "date")
    a = d.pred.select("set", "date", "code", (F.col("score") - F.avg("score").over(Window.partitionBy("set", "date", "sector"))).alias("x"))
    q = a.groupBy("set", "date").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    c = a.join(q, ["set", "date"]).withColumn("x", F.greatest(F.col("q")[0], F.least(F.col("q")[1], F.col("x"))))
    g = c.withColumn("w", ratio("x", F.sum(F.abs("x")).over(w))).where("w is not null").withColumn("v", clip("w", -0.25, 0.25))
    return g.withColumn("weight", ratio("v", F.sum(F.abs("v")).over(w)))


@query("p7_residualise", "set date code", "residual",
       """m AS (SELECT set, avg(score) AS my, avg(volume) AS mx, covar_samp(score, volume) / (var_samp(volume) + 1.0) AS b FROM pred GROUP BY set) ;; SELECT p.set, date, code, score - my - b * (volume - mx) AS residual FROM pred p JOIN m ON p.set = m.set""", "pred")  # fmt: skip
def p7(d: Data):
    m = d.pred.groupBy("set").agg(F.avg("score").alias("my"), F.avg("volume").alias("mx"), (F.covar_samp("score", "volume") / (F.var_samp("volume") + 1.0)).alias("b"))
    return d.pred.join(F.broadcast(m), "set").withColumn("residual", F.col("score") - F.col("my") - F.col("b") * (F.col("volume") - F.col("mx")))  # one row for each set


def _weights(modes: bool) -> str:
    """Frames w (weights), tr (trades) and dy (daily returns), by set or by set and mode."""
    key = ["set", "mode"] if modes else ["set"]
    ks, same = ", ".join(key), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key)
    w = "w AS (SELECT set, mode, date, code, step, w FROM wv, (VALUES ('ls'), ('lo'), ('so')) m(mode) WHERE mode = 'ls' OR (mode = 'lo') = (w > 0))" if modes else "w AS (SELECT * FROM wv)"
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS rh, row_number() OVER (PARTITION BY set, date ORDER BY score, code) AS rl, greatest(1, floor(0.2::DOUBLE * count(*) OVER (PARTITION BY set, date))) AS k FROM pred),
wv AS (SELECT set, date, code, step, CASE WHEN rh <= k THEN 1.0 / k WHEN rl <= k THEN -1.0 / k END AS w FROM q WHERE rh <= k OR rl <= k), {w},
dd AS (SELECT {ks}, date, lead(date) OVER (PARTITION BY {ks} ORDER BY date) AS nd FROM (SELECT DISTINCT {ks}, date FROM w)),
pv AS (SELECT {", ".join(f"w.{k}" for k in key)}, dd.nd AS date, code, w AS pw FROM w JOIN dd ON {same("w", "dd")} AND w.date = dd.date WHERE nd IS NOT NULL),
tr AS (SELECT {", ".join(f"coalesce(w.{k}, pv.{k}) AS {k}" for k in key)}, coalesce(w.date, pv.date) AS date, coalesce(w.code, pv.code) AS code, coalesce(w.w, 0) - coalesce(pv.pw, 0) AS dw, coalesce(w.w, 0) AS w, coalesce(w.step, 0) AS step FROM w FULL JOIN pv ON {same("w", "pv")} AND w.date = pv.date AND w.code = pv.code),
dy AS (SELECT {ks}, date, sum(w * step) AS gross, sum(abs(dw)) / 2 AS turnover, sum(w * step) - 0.0010::DOUBLE * sum(abs(dw)) / 2 AS net FROM tr GROUP BY {ks}, date)"""


WEIGHTS, MODES = _weights(False), _weights(True)


def weights(d: Data):
    """Equal weights of the best and worst fifth of each set and date."""
    w = Window.partitionBy("set", "date")
    k = F.greatest(F.lit(1), F.floor(F.lit(0.2) * F.count(F.lit(1)).over(w)))
    q = d.dealt(d.pred, "set", "date").withColumns({"rh": F.row_number().over(w.orderBy(F.desc("score"), "code")), "rl": F.row_number().over(w.orderBy("score", "code")), "k": k})
    return q.where("rh <= k or rl <= k").select("set", "date", "code", F.col("step").alias("label"), (F.when(F.col("rh") <= F.col("k"), 1.0).otherwise(-1.0) / F.col("k")).alias("w"))


def by_mode(d: Data):
    """Daily returns of both sides (ls), the long (lo) and the short side (so) of each set."""
    modes = F.array(F.lit("ls"), F.when(F.col("w") > 0, "lo").otherwise("so"))
    return book.daily_returns(weights(d).withColumn("mode", F.explode(modes)), ["set", "mode"], cost=0.0010)


def daily(d: Data):
    return book.daily_returns(weights(d), ["set"], cost=0.0010)


@query("p8_long_short_returns", "set mode date", "gross turnover net sharpe", MODES + " ;; SELECT *, avg(net) OVER m / nullif(stddev_samp(net) OVER m, 0) * sqrt(252) AS sharpe FROM dy WINDOW m AS (PARTITION BY set, mode)", "pred")
def p8(d: Data):
    whole = Window.partitionBy("set", "mode")  # one row for each date
    return by_mode(d).withColumn("sharpe", ratio(F.avg("net").over(whole), F.stddev_samp("net").over(whole)) * F.sqrt(F.lit(252.0)))


@query("p9_rebalance_calendar", "date daily weekly monthly", "",
       "c AS (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM calendar) ;; SELECT date, true AS daily, p IS NULL OR isodow(date) = 5 AS weekly, p IS NULL OR month(p) <> month(date) AS monthly FROM c", "calendar")
def p9(d: Data):
    c = d.calendar.withColumn("p", F.lag("date").over(Window.orderBy("date")))  # one row for each date
    first = F.col("p").isNull()
    return c.select("date", F.lit(True).alias("daily"), (first | (F.weekday("date") == 4)).alias("weekly"), (first | (F.month("p") != F.month("date"))).alias("monthly"))


@query("p10_commission", "code date", "fee",
       "SELECT code, date, greatest(100.0, least(5000.0, turnover * CASE WHEN turnover < 10000 THEN 0.0010 WHEN turnover < 50000 THEN 0.0008 ELSE 0.0005 END)) AS fee FROM bars")
def p10(d: Data):
    return d.bars.withColumn("fee", book.commission(F.col("turnover")))


SLIP = f"sl AS (SELECT code, date, turnover, least(20.0, 5.0 + 100.0 * turnover / nullif({sroll('avg', 'turnover', 20, 1)}, 0) / 20) AS bps, greatest(100.0, least(5000.0, turnover * CASE WHEN turnover < 10000 THEN 0.0010 WHEN turnover < 50000 THEN 0.0008 ELSE 0.0005 END)) AS fee FROM bars)"


@query("p11_slippage", "code date", "bps total round_trip", SLIP + " ;; SELECT code, date, bps, turnover * bps / 10000 + fee AS total, 2 * (turnover * bps / 10000 + fee) AS round_trip FROM sl")
def p11(d: Data):
    return book.costs(d.bars, F.col("turnover"), roll(F.avg, "turnover", 20, 1))


@query("p12_cost_totals", "code trades", "cost traded cost_bps", SLIP + " ;; SELECT code, count(*) AS trades, sum(turnover * bps / 10000 + fee) AS cost, sum(turnover) AS traded, 10000 * sum(turnover * bps / 10000 + fee) / sum(turnover) AS cost_bps FROM sl GROUP BY code")
def p12(d: Data):
    c = book.costs(d.bars, F.col("turnover"), roll(F.avg, "turnover", 20, 1))
    return c.groupBy("code").agg(F.count(F.lit(1)).alias("trades"), F.sum("total").alias("cost"), F.sum("turnover").alias("traded"), (10000 * F.sum("total") / F.sum("turnover")).alias("cost_bps"))


@query("p13_turnover_step", "set date code", "step turnover", WEIGHTS + ", t AS (SELECT *, sum(abs(dw)) OVER (PARTITION BY set, date) / 2 AS turnover FROM tr) ;; SELECT set, date, code, w - dw + dw * CASE WHEN turnover > 0.35 THEN 0.35 / turnover ELSE 1 END AS step, turnover FROM t", "pred")
def p13(d: Data):
    return book.limited_step(book.trades(weights(d), ["set"]), ["set", "date"], 0.35)


@query("p14_cost_aware_targets", "set date code", "target alpha",
       f"""q AS (SELECT *, {HELD} AS was_held, score - CASE WHEN {HELD} THEN 0 ELSE 0.05 END AS s, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS r FROM pred), p AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY s DESC, code) AS r2, count(*) OVER (PARTITION BY set, date) AS n FROM q WHERE r <= 10),
t AS (SELECT set, date, code, was_held, 1.0 / least(5, n) AS w FROM p WHERE r2 <= 5), h AS (SELECT set, date, code, 1.0 / count(*) OVER (PARTITION BY set, date) AS hw FROM pred WHERE {HELD}),
j AS (SELECT coalesce(t.set, h.set) AS set, coalesce(t.date, h.date) AS date, coalesce(t.code, h.code) AS code, coalesce(w, 0) AS w, coalesce(hw, 0) AS hw FROM t FULL JOIN h ON t.set = h.set AND t.date = h.date AND t.code = h.code),
u AS (SELECT *, sum(abs(w - hw)) OVER (PARTITION BY set, date) / 2 AS turnover FROM j), a AS (SELECT *, greatest(0.1, least(1.0, CASE WHEN turnover > 0 THEN 0.35 / turnover ELSE 1 END)) AS alpha FROM u) ;; SELECT set, date, code, hw + alpha * (w - hw) AS target, alpha FROM a""", "pred")  # fmt: skip
def p14(d: Data):
    w = Window.partitionBy("set", "date")
    holdings = d.pred.where(held()).select("set", "date", "code", (1.0 / F.count(F.lit(1)).over(w)).alias("hw"))
    return book.cost_aware_targets(d.pred.withColumn("was_held", held()), holdings, ["set", "date"], k=5, multiplier=2, penalty=0.05, limit=0.35, least_alpha=0.1)


@query("p15_portfolio_value", "set date", "net value", WEIGHTS + " ;; SELECT set, date, net, exp(sum(ln(1 + greatest(net, -0.99))) OVER (PARTITION BY set ORDER BY date)) AS value FROM dy", "pred")
def p15(d: Data):
    return daily(d).withColumn("value", F.exp(F.sum(F.log(1 + F.greatest(F.col("net"), F.lit(-0.99)))).over(by_set())))


METRICS = WEIGHTS + """, rr AS (SELECT set, date, net AS r, turnover FROM dy), x AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY set ORDER BY date) AS lv FROM rr), y AS (SELECT *, lv - greatest(0, max(lv) OVER (PARTITION BY set ORDER BY date)) AS dd FROM x)"""
PMS = """count(*) AS days, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS annual, avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) AS sharpe, avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) * sqrt(252) AS sortino,
1 - exp(min(dd)) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(turnover) AS mean_turnover, exp(sum(ln(1 + r))) - 1 AS total, (exp(sum(ln(1 + r)) * 252 / count(*)) - 1) / nullif(1 - exp(min(dd)), 0) AS calmar, 0.0010::DOUBLE * sum(turnover) AS cost"""


def valued(d: Data):
    """Log value and drawdown."""
    x = daily(d).withColumn("r", F.col("net"))
    x = x.withColumn("lv", F.sum(F.log(1 + F.col("r"))).over(by_set()))
    return x.withColumn("dd", F.col("lv") - F.greatest(F.lit(0.0), F.max("lv").over(by_set())))


@query("p16_portfolio_metrics", "set days", "annual sharpe sortino max_drawdown win_rate mean_turnover total calmar cost", METRICS + f" ;; SELECT set, {PMS} FROM y GROUP BY set", "pred")
def p16(d: Data):
    return valued(d).groupBy("set").agg(*book.performance())


@query("p17_performance_by_year", "set yr days", "annual sharpe sortino max_drawdown win_rate mean_turnover total calmar cost", METRICS + f" ;; SELECT set, year(date) AS yr, {PMS} FROM y GROUP BY set, year(date)", "pred")
def p17(d: Data):
    return valued(d).groupBy("set", F.year("date").alias("yr")).agg(*book.performance())


@query("p18_market_regime", "date regime", "vol mom exposure",
       f"""r AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars), f AS (SELECT date, {sroll('stddev_samp', 'r', 20, 10)} AS v, {sroll('avg', 'r', 20, 10)} AS m FROM r), g AS (SELECT date, avg(v) AS vol, avg(m) AS mom FROM f GROUP BY date) ;;
SELECT date, vol, mom, CASE WHEN vol > 0.6 AND mom < 0 THEN 'crisis' WHEN vol > 0.6 THEN 'volatile' WHEN mom > 0 THEN 'bull' WHEN mom IS NULL THEN 'unknown' ELSE 'bear' END AS regime, CASE WHEN vol > 0.6 AND mom < 0 THEN 0.2 WHEN vol > 0.6 THEN 0.5 WHEN mom > 0 THEN 1.0 WHEN mom IS NULL THEN 0.0 ELSE 0.4 END AS exposure FROM g""")  # fmt: skip
def p18(d: Data):
    r = d.bars.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("code").orderBy("date")) - 1)
    f = r.select("date", roll(F.stddev_samp, "r", 20, 10).alias("v"), roll(F.avg, "r", 20, 10).alias("m"))
    g = f.groupBy("date").agg(F.avg("v").alias("vol"), F.avg("m").alias("mom"))
    pick = lambda a, b, c, u, e: F.when((F.col("vol") > 0.6) & (F.col("mom") < 0), a).when(F.col("vol") > 0.6, b).when(F.col("mom") > 0, c).when(F.col("mom").isNull(), u).otherwise(e)
    return g.withColumns({"regime": pick("crisis", "volatile", "bull", "unknown", "bear"), "exposure": pick(0.2, 0.5, 1.0, 0.0, 0.4)})


@query("p19_history_regime", "set date regime", "mean vol",
       WEIGHTS + f", h AS (SELECT set, date, {sroll('avg', 'net', 20, 10, by='set')} AS mean, {sroll('stddev_samp', 'net', 20, 10, by='set')} AS vol FROM dy) ;; SELECT set, date, mean, vol, CASE WHEN mean IS NULL THEN 'unknown' WHEN vol > 1 THEN 'stress' WHEN mean > 0 THEN 'good' ELSE 'poor' END AS regime FROM h", "pred")
def p19(d: Data):
    h = daily(d).select("set", "date", roll(F.avg, "net", 20, 10, by_set()).alias("mean"), roll(F.stddev_samp, "net", 20, 10, by_set()).alias("vol"))
    return h.withColumn("regime", F.when(F.col("mean").isNull(), "unknown").when(F.col("vol") > 1, "stress").when(F.col("mean") > 0, "good").otherwise("poor"))


@query("p20_fold_summary", "set folds", "mean med low high std",
       WEIGHTS + ", f AS (SELECT set, year(date) * 4 + quarter(date) AS fold, avg(net) AS x FROM dy GROUP BY ALL) ;; SELECT set, count(*) AS folds, avg(x) AS mean, median(x) AS med, min(x) AS low, max(x) AS high, stddev_samp(x) AS std FROM f GROUP BY set", "pred")
def p20(d: Data):
    f = daily(d).groupBy("set", (F.year("date") * 4 + F.quarter("date")).alias("fold")).agg(F.avg("net").alias("x"))
    return f.groupBy("set").agg(F.count(F.lit(1)).alias("folds"), F.avg("x").alias("mean"), F.median("x").alias("med"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("std"))


@query("p21_run_comparison", "days", "mean_diff corr better",
       WEIGHTS + ", c AS (SELECT a.net AS x, b.net AS y FROM dy a JOIN dy b ON a.date = b.date AND a.set = 1 AND b.set = 2) ;; SELECT count(*) AS days, avg(x - y) AS mean_diff, corr(x, y) AS corr, avg(CASE WHEN round(x - y, 9) > 0 THEN 1.0 ELSE 0.0 END) AS better FROM c", "pred")
def p21(d: Data):
    # both runs side by side from one pass
    c = daily(d).where("set < 3").groupBy("date").pivot("set", [1, 2]).agg(F.max("net")).where("`1` is not null and `2` is not null").select(F.col("1").alias("x"), F.col("2").alias("y"))
    return c.agg(F.count(F.lit(1)).alias("days"), F.avg(F.col("x") - F.col("y")).alias("mean_diff"), correlation("x", "y").alias("corr"), F.avg(F.when(F.round(F.col("x") - F.col("y"), 9) > 0, 1.0).otherwise(0.0)).alias("better"))


@query("p22_volatility_index", "date", "vix p10 p90",
       "f AS (SELECT date, abs(ret) AS v, turnover FROM pred WHERE set = 1 AND ret IS NOT NULL) ;; SELECT date, sum(v * turnover) / sum(turnover) * sqrt(252) * 100 AS vix, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM f GROUP BY date", "pred")
def p22(d: Data):
    f = d.pred.where("set = 1 and ret is not null").select("date", F.abs("ret").alias("v"), "turnover")
    return f.groupBy("date").agg((F.sum(F.col("v") * F.col("turnover")) / F.sum("turnover") * F.sqrt(F.lit(252.0)) * 100).alias("vix"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"))


@query("p23_daily_z_neutral", "set date code", "neutral",
       "z AS (SELECT *, (score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0) AS z FROM pred WINDOW w AS (PARTITION BY set, date)) ;; SELECT set, date, code, z - avg(z) OVER (PARTITION BY set, date, sector) AS neutral FROM z", "pred")
def p23(d: Data):
    w = Window.partitionBy("set", "date")
    z = d.pred.withColumn("z", ratio(F.col("score") - F.avg("score").over(w), F.stddev_samp("score").over(w)))
    return z.withColumn("neutral", F.col("z") - F.avg("z").over(Window.partitionBy("set", "date", "sector")))


@query("p24_vol_targeting", "set date", "scale scaled",
       WEIGHTS + f""", v AS (SELECT set, date, net, {sroll('stddev_samp', 'net', 20, 10, by='set')} AS s FROM dy), k AS (SELECT *, CASE WHEN s IS NOT NULL THEN greatest(0.1, least(3.0, 0.01 / (s + 1e-12))) END AS c FROM v), l AS (SELECT set, date, net, coalesce(lag(c) OVER (PARTITION BY set ORDER BY date), 1) AS scale FROM k) ;; SELECT set, date, scale, scale * net AS scaled FROM l""", "pred")
def p24(d: Data):
    v = daily(d).withColumn("c", clip(0.01 / (roll(F.stddev_samp, "net", 20, 10, by_set()) + EPS), 0.1, 3.0))
    return v.withColumn("scale", F.coalesce(F.lag("c").over(by_set()), F.lit(1.0))).withColumn("scaled", F.col("scale") * F.col("net"))
