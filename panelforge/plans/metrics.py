"""Evaluation of predictions: date, code, score, label, set (M rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import average_rank, correlation, ratio
from ..operators import select
from ..sources.tables import Data
from .registry import query
from .sql import average_rank as saverage_rank


def set_dates():
    return Window.partitionBy("set", "date")


RANKED = f"rk AS (SELECT *, {saverage_rank('score', 'set, date')} AS rs, {saverage_rank('label', 'set, date')} AS rl, count(*) OVER (PARTITION BY set, date) AS n FROM pred)"


def ranked(d: Data):
    """Predictions with the average ranks of score and label by set and date."""
    return d.pred.withColumns({"rs": average_rank("score", "set", "date"), "rl": average_rank("label", "set", "date"), "n": F.count(F.lit(1)).over(set_dates())})


def summary(ic, name: str, *keys: str):
    """Mean, deviation and ratio of a daily series."""
    return ic.groupBy(*keys).agg(F.avg(name).alias("mean"), F.stddev_samp(name).alias("std"), F.count(name).alias("days")).withColumn("ir", ratio("mean", "std"))


def _scorr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN corr({x}, {y}) END"


SUMMARY = "avg(ic) AS mean, stddev_samp(ic) AS std, count(ic) AS days, avg(ic) / nullif(stddev_samp(ic), 0) AS ir"


@query("m1_ic", "set days", "mean std ir", f"i AS (SELECT set, date, {_scorr('score', 'label')} AS ic FROM pred GROUP BY set, date HAVING count(*) >= 3) ;; SELECT set, {SUMMARY} FROM i GROUP BY set", "pred")
def m1(d: Data):
    daily = d.pred.groupBy("set", "date").agg(correlation("score", "label").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return summary(daily, "ic", "set")


@query("m2_rank_ic", "set date n", "ic", RANKED + f" ;; SELECT set, date, max(n) AS n, coalesce({_scorr('rs', 'rl')}, 0) AS ic FROM rk GROUP BY set, date", "pred")
def m2(d: Data):
    return ranked(d).groupBy("set", "date").agg(F.max("n").alias("n"), F.coalesce(correlation("rs", "rl"), F.lit(0.0)).alias("ic"))


@query("m3_spearman_formula", "set date", "rho",
       "r AS (SELECT set, date, row_number() OVER (PARTITION BY set, date ORDER BY score, code) - row_number() OVER (PARTITION BY set, date ORDER BY label, code) AS dd FROM pred) ;; SELECT set, date, 1 - 6 * sum(dd * dd) / nullif(count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1), 0) AS rho FROM r GROUP BY set, date", "pred")
def m3(d: Data):
    diff = F.row_number().over(set_dates().orderBy("score", "code")) - F.row_number().over(set_dates().orderBy("label", "code"))
    n = F.count(F.lit(1)).cast("double")
    return d.pred.select("set", "date", diff.alias("dd")).groupBy("set", "date").agg((1 - ratio(6 * F.sum(F.col("dd") * F.col("dd")), n * (n * n - 1))).alias("rho"))


@query("m4_deciles", "set decile", "mean_return mean_count spread",
       """b AS (SELECT set, date, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pred GROUP BY set, date), k AS (SELECT p.*, len(list_filter(q, lambda x: x < score)) + 1 AS decile FROM pred p JOIN b ON p.set = b.set AND p.date = b.date),
g AS (SELECT set, date, decile, avg(label) AS m, count(*) AS c FROM k GROUP BY ALL) , h AS (SELECT set, decile, avg(m) AS mean_return, avg(c) AS mean_count FROM g GROUP BY set, decile) ;;
SELECT *, max(mean_return) FILTER (decile = 10) OVER (PARTITION BY set) - max(mean_return) FILTER (decile = 1) OVER (PARTITION BY set) AS spread FROM h""", "pred")  # fmt: skip
def m4(d: Data):
    bounds = d.pred.groupBy("set", "date").agg(F.percentile("score", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("q"))
    k = d.pred.join(bounds, ["set", "date"]).withColumn("decile", F.size(F.filter("q", lambda x: x < F.col("score"))) + 1)
    daily = k.groupBy("set", "date", "decile").agg(F.avg("label").alias("m"), F.count(F.lit(1)).alias("c"))
    means = daily.groupBy("set", "decile").agg(F.avg("m").alias("mean_return"), F.avg("c").alias("mean_count"))
    of = lambda k: F.max(F.when(F.col("decile") == k, F.col("mean_return"))).over(Window.partitionBy("set"))
    return means.withColumn("spread", of(10) - of(1))


ORDERS = "o AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS rs, row_number() OVER (PARTITION BY set, date ORDER BY label DESC, code) AS rl, count(*) OVER (PARTITION BY set, date) AS n FROM pred)"


def orders(d: Data):
    return d.pred.withColumns({"rs": F.row_number().over(set_dates().orderBy(F.desc("score"), "code")), "rl": F.row_number().over(set_dates().orderBy(F.desc("label"), "code")), "n": F.count(F.lit(1)).over(set_dates())})


@query("m5_precision_at_k", "set date", "precision baseline", ORDERS + " ;; SELECT set, date, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) FILTER (rs <= 5) AS precision, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS baseline FROM o GROUP BY set, date", "pred")
def m5(d: Data):
    hit = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    return orders(d).groupBy("set", "date").agg(F.avg(F.when(F.col("rs") <= 5, hit)).alias("precision"), F.avg(hit).alias("baseline"))


@query("m6_ndcg", "set date", "ndcg random",
       ORDERS + """, g AS (SELECT *, ln(1 + exp(label)) AS gain FROM o) ;; SELECT set, date, sum(CASE WHEN rs <= 10 THEN gain / log2(rs + 1) END) / sum(CASE WHEN rl <= 10 THEN gain / log2(rl + 1) END) AS ndcg,
avg(gain) * sum(CASE WHEN rs <= 10 THEN 1 / log2(rs + 1) END) / sum(CASE WHEN rl <= 10 THEN gain / log2(rl + 1) END) AS random FROM g GROUP BY set, date""", "pred")  # fmt: skip
def m6(d: Data):
    g = orders(d).withColumn("gain", F.log(1 + F.exp("label")))
    discount = lambda r: F.log2(F.col(r) + 1)
    found, ideal = F.sum(F.when(F.col("rs") <= 10, F.col("gain") / discount("rs"))), F.sum(F.when(F.col("rl") <= 10, F.col("gain") / discount("rl")))
    return g.groupBy("set", "date").agg((found / ideal).alias("ndcg"), (F.avg("gain") * F.sum(F.when(F.col("rs") <= 10, 1 / discount("rs"))) / ideal).alias("random"))


@query("m7_overlap_spread", "set date", "overlap spread", ORDERS + " ;; SELECT set, date, count(*) FILTER (rs <= 5 AND rl <= 5) / least(5, max(n))::DOUBLE AS overlap, avg(label) FILTER (rs <= 5) - avg(label) FILTER (rs > n - 5) AS spread FROM o GROUP BY set, date", "pred")
def m7(d: Data):
    o = orders(d).groupBy("set", "date")
    return o.agg((F.count_if((F.col("rs") <= 5) & (F.col("rl") <= 5)) / F.least(F.lit(5), F.max("n"))).alias("overlap"), (F.avg(F.when(F.col("rs") <= 5, F.col("label"))) - F.avg(F.when(F.col("rs") > F.col("n") - 5, F.col("label")))).alias("spread"))


@query("m8_weighted_importance", "set date", "importance", ORDERS + " ;; SELECT set, date, sum(CASE WHEN rs <= 10 THEN power(0.85, rs - 1) * label END) / sum(CASE WHEN rs <= 10 THEN power(0.85, rs - 1) END) AS importance FROM o GROUP BY set, date", "pred")
def m8(d: Data):
    w = F.when(F.col("rs") <= 10, F.pow(F.lit(0.85), F.col("rs") - 1))
    return orders(d).groupBy("set", "date").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("importance"))


@query("m9_hit_rate", "set", "hit_rate", "SELECT set, avg(CASE WHEN sign(score - 0.5) = sign(label) THEN 1.0 ELSE 0.0 END) AS hit_rate FROM pred GROUP BY set", "pred")
def m9(d: Data):
    return d.pred.groupBy("set").agg(F.avg(F.when(F.signum(F.col("score") - 0.5) == F.signum("label"), 1.0).otherwise(0.0)).alias("hit_rate"))


QS = (0.1, 0.5, 0.9)
QUANTILES = "f AS (SELECT set, date, code, label AS y, score / 10 - 0.05 AS p, score / 10 - 0.05 - 0.1 * (1 + code % 3) AS p10, score / 10 - 0.05 AS p50, score / 10 + 0.1 - 0.2 * CAST(code % 5 = 0 AS INT) AS p90 FROM pred)"


def forecasts(d: Data):
    """Point and quantile forecasts of the label, derived from the score (some of them cross)."""
    p = F.col("score") / 10 - 0.05
    return d.pred.select("set", "date", "code", F.col("label").alias("y"), p.alias("p"), (p - 0.1 * (1 + F.col("code") % 3)).alias("p10"), p.alias("p50"), (F.col("score") / 10 + 0.1 - 0.2 * (F.col("code") % 5 == 0).cast("int")).alias("p90"))


def pinball(q: float, c: str):
    e = F.col("y") - F.col(c)
    return F.greatest(q * e, (q - 1) * e)


def _spinball(q: float, c: str) -> str:
    return f"greatest({q} * (y - {c}), ({q} - 1) * (y - {c}))"


@query("m10_forecast_errors", "set", "smape mae pinball wql",
       QUANTILES + f" ;; SELECT set, avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-12)) AS smape, avg(abs(y - p)) AS mae, avg({_spinball(0.5, 'p50')}) AS pinball, 2 * ({' + '.join(f'sum({_spinball(q, f"p{int(q * 100)}")})' for q in QS)}) / 3 / sum(abs(y)) AS wql FROM f GROUP BY set", "pred")
def m10(d: Data):
    e = F.abs(F.col("y") - F.col("p"))
    total = sum(F.sum(pinball(q, f"p{int(q * 100)}")) for q in QS)
    return forecasts(d).groupBy("set").agg(F.avg(2 * e / (F.abs("y") + F.abs("p") + 1e-12)).alias("smape"), F.avg(e).alias("mae"), F.avg(pinball(0.5, "p50")).alias("pinball"), (2 * total / 3 / F.sum(F.abs("y"))).alias("wql"))


@query("m11_crps_crossing", "set", "crps crossing",
       QUANTILES + f" ;; SELECT set, avg(2 * ({' + '.join(_spinball(q, f'p{int(q * 100)}') for q in QS)}) / 3) AS crps, avg(CASE WHEN p10 > p50 OR p50 > p90 THEN 1.0 ELSE 0.0 END) AS crossing FROM f GROUP BY set", "pred")
def m11(d: Data):
    losses = F.aggregate(F.zip_with(F.array(*map(F.lit, QS)), F.array("p10", "p50", "p90"), lambda q, p: F.greatest(q * (F.col("y") - p), (q - 1) * (F.col("y") - p))), F.lit(0.0), lambda a, x: a + x)
    crossed = (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))
    return forecasts(d).groupBy("set").agg(F.avg(2 * losses / 3).alias("crps"), F.avg(F.when(crossed, 1.0).otherwise(0.0)).alias("crossing"))


@query("m12_by_half_and_sector", "set half sector days", "mean std ir",
       f"i AS (SELECT set, date, sector, {_scorr('score', 'label')} AS ic FROM pred GROUP BY set, date, sector), h AS (SELECT *, CASE WHEN date < DATE '1998-06-01' THEN 1 ELSE 2 END AS half FROM i) ;; SELECT set, half, sector, {SUMMARY} FROM h GROUP BY set, half, sector", "pred")
def m12(d: Data):
    daily = d.pred.groupBy("set", "date", "sector").agg(correlation("score", "label").alias("ic"))
    half = F.when(F.col("date") < F.lit("1998-06-01").cast("date"), 1).otherwise(2)
    return summary(daily.withColumn("half", half), "ic", "set", "half", "sector")


HORIZONS = (1, 5)


@query("m12_by_fold_and_horizon", "set fold horizon days", "mean std ir",
       "y AS (SELECT set, date, year(date) AS fold, score, code, close, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY set, code ORDER BY date) / close - 1 AS y{h}" for h in HORIZONS) + " FROM pred), "
       + "i AS (" + " UNION ALL ".join(f"SELECT set, date, fold, {h} AS horizon, {_scorr('score', f'y{h}')} AS ic FROM y WHERE y{h} IS NOT NULL GROUP BY set, date, fold" for h in HORIZONS) + f") ;; SELECT set, fold, horizon, {SUMMARY} FROM i GROUP BY set, fold, horizon", "pred")
def m12_folds(d: Data):
    """Daily correlations of scores with returns over several horizons, by year."""
    w = Window.partitionBy("set", "code").orderBy("date")
    ahead = d.pred.select("set", "date", F.year("date").alias("fold"), "score", *[(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"y{h}") for h in HORIZONS])
    future = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in HORIZONS])
    y = ahead.withColumn("f", F.explode(future)).select("set", "date", "fold", "score", "f.*").where("y is not null")
    daily = y.groupBy("set", "date", "fold", "horizon").agg(correlation("score", "y").alias("ic"))
    return summary(daily, "ic", "set", "fold", "horizon")


FACTORS = ("close", "volume", "turnover", "ret")


@query("m13_factor_ranking", "factor days", "mean std ir hit",
       "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS factor, date, code, {c}::DOUBLE AS x, label FROM pred WHERE set = 1 AND {c} IS NOT NULL" for c in FACTORS) + f"), r AS (SELECT *, {saverage_rank('x', 'factor, date')} AS rx, {saverage_rank('label', 'factor, date')} AS ry FROM l), i AS (SELECT factor, date, {_scorr('rx', 'ry')} AS ic FROM r GROUP BY factor, date) ;; SELECT factor, {SUMMARY}, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS hit FROM i GROUP BY factor", "pred")
def m13(d: Data):
    long = d.pred.where("set = 1").unpivot(["date", "code", "label"], [F.col(c).cast("double").alias(c) for c in FACTORS], "factor", "x").where("x is not null")
    r = long.withColumns({"rx": average_rank("x", "factor", "date"), "ry": average_rank("label", "factor", "date")})
    daily = r.groupBy("factor", "date").agg(correlation("rx", "ry").alias("ic"))
    hits = daily.groupBy("factor").agg(F.avg(F.when(F.round("ic", 9) > 0, 1.0).when(F.col("ic").isNotNull(), 0.0)).alias("hit"))
    return summary(daily, "ic", "factor").join(hits, "factor")


@query("m14_ablation", "stage days", "mean std ir",
       f"s AS (SELECT unnest(range(1, 4)) AS stage), a AS (SELECT stage, date, code, avg(score) AS score, max(label) AS label FROM pred JOIN s ON set <= stage GROUP BY ALL), i AS (SELECT stage, date, {_scorr('score', 'label')} AS ic FROM a GROUP BY stage, date) ;; SELECT stage, {SUMMARY} FROM i GROUP BY stage", "pred")
def m14(d: Data):
    staged = d.pred.withColumn("stage", F.explode(F.sequence("set", F.lit(3))))  # a stage uses its set and all before
    a = staged.groupBy("stage", "date", "code").agg(F.avg("score").alias("score"), F.max("label").alias("label"))
    return summary(a.groupBy("stage", "date").agg(correlation("score", "label").alias("ic")), "ic", "stage")


@query("m15_target_variance", "date market n zero", "std", "l AS (SELECT date, market, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS y FROM panel) ;; SELECT date, market, count(*) AS n, stddev_samp(y) AS std, coalesce(stddev_samp(y), 0) < 1e-12 AS zero FROM l WHERE y IS NOT NULL GROUP BY date, market", "panel")
def m15(d: Data):
    """Deviation of the labels of each date and market; one label alone has none."""
    y = d.panel.select("date", "market", (F.lead("close").over(Window.partitionBy("code").orderBy("date")) / F.col("close") - 1).alias("y")).where("y is not null")
    g = y.groupBy("date", "market").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("std"))
    return g.withColumn("zero", F.coalesce("std", F.lit(0.0)) < 1e-12)


@query("m16_monitoring", "date n top", "mean std", ORDERS + " ;; SELECT date, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, string_agg(CAST(code AS VARCHAR), ',' ORDER BY rs) FILTER (rs <= 3) AS top FROM o WHERE set = 1 GROUP BY date", "pred")
def m16(d: Data):
    best = F.array_sort(F.collect_list(F.when(F.col("rs") <= 3, F.struct("rs", "code"))))
    o = orders(d).where("set = 1").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), best.alias("best"))
    return o.withColumn("top", F.array_join(F.transform("best", lambda x: x["code"].cast("string")), ","))
