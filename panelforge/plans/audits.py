"""Quality, leakage and parity audits (Y rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_code, correlation, lag, lead, lroll
from ..operators import audit, runs
from ..sources.tables import Data
from .crosssection import P as PANEL
from .crosssection import loo_mean, panel
from .joins import STATEMENTS, daily_snapshots, statements
from .registry import query
from .sql import lag as slag
from .sql import lead as slead
from .sql import lroll as slroll
from .windows import ISLANDS, RETURNS, _returns


@query("y1_duplicate_keys", "code date n extra", "", "SELECT code, date, count(*) AS n, count(*) - 1 AS extra FROM trades GROUP BY code, date HAVING count(*) > 1", "trades")
def y1(d: Data):
    return audit.duplicates(d.trades, ["code", "date"])


@query("y2_future_dates", "code date", "", "SELECT code, date FROM bars WHERE date > DATE '2001-06-30'")
def y2(d: Data):
    return d.bars.where(F.col("date") > F.lit("2001-06-30").cast("date"))


@query("y3_target_nulls", "name nulls rows", "", f"t AS (SELECT {slead('close', 1)} AS t1, {slead('close', 5)} AS t5, {slead('close', 20)} AS t20 FROM bars) ;; " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count(*) AS rows FROM t" for c in ("t1", "t5", "t20")))
def y3(d: Data):
    return audit.null_counts(d.bars.select(*[lead("close", h).alias(f"t{h}") for h in (1, 5, 20)]))


@query("y4_asof_violations", "rec published due", "", "SELECT rec, published, published + CAST(rec % 7 AS INT) - 1 AS due FROM snapshots WHERE NOT (published <= published + CAST(rec % 7 AS INT) - 1)", "snapshots")
def y4(d: Data):
    s = d.snapshots.withColumn("due", F.date_add("published", (F.col("rec") % 7 - 1).cast("int")))
    return s.where(~(F.col("published") <= F.col("due")))


MISS = "m AS (SELECT code, date, " + ", ".join(f"{slag('close', h)} AS l{h}" for h in (1, 60, 250)) + " FROM bars)"


@query("y5_missingness", "name level", "rate", MISS + " , r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, 1 - count({c}) / count(*)::DOUBLE AS rate FROM m" for c in ("l1", "l60", "l250")) + ") ;; SELECT name, rate, CASE WHEN rate > 0.25 THEN 'bad' WHEN rate > 0.05 THEN 'warn' ELSE 'ok' END AS level FROM r")
def y5(d: Data):
    m = d.bars.select(*[lag("close", h).alias(f"l{h}") for h in (1, 60, 250)])
    r = audit.null_counts(m).withColumn("rate", F.col("nulls") / F.col("rows"))
    return r.withColumn("level", F.when(F.col("rate") > 0.25, "bad").when(F.col("rate") > 0.05, "warn").otherwise("ok"))


@query("y6_ohlc_checks", "rule n", "",
       "b AS (SELECT *, " + slag("close") + " AS pc FROM bars) ;; SELECT 'high_low' AS rule, count(*) FILTER (high < low) AS n FROM b UNION ALL SELECT 'open_outside', count(*) FILTER (open > high OR open < low) FROM b UNION ALL SELECT 'close_outside', count(*) FILTER (close > high OR close < low) FROM b UNION ALL SELECT 'no_volume', count(*) FILTER (volume <= 0) FROM b UNION ALL SELECT 'limit_move', count(*) FILTER (abs(close / pc - 1) > 0.3) FROM b")
def y6(d: Data):
    c = F.col
    rules = {"high_low": c("high") < c("low"), "open_outside": (c("open") > c("high")) | (c("open") < c("low")), "close_outside": (c("close") > c("high")) | (c("close") < c("low")), "no_volume": c("volume") <= 0, "limit_move": F.abs(c("close") / c("pc") - 1) > 0.3}
    return audit.counts(d.bars.withColumn("pc", lag("close")), rules, "rule")


A = "a AS (SELECT code, date, close, volume FROM bars WHERE code % 7 <> 0), b AS (SELECT code, date, close * CASE WHEN code % 5 = 0 THEN 1.01 ELSE 1 END AS close, volume FROM bars WHERE code % 7 <> 1)"


def two_sets(d: Data):
    a = d.bars.where("code % 7 <> 0").select("code", "date", "close", "volume")
    b = d.bars.where("code % 7 <> 1").select("code", "date", (F.col("close") * F.when(F.col("code") % 5 == 0, 1.01).otherwise(1.0)).alias("close"), "volume")
    return a, b


@query("y8_parity", "name matched only_left only_right", "max_diff mean_diff",
       A + ", j AS (SELECT a.code AS ac, b.code AS bc, a.close AS c1, b.close AS c2, a.volume AS v1, b.volume AS v2 FROM a FULL JOIN b ON a.code = b.code AND a.date = b.date) ;; " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (ac IS NOT NULL AND bc IS NOT NULL) AS matched, count(*) FILTER (bc IS NULL) AS only_left, count(*) FILTER (ac IS NULL) AS only_right, max(abs({x}1 - {x}2)) AS max_diff, avg(abs({x}1 - {x}2)) AS mean_diff FROM j" for n, x in (("close", "c"), ("volume", "v"))))
def y8(d: Data):
    return audit.parity(*two_sets(d), ["code", "date"], ["close", "volume"])


@query("y9_null_rates", "name", "left_rate right_rate diff",
       MISS + ", x AS (SELECT * FROM m WHERE code % 2 = 0), y AS (SELECT * FROM m WHERE code % 2 = 1) ;; " + " UNION ALL ".join(f"SELECT '{c}' AS name, (SELECT 1 - count({c}) / count(*)::DOUBLE FROM x) AS left_rate, (SELECT 1 - count({c}) / count(*)::DOUBLE FROM y) AS right_rate, (SELECT 1 - count({c}) / count(*)::DOUBLE FROM y) - (SELECT 1 - count({c}) / count(*)::DOUBLE FROM x) AS diff" for c in ("l1", "l60", "l250")))
def y9(d: Data):
    m = d.bars.select("code", *[lag("close", h).alias(f"l{h}") for h in (1, 60, 250)])
    rate = lambda df, n: audit.null_counts(df.drop("code")).select("name", (F.col("nulls") / F.col("rows")).alias(n))
    return rate(m.where("code % 2 = 0"), "left_rate").join(rate(m.where("code % 2 = 1"), "right_rate"), "name").withColumn("diff", F.col("right_rate") - F.col("left_rate"))


@query("y10_leak_checks", "rule n", "",
       STATEMENTS + ", j AS (SELECT b.code, b.date, su.date AS e FROM bars b ASOF LEFT JOIN su ON b.code = su.code AND b.date >= su.date), m AS (SELECT date, count(DISTINCT m_close) AS k FROM market GROUP BY date) ;; SELECT 'negative_age' AS rule, count(*) FILTER (e > date) AS n FROM j UNION ALL SELECT 'age_missing', count(*) FILTER (e IS NULL) FROM j UNION ALL SELECT 'market_multi', count(*) FILTER (k > 1) FROM m", "bars snapshots calendar market")
def y10(d: Data):
    from ..operators.asof import asof_join

    j = asof_join(d.bars, statements(d).withColumn("e", F.col("date")), ["code"], "date", ["e"])
    m = d.market.groupBy("date").agg(F.countDistinct("m_close").alias("k"))
    first = audit.counts(j, {"negative_age": F.col("e") > F.col("date"), "age_missing": F.col("e").isNull()}, "rule")
    return first.unionByName(audit.counts(m, {"market_multi": F.col("k") > 1}, "rule"))


@query("y11_validity_filter", "code date n", "close", "i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM bars) ;; SELECT code, date, n, close FROM i WHERE n >= 60 AND volume > 0 AND turnover > 0")
def y11(d: Data):
    i = d.bars.withColumn("n", F.row_number().over(by_code()))
    flags = i.withColumns({"valid_history": F.col("n") >= 60, "valid_trade": (F.col("volume") > 0) & (F.col("turnover") > 0)})
    return flags.where("valid_history and valid_trade")


# Faults are planted where audits would otherwise never meet one: some stored returns leave the night out.
@query("y12_return_identity", "rows bad", "worst",
       f"r AS (SELECT close / CASE WHEN code % 10 = 0 AND day(date) = 13 THEN open ELSE {slag('close')} END AS a, open / {slag('close')} AS b, close / open AS c FROM bars) ;; SELECT count(*) AS rows, count(*) FILTER (coalesce(abs(a - b * c) > 1e-9, true)) AS bad, max(abs(a - b * c)) AS worst FROM r WHERE a IS NOT NULL")
def y12(d: Data):
    before = F.when((F.col("code") % 10 == 0) & (F.dayofmonth("date") == 13), F.col("open")).otherwise(lag("close"))
    r = d.bars.select((F.col("close") / before).alias("a"), (F.col("open") / lag("close")).alias("b"), (F.col("close") / F.col("open")).alias("c"))
    return audit.identity(r, "a", ["b", "c"])


@query("y13_coverage", "block bad", "coverage",
       PANEL + ", l AS (SELECT *, " + slag("r_5", 20) + " AS old FROM p) ;; SELECT 'price' AS block, count(close) / count(*)::DOUBLE AS coverage, count(*) FILTER (close <= 0) AS bad FROM l UNION ALL SELECT 'return', count(r) / count(*)::DOUBLE, count(*) FILTER (abs(r) > 1) FROM l UNION ALL SELECT 'old_return', count(old) / count(*)::DOUBLE, count(*) FILTER (abs(old) > 1) FROM l UNION ALL SELECT 'sector', count(sector) / count(*)::DOUBLE, count(*) FILTER (sector NOT BETWEEN 0 AND 24) FROM l UNION ALL SELECT 'balance', count(balance) / count(*)::DOUBLE, count(*) FILTER (balance < 0) FROM l", "panel")
def y13(d: Data):
    blocks = {"price": ("close", "close <= 0"), "return": ("r", "abs(r) > 1"), "old_return": ("old", "abs(old) > 1"), "sector": ("sector", "sector not between 0 and 24"), "balance": ("balance", "balance < 0")}
    return audit.coverage(panel(d).withColumn("old", lag("r_5", 20)), blocks)


@query("y14_feature_audit", "rule n", "",
       PANEL + ", l AS (SELECT *, CASE WHEN count(r) OVER g > 1 THEN (sum(r) OVER g - r) / nullif(count(r) OVER g - 1, 0) END AS loo FROM p WINDOW g AS (PARTITION BY date, sector)) ;; SELECT 'loo_equals_own' AS rule, count(*) FILTER (loo = r AND r <> 0) AS n FROM l UNION ALL SELECT 'loo_missing', count(*) FILTER (loo IS NULL) FROM l", "panel")
def y14(d: Data):
    l = panel(d).withColumn("loo", loo_mean("r"))  # noqa: E741
    return audit.counts(l, {"loo_equals_own": (F.col("loo") == F.col("r")) & (F.col("r") != 0), "loo_missing": F.col("loo").isNull()}, "rule")


# The stored label of some codes looks four rows ahead instead of five.
@query("y16_label_validation", "code mismatches tail_nulls", "",
       f"l AS (SELECT code, CASE WHEN code % 10 = 0 THEN {slead('close', 4)} ELSE {slead('close', 5)} END / close - 1 AS y, {slead('close', 5)} / close - 1 AS e, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS b FROM bars) ;; SELECT code, count(*) FILTER (CASE WHEN e IS NULL THEN y IS NOT NULL ELSE y IS NULL OR abs(y - e) > 1e-9 END) AS mismatches, count(*) FILTER (y IS NULL AND b <= 5) AS tail_nulls FROM l GROUP BY code")
def y16(d: Data):
    stored = F.when(F.col("code") % 10 == 0, lead("close", 4)).otherwise(lead("close", 5)) / F.col("close") - 1
    return audit.label_mismatches(d.bars.withColumn("y", stored), "y", 5)


@query("y17_quality_filter", "code date", "close",
       ISLANDS + f", s AS (SELECT *, count(*) OVER (PARTITION BY code, island) AS run, {slroll('avg', 'turnover', 60, 20)} AS adv, close / {slag('close')} - 1 AS r FROM g) ;; SELECT code, date, close FROM s WHERE adv >= 10000 AND run < 3 AND abs(r) <= 1.0")
def y17(d: Data):
    g = runs.islands(d.bars.withColumn("level", F.floor(F.col("close") / 100)), "code", "date", F.col("level"))
    g = g.withColumns({"run": F.count(F.lit(1)).over(Window.partitionBy("code", "island")), "adv": lroll(F.avg, "turnover", 60, 20), "r": F.col("close") / lag("close") - 1})
    return g.where("adv >= 10000 and run < 3 and abs(r) <= 1.0")


@query("y18_target_leakage", "name leak warn", "c std",
       RETURNS.replace(" ;;", "") + f""", f AS (SELECT {slead('r')} AS y, r AS f1, {slead('r')} * 2 + 1 AS f2, close AS f3, 1.0 AS f4 FROM b), k AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, CASE WHEN stddev_pop({c}) > 1e-12 THEN corr({c}, y) END AS c, stddev_samp({c}) AS std FROM f" for c in ('f1', 'f2', 'f3', 'f4'))}) ;;
SELECT name, c, std, coalesce(abs(c) > 0.99, false) AS leak, coalesce(abs(c) > 0.9, false) AS warn FROM k""")  # fmt: skip
def y18(d: Data):
    f = _returns(d).select(lead("r").alias("y"), F.col("r").alias("f1"), (lead("r") * 2 + 1).alias("f2"), F.col("close").alias("f3"), F.lit(1.0).alias("f4"))
    names = ("f1", "f2", "f3", "f4")
    row = f.agg(*[F.struct(F.lit(n).alias("name"), correlation(n, "y").alias("c"), F.stddev_samp(n).alias("std")).alias(n) for n in names])
    k = row.select(F.explode(F.array(*names)).alias("s")).select("s.*")
    return k.withColumns({"leak": F.coalesce(F.abs("c") > 0.99, F.lit(False)), "warn": F.coalesce(F.abs("c") > 0.9, F.lit(False))})


@query("y19_dataset_checks", "rule n", "",
       RETURNS.replace(" ;;", "") + " ;; SELECT 'rows' AS rule, count(*) AS n FROM b UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (code, date)) FROM b UNION ALL SELECT 'extreme_up', count(*) FILTER (r > 2.0) FROM b UNION ALL SELECT 'extreme_down', count(*) FILTER (r < -0.9) FROM b UNION ALL SELECT 'null_close', count(*) FILTER (close IS NULL) FROM b")
def y19(d: Data):
    b = _returns(d).withColumn("again", F.row_number().over(Window.partitionBy("code", "date").orderBy("close")) > 1)
    return audit.counts(b, {"rows": F.lit(True), "duplicate_keys": F.col("again"), "extreme_up": F.col("r") > 2.0, "extreme_down": F.col("r") < -0.9, "null_close": F.col("close").isNull()}, "rule")
