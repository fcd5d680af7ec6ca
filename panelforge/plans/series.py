"""Statistics of many series and anomaly detection by id (Q and N rows)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import correlation, normal_cdf, ratio, roll
from ..operators import detect, stats
from ..sources.tables import Data
from .portfolio import MODES, WEIGHTS, by_mode, daily
from .registry import query
from .sql import over, solved
from .sql import roll as sroll

X = WEIGHTS + ", x AS (SELECT set, date, net AS x, row_number() OVER (PARTITION BY set ORDER BY date) AS i, net - avg(net) OVER (PARTITION BY set) AS e FROM dy)"
LAGS = 4


def centred(d: Data):
    return daily(d).select("set", "date", F.col("net").alias("x"), (F.col("net") - F.avg("net").over(Window.partitionBy("set"))).alias("e"))


NW = "nw AS (SELECT set, count(*) AS n, avg(x) AS mean, sum(e * e) / count(*) + " + " + ".join(f"2 * {1 - k / (LAGS + 1)!r} * sum(e * l{k}) / count(*)" for k in range(1, LAGS + 1)) + " AS lrv FROM (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY set ORDER BY date) AS l{k}" for k in range(1, LAGS + 1)) + " FROM x) GROUP BY set)"


@query("q1_newey_west", "set n", "mean lrv t", X + ", " + NW + " ;; SELECT set, n, mean, lrv, mean / sqrt(lrv / n) AS t FROM nw", "pred")
def q1(d: Data):
    return stats.newey_west(centred(d), "set", LAGS).withColumn("t", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))


DIFF = WEIGHTS + ", x AS (SELECT a.set AS set, a.date, abs(a.net) - abs(b.net) AS x, (abs(a.net) - abs(b.net)) - avg(abs(a.net) - abs(b.net)) OVER (PARTITION BY a.set) AS e FROM dy a JOIN dy b ON a.date = b.date AND b.set = 3 AND a.set < 3)"


@query("q2_diebold_mariano", "set n", "dm p",
       DIFF + ", " + NW + """, s AS (SELECT set, n, mean / sqrt(lrv / n) AS dm FROM nw), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(dm)) AS t FROM s) ;;
SELECT set, n, dm, 2 * exp(-dm * dm / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p FROM t""", "pred")  # fmt: skip
def q2(d: Data):
    net = daily(d).select("set", "date", F.abs("net").alias("loss"))
    last = net.where("set = 3").select("date", F.col("loss").alias("base"))
    x = net.where("set < 3").join(last, "date").withColumn("x", F.col("loss") - F.col("base"))
    x = x.withColumn("e", F.col("x") - F.avg("x").over(Window.partitionBy("set")))
    dm = stats.newey_west(x, "set", LAGS).withColumn("dm", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))
    return dm.withColumn("p", 2 * (1 - normal_cdf(F.abs("dm"))))


@query("q3_sharpe_difference", "n", "diff se z",
       WEIGHTS + """, m AS (SELECT count(*) AS n, avg(a.net) AS ma, avg(b.net) AS mb, stddev_pop(a.net) AS sa, stddev_pop(b.net) AS sb, corr(a.net, b.net) AS r FROM dy a JOIN dy b ON a.date = b.date AND a.set = 1 AND b.set = 2),
k AS (SELECT n, ma / sa - mb / sb AS diff, sqrt((2 - 2 * r + 0.5 * (power(ma / sa, 2) + power(mb / sb, 2) - 2 * ma / sa * mb / sb * r * r)) / n) AS se FROM m) ;; SELECT n, diff, se, diff / se AS z FROM k""", "pred")  # fmt: skip
def q3(d: Data):
    c = daily(d).where("set < 3").groupBy("date").pivot("set", [1, 2]).agg(F.max("net")).where("`1` is not null and `2` is not null").select(F.col("1").alias("a"), F.col("2").alias("b"))
    return stats.sharpe_difference(c)


@query("q4_deflated_sharpe", "set n", "sharpe skew kurt psr",
       WEIGHTS + """, m AS (SELECT set, count(*) AS n, avg(net) AS mu, stddev_pop(net) AS sd FROM dy GROUP BY set), c AS (SELECT m.set, n, mu / sd AS sharpe, avg(power((net - mu) / sd, 3)) AS skew, avg(power((net - mu) / sd, 4)) AS kurt FROM dy JOIN m ON dy.set = m.set GROUP BY m.set, n, mu, sd),
z AS (SELECT *, (sharpe - 0.05) * sqrt(n - 1) / sqrt(greatest(1e-9, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)) AS z FROM c), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
u AS (SELECT *, exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t) ;; SELECT set, n, sharpe, skew, kurt, CASE WHEN z >= 0 THEN 1 - tail ELSE tail END AS psr FROM u""", "pred")  # fmt: skip
def q4(d: Data):
    return stats.deflated_sharpe(daily(d).select("set", F.col("net").alias("x")), "set", benchmark=0.05)


PARTS = 8
HALVES = ", ".join(f"({k}, {b}, {b in half})" for k, half in enumerate(combinations(range(PARTS), PARTS // 2)) for b in range(PARTS))


@query("q4_overfitting", "combinations strategies", "pbo mean_logit",
       MODES + f""", dn AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) * {PARTS} // count(*) OVER () AS block FROM (SELECT DISTINCT date FROM dy)),
s AS (SELECT set || mode AS strategy, block, count(*) AS n, sum(net) AS s, sum(net * net) AS q FROM dy JOIN dn ON dy.date = dn.date GROUP BY set, mode, block), c(combination, block, chooses) AS (VALUES {HALVES}),
m AS (SELECT combination, strategy, chooses, round(sum(s) / sum(n) / sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 1e-18)), 9) AS sharpe FROM s JOIN c ON s.block = c.block GROUP BY combination, strategy, chooses),
r AS (SELECT *, row_number() OVER (PARTITION BY combination, chooses ORDER BY sharpe DESC, strategy) AS best, row_number() OVER (PARTITION BY combination, chooses ORDER BY sharpe, strategy DESC) AS place, count(*) OVER (PARTITION BY combination, chooses) AS k FROM m),
l AS (SELECT t.k, ln(t.place / (t.k + 1 - t.place)) AS logit FROM r t JOIN r w ON w.combination = t.combination AND w.strategy = t.strategy WHERE w.chooses AND w.best = 1 AND NOT t.chooses) ;;
SELECT count(*) AS combinations, max(k) AS strategies, avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0.0 END) AS pbo, avg(logit) AS mean_logit FROM l""", "pred")  # fmt: skip
def q4_overfitting(d: Data):
    """Probability of back-test over-fitting over the three sets in three modes."""
    x = by_mode(d).select(F.concat("set", "mode").alias("strategy"), "date", F.col("net").alias("x"))
    logits = stats.overfitting(x, PARTS)
    return logits.agg(F.count(F.lit(1)).alias("combinations"), F.lit(9).alias("strategies"), F.avg(F.when(F.col("logit") < 0, 1.0).otherwise(0.0)).alias("pbo"), F.avg("logit").alias("mean_logit"))


@query("q5_block_bootstrap", "set reps", "mean low high",
       WEIGHTS + """, bx AS (SELECT set, net, (row_number() OVER (PARTITION BY set ORDER BY date) - 1) // 20 AS blk FROM dy), b AS (SELECT set, blk, sum(net) AS s, count(*) AS c FROM bx GROUP BY ALL), bn AS (SELECT set, count(*) AS k FROM b GROUP BY set),
br AS (SELECT set, k, unnest(range(0, 200)) AS rep FROM bn), bp AS (SELECT set, rep, k, unnest(range(0, k)) AS slot FROM br), bq AS (SELECT set, rep, CAST('0x' || substr(md5(rep || ':' || slot || ':' || set), 1, 8) AS BIGINT) % k AS blk FROM bp),
bm AS (SELECT bq.set, rep, sum(s) / sum(c) AS m FROM bq JOIN b ON bq.set = b.set AND bq.blk = b.blk GROUP BY bq.set, rep) ;; SELECT set, count(*) AS reps, avg(m) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY set""", "pred")  # fmt: skip
def q5(d: Data):
    return stats.block_bootstrap(daily(d).select("set", "date", F.col("net").alias("x")), "set", block=20, reps=200)


@query("q6_vif", "name", "vif",
       "c AS (SELECT corr(close, volume) AS r FROM bars) ;; SELECT unnest(['close', 'volume']) AS name, 1 / (1 - r * r) AS vif FROM c")
def q6(d: Data):
    return stats.variance_inflation(d.bars, ["close", "volume"])


DEEP = 3


def _q7() -> str:
    names = [f"{v}{i}" for v in "yx" for i in range(1, DEEP + 1)]
    m, w = len(names), "OVER (PARTITION BY code ORDER BY date)"
    lagged = ", ".join(f"lag({c[0]}, {c[1]}) {w} AS {c}" for c in names)
    whole = " AND ".join(["y IS NOT NULL", *[f"({c} IS NOT NULL OR lag < {c[1]})" for c in names]])
    used = ", ".join(f"CASE WHEN lag >= {c[1]} THEN {c} ELSE 0 END AS {c}" for c in names)
    on = lambda c: f"(lag >= {c[1]} AND ({c[0] == 'y'} OR model = 1))"
    cell = lambda a, b: f"CASE WHEN {on(a)} AND {on(b)} THEN covar_pop({a}, {b}) ELSE {1.0 if a == b else 0.0} END"
    rows = ", ".join("[" + ", ".join([*[cell(a, b) for b in names], f"CASE WHEN {on(a)} THEN covar_pop({a}, y) ELSE 0 END"]) + "]" for a in names)
    left = "yy - " + " - ".join(f"b[{i + 1}] * m[{i + 1}][{m + 1}]" for i in range(m))
    return f"""r AS (SELECT code, date, ln(close) - lag(ln(close)) OVER w AS y, ln(volume + 1) - lag(ln(volume + 1)) OVER w AS x FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), l AS (SELECT code, y, {lagged} FROM r),
u AS (SELECT code, lag, model, y, {used} FROM l, (VALUES {", ".join(f"({i})" for i in range(1, DEEP + 1))}) t(lag), (VALUES (0), (1)) v(model) WHERE {whole}),
s AS MATERIALIZED (SELECT code, lag, model, count(*) AS n, var_pop(y) AS yy, [{rows}] AS m FROM u GROUP BY code, lag, model HAVING count(*) > 2 * lag + 10), {solved("t", "s", "code, lag, model", m)},
q AS (SELECT s.code, s.lag, s.model, n, {left} AS rss FROM s JOIN t ON s.code = t.code AND s.lag = t.lag AND s.model = t.model),
f AS (SELECT a.code, a.lag, a.n, greatest(0, (a.rss - b.rss) / a.lag / (b.rss / (a.n - 2 * a.lag - 1))) AS f, a.n - 2 * a.lag - 1 AS d FROM q a JOIN q b ON a.code = b.code AND a.lag = b.lag AND a.model = 0 AND b.model = 1),
k AS (SELECT *, lag * f / (lag * f + d) AS z, lag / 2.0::DOUBLE AS h, d / 2.0::DOUBLE AS g FROM f),
e AS (SELECT code, lag, n, f, z, h, g, 0 AS i, 1.0::DOUBLE AS term, 1.0::DOUBLE AS total FROM k UNION ALL SELECT code, lag, n, f, z, h, g, i + 1, term * (h + g + i) / (h + 1 + i) * z, total + term * (h + g + i) / (h + 1 + i) * z FROM e WHERE i < 2000 AND term > 1e-17 * total),
o AS (SELECT code, lag, n, f, CASE WHEN z > 0 THEN 1 - exp(h * ln(z) + g * ln(1 - z) - ln(h) - lgamma(h) - lgamma(g) + lgamma(h + g)) * max(total) ELSE 1 END AS p FROM e GROUP BY code, lag, n, f, z, h, g) ;;
SELECT code, lag, n, f, greatest(0, p) AS p FROM o"""


@query("q7_granger", "code lag n", "f p", _q7())
def q7(d: Data):
    w = Window.partitionBy("code").orderBy("date")
    r = d.bars.select("code", "date", (F.log("close") - F.lag(F.log("close")).over(w)).alias("y"), (F.log(F.col("volume") + 1) - F.lag(F.log(F.col("volume") + 1)).over(w)).alias("x"))
    return stats.granger(r.withColumns({f"{v}{i}": F.lag(v, i).over(w) for v in "yx" for i in range(1, DEEP + 1)}), "code", DEEP)


EV = "e AS (SELECT id, eid, ts, value AS x FROM ev)"


def by_id():
    return Window.partitionBy("id").orderBy("ts", "eid")


def observations(d: Data):
    return d.ev.select("id", "eid", "ts", F.col("value").alias("x"))


@query("n1_mean_shift", "id eid", "score",
       f"m AS (SELECT id, eid, avg(value) OVER l AS ml, avg(value) OVER r AS mr, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr, count(*) OVER l AS nl, count(*) OVER r AS nr FROM ev WINDOW l AS {over(-5, -1, 'id', 'ts, eid')}, r AS {over(1, 5, 'id', 'ts, eid')}) ;; SELECT id, eid, CASE WHEN nl = 5 AND nr = 5 THEN 1 / (1 + exp(2 - abs(mr - ml) / (sqrt((vl + vr) / 2) + 1e-9))) END AS score FROM m", "ev")
def n1(d: Data):
    return detect.mean_shift(observations(d), 5)


def _n2() -> str:
    o = over(-20, 0, "id", "ts, eid")
    return f"""f AS (SELECT id, eid, ts, value - lag(value) OVER (PARTITION BY id ORDER BY ts, eid) AS r FROM ev), m AS (SELECT *, median(r) OVER {o} AS med, list(r) FILTER (r IS NOT NULL) OVER {o} AS a FROM f),
z AS (SELECT *, list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median') AS mad FROM m) ;; SELECT id, eid, CASE WHEN r IS NOT NULL AND len(a) >= 5 THEN 1 / (1 + exp(2 - abs(r - med) / (1.4826 * mad + 1e-9))) END AS score FROM z"""


@query("n2_residual_score", "id eid", "score", _n2(), "ev")
def n2(d: Data):
    # the forecast is the last value
    f = observations(d).withColumn("r", F.col("x") - F.lag("x").over(by_id()))
    return detect.residual_score(f, 21, 5)


@query("n3_spectral_residual", "id eid", "score", None, "ev")
def n3(d: Data):
    return detect.spectral_residual(observations(d))


FLAG = "q AS (SELECT id, quantile_cont(value, 0.7) AS cut FROM ev GROUP BY id), f AS (SELECT ev.id, eid, ts, value, value >= cut AS hot, row_number() OVER (PARTITION BY ev.id ORDER BY ts, eid) AS i FROM ev JOIN q ON ev.id = q.id), g AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY ts, eid) AS island FROM f WHERE hot)"
RANGES = FLAG + ", rg AS (SELECT id, min(i) AS a, max(i) AS b, count(*) AS n, max(value) AS top FROM g GROUP BY id, island HAVING count(*) >= 2)"


@query("n4_score_ranges", "id a b n", "top", RANGES + " ;; SELECT * FROM rg", "ev")
def n4(d: Data):
    return detect.ranges(observations(d), 0.7, 2)


#: The true ranges: two or more events of these types in a row.
TYPES = ("error", "signup")
LABELS = f", lb AS MATERIALIZED (SELECT id, min(i) AS a, max(i) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM (SELECT id, type, row_number() OVER (PARTITION BY id ORDER BY ts, eid) AS i FROM ev) WHERE type IN {TYPES}) GROUP BY id, island HAVING count(*) >= 2)"


def true_ranges(d: Data):
    o = detect.numbered(d.ev.select("id", "eid", "ts", "type", F.col("value").alias("x"))).where(F.col("type").isin(*TYPES))
    return detect.runs_of(o, 2).select("id", "a", "b")


STEPS = 19


def _n5() -> str:
    common = "least(p.b, l.b) - greatest(p.a, l.a) + 1"
    part = f"({common}) / (p.b - p.a + l.b - l.a + 2 - ({common}))::DOUBLE"
    return RANGES + LABELS + f""", pq AS MATERIALIZED (SELECT id, a, b, top / (SELECT max(top) FROM rg) AS score, row_number() OVER (PARTITION BY id ORDER BY top DESC, a, b) AS k FROM rg),
rec AS (SELECT DISTINCT id, kind, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::DOUBLE AS score, false AS hit FROM pq, (VALUES ('overlap'), ('iou')) t(kind)
  UNION ALL SELECT id, kind, k, CASE WHEN coalesce(best.v >= least_, false) THEN list_append(used, -best.n) ELSE used END, score, coalesce(best.v >= least_, false) FROM (
    SELECT s.id, s.kind, p.k, s.used, p.score, CASE WHEN s.kind = 'iou' THEN {detect.IOU} ELSE 1 END AS least_, max({{'v': CASE WHEN s.kind = 'iou' THEN {part} ELSE {common} END, 'n': -l.a}}) FILTER (l.a IS NOT NULL) AS best
    FROM rec s JOIN pq p ON p.id = s.id AND p.k = s.k + 1 LEFT JOIN lb l ON l.id = s.id AND l.a <= p.b AND p.a <= l.b AND NOT list_contains(s.used, l.a) GROUP BY s.id, s.kind, p.k, s.used, p.score)),
th AS (SELECT unnest(range(1, {STEPS + 1})) AS step), tt AS (SELECT step, 0.95::DOUBLE - (step - 1) * {0.9 / (STEPS - 1)!r}::DOUBLE AS threshold FROM th),
c AS (SELECT kind, step, threshold, count(*) FILTER (round(score - threshold, 9) >= 0) AS selected, count(*) FILTER (round(score - threshold, 9) >= 0 AND hit) AS matched, (SELECT count(*) FROM lb) AS labels FROM rec, tt WHERE k > 0 GROUP BY kind, step, threshold),
r AS (SELECT *, CASE WHEN selected > 0 THEN matched / selected::DOUBLE ELSE 1 END AS precision, coalesce(matched / nullif(labels, 0)::DOUBLE, 0) AS recall FROM c),
pw AS (SELECT *, (recall - coalesce(lag(recall) OVER w, 0)) * (precision + coalesce(lag(precision) OVER w, precision)) / 2 AS piece FROM r WINDOW w AS (PARTITION BY kind ORDER BY step)) ;;
SELECT *, sum(piece) OVER (PARTITION BY kind) AS area FROM pw"""


@query("n5_range_evaluation", "kind step selected matched labels", "threshold precision recall area", _n5(), "ev")
def n5(d: Data):
    """Precision and recall of score ranges by threshold; scores are shares of the largest."""
    found = detect.ranges(observations(d), 0.7, 2)
    top = found.agg(F.max("top").alias("_most"))  # one row
    return detect.sweep(found.join(F.broadcast(top)).select("id", "a", "b", (F.col("top") / F.col("_most")).alias("score")), true_ranges(d), STEPS)


@query("n5_overlaps", "id predicted actual hits", "precision recall",
       RANGES + LABELS + """,
h AS (SELECT rg.id, rg.a FROM rg SEMI JOIN lb ON rg.id = lb.id AND rg.a <= lb.b AND lb.a <= rg.b), hl AS (SELECT lb.id, lb.a FROM lb SEMI JOIN rg ON rg.id = lb.id AND rg.a <= lb.b AND lb.a <= rg.b),
c AS (SELECT id, count(*) AS predicted FROM rg GROUP BY id), k AS (SELECT id, count(*) AS actual FROM lb GROUP BY id), x AS (SELECT id, count(*) AS hits FROM h GROUP BY id), y AS (SELECT id, count(*) AS found FROM hl GROUP BY id) ;;
SELECT c.id, predicted, coalesce(actual, 0) AS actual, coalesce(hits, 0) AS hits, coalesce(hits, 0) / predicted::DOUBLE AS precision, coalesce(found, 0) / nullif(actual, 0)::DOUBLE AS recall FROM c LEFT JOIN k ON c.id = k.id LEFT JOIN x ON c.id = x.id LEFT JOIN y ON c.id = y.id""", "ev")  # fmt: skip
def n5_overlaps(d: Data):
    """Ranges of each id that overlap a true one."""
    return detect.evaluate(detect.ranges(observations(d), 0.7, 2).select("id", "a", "b"), true_ranges(d))


@query("n6_label_ranges", "id start stop", "",
       "w AS (SELECT CASE WHEN eid % 50 = 0 THEN NULL ELSE id END AS id, CAST(ts AS DATE) AS day FROM ev), u AS (SELECT DISTINCT id FROM ev) ;; SELECT DISTINCT id, day - 1 AS start, day + 2 AS stop FROM w WHERE id IS NOT NULL UNION SELECT u.id, day - 1, day + 2 FROM (SELECT DISTINCT day FROM w WHERE id IS NULL) CROSS JOIN u", "ev")
def n6(d: Data):
    events = d.ev.select(F.when(F.col("eid") % 50 != 0, F.col("id")).alias("id"), F.to_date("ts").alias("day"))
    return detect.label_ranges(events, d.ev.select("id").distinct(), before=1, after=2)


@query("n7_stack_and_calibrate", "doc_id", "stacked",
       "j AS (SELECT d.doc_id, least(1, n_chars / 5000.0) AS a, l.quality::DOUBLE AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id) ;; SELECT doc_id, avg((a + b) / 2) AS stacked FROM j GROUP BY doc_id", "")
def n7(d: Data):
    a = d.table("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"))
    b = d.table("labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return detect.stacked([a, b], "doc_id")


@query("n7_platt", "n", "slope intercept", None, "")
def n7b(d: Data):
    j = d.table("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score")).join(d.table("labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return detect.platt(j, steps=25)


@query("n8_champion_challenger", "model n promoted", "mae rmse mape",
       "f AS (SELECT id, eid, value AS y, lag(value) OVER w AS a, avg(value) OVER (PARTITION BY id ORDER BY ts, eid ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM ev WINDOW w AS (PARTITION BY id ORDER BY ts, eid)), l AS (SELECT 'champion' AS model, y, a AS p FROM f WHERE a IS NOT NULL UNION ALL SELECT 'challenger', y, b FROM f WHERE b IS NOT NULL), m AS (SELECT model, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p) / (abs(y) + 1e-9)) AS mape FROM l GROUP BY model) ;; SELECT model, n, mae, rmse, mape, model = 'challenger' AND mae < 0.98 * (SELECT mae FROM m WHERE model = 'champion') AS promoted FROM m", "ev")
def n8(d: Data):
    f = observations(d).select(F.col("x").alias("y"), F.lag("x").over(by_id()).alias("champion"), F.avg("x").over(by_id().rowsBetween(-5, -1)).alias("challenger"))
    m = detect.model_errors(f.unpivot(["y"], ["champion", "challenger"], "model", "p").where("p is not null"))
    champion = m.where("model = 'champion'").select(F.col("mae").alias("_base"))  # one row
    return m.join(F.broadcast(champion)).withColumn("promoted", (F.col("model") == "challenger") & (F.col("mae") < 0.98 * F.col("_base")))
