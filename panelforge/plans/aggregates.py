"""Aggregates, selections, set operations and scalar functions (A, T, U, F, V rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import clip, correlation, normal_cdf
from ..operators import select
from ..sources.tables import Data
from .registry import query
from .sql import average_rank as saverage_rank
from .sql import clip as sclip
from .sql import over
from .windows import RETURNS, _returns


@query("a1_hash_aggregate", "l_returnflag l_linestatus n", "sum_qty sum_base sum_disc sum_charge avg_qty avg_price",
       """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price FROM lineitem GROUP BY ALL""", "")  # fmt: skip
def a1(d: Data):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return d.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(net).alias("sum_disc"), F.sum(net * (1 + F.col("l_tax"))).alias("sum_charge"), F.avg("l_quantity").alias("avg_qty"), F.avg("l_extendedprice").alias("avg_price"))


@query("a2_conditional", "sector n_up", "up_turnover down_turnover up_share",
       "p AS (SELECT *, close > open AS up FROM panel) ;; SELECT sector, sum(turnover) FILTER (up) AS up_turnover, sum(turnover) FILTER (NOT up) AS down_turnover, count(*) FILTER (up) AS n_up, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) AS up_share FROM p GROUP BY sector", "panel")
def a2(d: Data):
    up = F.col("close") > F.col("open")
    return d.panel.groupBy("sector").agg(F.sum(F.when(up, F.col("turnover"))).alias("up_turnover"), F.sum(F.when(~up, F.col("turnover"))).alias("down_turnover"), F.count_if(up).alias("n_up"), F.avg(F.when(up, 1.0).otherwise(0.0)).alias("up_share"))


@query("a3_herfindahl", "date", "hhi top_share", "s AS (SELECT date, turnover / sum(turnover) OVER (PARTITION BY date) AS s FROM bars) ;; SELECT date, sum(s * s) AS hhi, max(s) AS top_share FROM s GROUP BY date")
def a3(d: Data):
    s = F.col("turnover") / F.col("total")
    totals = d.bars.groupBy("date").agg(F.sum(F.col("turnover") * F.col("turnover")).alias("ss"), F.sum("turnover").alias("total"), F.max("turnover").alias("turnover"))
    return totals.select("date", (F.col("ss") / (F.col("total") * F.col("total"))).alias("hhi"), s.alias("top_share"))


@query("a4_first_last", "code first_date last_date", "first_close last_close", "SELECT code, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM bars GROUP BY code")
def a4(d: Data):
    return d.bars.groupBy("code").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))


@query("a5_distinct", "code n_parts n_dates", "", "SELECT code, count(DISTINCT part) AS n_parts, count(DISTINCT date) AS n_dates FROM trades GROUP BY code", "trades")
def a5(d: Data):
    return d.trades.groupBy("code").agg(F.countDistinct("part").alias("n_parts"), F.countDistinct("date").alias("n_dates"))


@query("a6_quantiles", "sector", "med q10 q90", "SELECT sector, median(close) AS med, quantile_cont(close, 0.1) AS q10, quantile_cont(close, 0.9) AS q90 FROM panel GROUP BY sector", "panel")
def a6(d: Data):
    q = select.quantiles(d.panel, "close", [0.5, 0.1, 0.9], "sector")
    return q.select("sector", F.col("q")[0].alias("med"), F.col("q")[1].alias("q10"), F.col("q")[2].alias("q90"))


@query("a7_correlation", "sector", "c", "SELECT sector, corr(close, volume) AS c FROM panel GROUP BY sector", "panel")
def a7(d: Data):
    return d.panel.groupBy("sector").agg(correlation("close", "volume").alias("c"))


@query("a8_pivot", "sector", "m0 m1 m2 m3 m4", "SELECT sector, " + ", ".join(f"sum(turnover) FILTER (year(date) % 5 = {k}) AS m{k}" for k in range(5)) + " FROM panel GROUP BY sector", "panel")
def a8(d: Data):
    p = d.panel.withColumn("k", F.concat(F.lit("m"), F.year("date") % 5))
    return p.groupBy("sector").pivot("k", [f"m{k}" for k in range(5)]).agg(F.sum("turnover"))


@query("a9_row_aggregates", "doc_id n_known any_set all_set", "total mean low high",
       """j AS (SELECT d.doc_id, d.n_chars::DOUBLE AS a, l.quality::DOUBLE AS b, l.toxic::DOUBLE AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n_known FROM j) ;;
SELECT doc_id, n_known, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS total, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(n_known, 0) AS mean, least(a, b, c) AS low, greatest(a, b, c) AS high, coalesce(b > 0, false) OR coalesce(c > 0, false) AS any_set, coalesce(b > 0, false) AND coalesce(c > 0, false) AS all_set FROM k""", "")  # fmt: skip
def a9(d: Data):
    j = d.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("a")).join(d.table("labels").select("doc_id", F.col("quality").cast("double").alias("b"), F.col("toxic").cast("double").alias("c")), "doc_id", "left")
    cols = ("a", "b", "c")
    known = sum(F.col(c).isNotNull().cast("int") for c in cols)
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in cols)
    b, c = (F.coalesce(F.col(x) > 0, F.lit(False)) for x in ("b", "c"))
    return j.select("doc_id", known.alias("n_known"), total.alias("total"), F.try_divide(total, known).alias("mean"), F.least(*cols).alias("low"), F.greatest(*cols).alias("high"), (b | c).alias("any_set"), (b & c).alias("all_set"))


PROFILED = ("close", "volume", "turnover")


@query("a10_profile", "name rows nulls", "mean std p01 p50 p99",
       " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.01) AS p01, median({c}) AS p50, quantile_cont({c}, 0.99) AS p99 FROM bars" for c in PROFILED))
def a10(d: Data):
    long = d.bars.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in PROFILED])).alias("s")).select("s.*")
    g = long.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count("x")).alias("nulls"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    q = select.quantiles(long, "x", [0.01, 0.5, 0.99], "name")
    return g.join(q, "name", "left").select("*", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99"))


@query("t1_sorted_head", "code date", "close", "SELECT code, date, close FROM bars WHERE high > 1.5 * low ORDER BY code, date LIMIT 500")
def t1(d: Data):
    return d.bars.where("high > 1.5 * low").orderBy("code", "date").limit(500)


TOP = "q AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS rank, count(*) OVER (PARTITION BY set, date) AS n FROM pred)"
BY = ("set", "date")


@query("t2_top_k", "set date code rank", "score", TOP + " ;; SELECT set, date, code, rank, score FROM q WHERE rank <= greatest(1, CAST(floor(0.1::DOUBLE * n) AS BIGINT))", "pred")
def t2(d: Data):
    return select.top_k(d.pred, "score", ratio=0.1, by=BY)


@query("t3_percentile_selection", "set date code", "score",
       TOP + ", c AS (SELECT set, date, quantile_cont(score, 0.8) AS cut FROM q GROUP BY set, date), s AS (SELECT q.*, score >= cut AS above, count(*) FILTER (score >= cut) OVER (PARTITION BY q.set, q.date) AS m FROM q JOIN c ON q.set = c.set AND q.date = c.date) ;; SELECT set, date, code, score FROM s WHERE CASE WHEN m >= 3 THEN above ELSE rank <= 3 END", "pred")
def t3(d: Data):
    return select.above_percentile(d.pred, "score", 0.2, 3, BY)


@query("t4_adaptive_ratio", "set date n", "ratio", "SELECT set, date, count(*) AS n, greatest(0.05, least(1.0, ceil(0.5 * 10) / count(*)::DOUBLE)) AS ratio FROM pred GROUP BY set, date", "pred")
def t4(d: Data):
    return d.pred.groupBy(*BY).agg(F.count(F.lit(1)).alias("n")).withColumn("ratio", clip(F.ceil(F.lit(0.5 * 10)) / F.col("n"), 0.05, 1.0))


@query("t5_long_short", "set date code side", "weight",
       """q AS (SELECT *, row_number() OVER (PARTITION BY set, date ORDER BY score DESC, code) AS rh, row_number() OVER (PARTITION BY set, date ORDER BY score, code) AS rl, count(*) OVER (PARTITION BY set, date) AS n FROM pred),
s AS (SELECT *, CASE WHEN rh <= greatest(1, floor(0.2::DOUBLE * n)) THEN 'long' WHEN rl <= greatest(1, floor(0.2::DOUBLE * n)) THEN 'short' END AS side FROM q) ;;
SELECT set, date, code, side, CASE side WHEN 'long' THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY set, date, side) AS weight FROM s WHERE side IS NOT NULL""", "pred")  # fmt: skip
def t5(d: Data):
    return select.long_short(d.pred, "score", 0.2, BY)


@query("t6_feature_pairs", "a b", "rho",
       "v AS (SELECT " + ", ".join(f"{saverage_rank(c, '1')} AS {c}" for c in ("close", "volume", "turnover", "high")) + " FROM bars) ;; " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM v" for i, a in enumerate(("close", "volume", "turnover", "high")) for b in ("close", "volume", "turnover", "high")[i + 1:]))
def t6(d: Data):
    return select.rank_correlations(d.bars, ["close", "volume", "turnover", "high"])


@query("t7_extreme_days", "date kind", "m", RETURNS.replace(" ;;", "") + ", m AS (SELECT date, avg(r) AS m FROM b WHERE r IS NOT NULL GROUP BY date) ;; (SELECT date, 'best' AS kind, m FROM m ORDER BY m DESC, date LIMIT 10) UNION ALL (SELECT date, 'worst' AS kind, m FROM m ORDER BY m, date LIMIT 10)")
def t7(d: Data):
    m = _returns(d).where("r is not null").groupBy("date").agg(F.avg("r").alias("m"))
    best = m.orderBy(F.desc("m"), "date").limit(10).withColumn("kind", F.lit("best"))
    return best.unionByName(m.orderBy("m", "date").limit(10).withColumn("kind", F.lit("worst")))


@query("u1_union", "code date flag", "close volume", "SELECT code, date, close, volume, NULL::INT AS flag FROM bars WHERE code % 2 = 0 UNION ALL SELECT code, date, close, NULL::DOUBLE AS volume, 1 AS flag FROM bars WHERE code % 2 = 1")
def u1(d: Data):
    even = d.bars.where("code % 2 = 0").select("code", "date", "close", "volume")
    return even.unionByName(d.bars.where("code % 2 = 1").select("code", "date", "close", F.lit(1).alias("flag")), allowMissingColumns=True)


@query("u2_dedup_keep_last", "code date seq", "price", "SELECT code, date, max(seq) AS seq, arg_max(price, seq) AS price FROM trades GROUP BY code, date", "trades")
def u2(d: Data):
    return select.keep_last(d.trades, ["code", "date"], ["seq"])


@query("u3_key_difference", "code date side", "",
       "a AS (SELECT code, date FROM bars WHERE volume > 20), b AS (SELECT code, date FROM bars WHERE close > 1000) ;; SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u3(d: Data):
    a, b = (d.bars.where(c).select("code", "date") for c in ("volume > 20", "close > 1000"))
    return a.join(b, ["code", "date"], "left_anti").withColumn("side", F.lit("left")).unionByName(a.join(b, ["code", "date"], "left_semi").withColumn("side", F.lit("both")))


@query("u4_selection_stability", "set date", "jaccard",
       TOP + """, s AS (SELECT set, date, list(code) AS c FROM q WHERE rank <= 5 GROUP BY set, date), l AS (SELECT set, date, c, lag(c) OVER (PARTITION BY set ORDER BY date) AS p FROM s) ;;
SELECT set, date, len(list_intersect(c, p)) / len(list_distinct(list_concat(c, p)))::DOUBLE AS jaccard FROM l WHERE p IS NOT NULL""", "pred")  # fmt: skip
def u4(d: Data):
    s = select.top_k(d.pred, "score", k=5, by=BY).groupBy(*BY).agg(F.collect_set("code").alias("c"))
    l = s.withColumn("p", F.lag("c").over(Window.partitionBy("set").orderBy("date"))).where("p is not null")  # noqa: E741
    return l.select("set", "date", (F.size(F.array_intersect("c", "p")) / F.size(F.array_union("c", "p"))).alias("jaccard"))


@query("u5_label_union", "id start type", "", "SELECT DISTINCT id, CAST(ts AS DATE) AS start, type FROM ev WHERE value > 50 UNION SELECT DISTINCT id, CAST(ts AS DATE), type FROM ev WHERE id % 2 = 0", "ev")
def u5(d: Data):
    e = d.ev.select("id", F.to_date("ts").alias("start"), "type", "value")
    return e.where("value > 50").drop("value").unionByName(e.where("id % 2 = 0").drop("value")).dropDuplicates(["id", "start", "type"])


@query("f1_strings", "p_partkey a b c d e", "",
       "SELECT p_partkey, upper(trim(p_name)) AS a, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS b, substr(p_brand, 1, 5) AS c, replace(p_type, ' ', '_') AS d, contains(p_name, 'a') AS e FROM part", "")
def f1(d: Data):
    return d.table("part").select("p_partkey", F.upper(F.trim("p_name")).alias("a"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("b"), F.substring("p_brand", 1, 5).alias("c"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("d"), F.col("p_name").contains("a").alias("e"))


@query("f2_date_parsing", "o_orderkey parsed bad", "",
       "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, NULL::DATE AS bad FROM orders", "")
def f2(d: Data):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    clean = F.regexp_replace(text, "[./]", "-")
    return d.table("orders").select("o_orderkey", F.to_date(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd"))).alias("parsed"), F.to_date(F.try_to_timestamp(F.concat(F.lit("x"), clean), F.lit("yyyy-MM-dd"))).alias("bad"))


@query("f3_date_parts", "o_orderkey week month_end days later", "",
       "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, last_day(o_orderdate) AS month_end, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate AS DATE) + 7 AS later FROM orders", "")
def f3(d: Data):
    return d.table("orders").select("o_orderkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), F.last_day("o_orderdate").alias("month_end"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("days"), F.date_add("o_orderdate", 7).alias("later"))


@query("f4_time_zones", "event_id utc_text local_day", "", "SELECT event_id, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS utc_text, CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_day FROM events", "")
def f4(d: Data):
    ts = F.col("ts").cast("timestamp")
    return d.table("events").select("event_id", F.date_format(F.to_utc_timestamp(ts, "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("utc_text"), F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo")).alias("local_day"))


@query("f5_math", "event_id", "l e s p g c h q", "SELECT event_id, ln(1 + abs(value)) AS l, exp(-abs(value) / 100) AS e, sqrt(abs(value)) AS s, power(value, 2) AS p, sign(value - 50) AS g, greatest(10, least(90, value)) AS c, greatest(value - 50, 0) AS h, 1 / (1 + exp(-value / 100)) AS q FROM events", "")
def f5(d: Data):
    v = F.col("value")
    return d.table("events").select("event_id", F.log(1 + F.abs(v)).alias("l"), F.exp(-F.abs(v) / 100).alias("e"), F.sqrt(F.abs(v)).alias("s"), F.pow(v, 2).alias("p"), F.signum(v - 50).alias("g"), clip(v, 10.0, 90.0).alias("c"), F.greatest(v - 50, F.lit(0.0)).alias("h"), (1 / (1 + F.exp(-v / 100))).alias("q"))


@query("f6_normal", "event_id", "cdf pdf",
       """x AS (SELECT event_id, (value - 50) / 25 AS x FROM events), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t, exp(-x * x / 2) / 2.5066282746310002 AS pdf FROM x),
u AS (SELECT *, pdf * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t) ;; SELECT event_id, CASE WHEN x >= 0 THEN 1 - tail ELSE tail END AS cdf, pdf FROM u""", "")  # fmt: skip
def f6(d: Data):
    x = (F.col("value") - 50) / 25
    return d.table("events").select("event_id", normal_cdf(x).alias("cdf"), (F.exp(-x * x / 2) / 2.5066282746310002).alias("pdf"))


@query("f7_arrays", "vec_id positives", "first dot", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positives, embedding[1] AS first, list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS dot FROM embeddings", "")
def f7(d: Data):
    e = F.col("embedding").cast("array<double>")
    return d.table("embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).alias("positives"), e[0].alias("first"), F.aggregate(F.zip_with(e, F.reverse(e), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("dot"))


@query("f8_json", "event_id k big", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS big FROM events", "")
def f8(d: Data):
    k = F.from_json("props", "k long")["k"]
    return d.table("events").select("event_id", k.alias("k"), (k > 50).alias("big"))


@query("f9_hash_fold", "code fold n", "", "SELECT code, CAST(('0x' || substr(md5(CAST(code AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, count(*) AS n FROM bars GROUP BY code")
def f9(d: Data):
    fold = F.conv(F.substring(F.md5(F.col("code").cast("string")), 1, 8), 16, 10).cast("long") % 5
    return d.bars.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", fold)


@query("v1_group_function", "code n", "slope", "SELECT code, count(*) AS n, regr_slope(close, date_diff('day', DATE '1995-01-01', date)::DOUBLE) AS slope FROM bars GROUP BY code")
def v1(d: Data):
    return select.slopes(d.bars)


@query("v2_scalar_function", "p_partkey label", "", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END || '-' || CAST(p_size AS VARCHAR) AS label FROM part", "")
def v2(d: Data):
    size = F.when(F.col("p_size") < 10, "S").when(F.col("p_size") < 30, "M").otherwise("L")
    return d.table("part").select("p_partkey", F.concat(size, F.lit("-"), F.col("p_size").cast("string")).alias("label"))
