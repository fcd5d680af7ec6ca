"""Joins in time and on keys (J rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import EPS, frame, lag
from ..operators import calendar, select
from ..operators.asof import asof_join
from ..sources.tables import Data
from .registry import query
from .sql import lag as slag
from .sql import over

#: One record for each code and publication date: the last one.
SNAP = "sn AS (SELECT code, published AS date, max(rec) AS rec, arg_max(amount, rec) AS amount, arg_max(status, rec) AS status FROM snapshots GROUP BY code, published)"


def daily_snapshots(d: Data):
    s = d.snapshots.groupBy("code", "published").agg(F.max("rec").alias("rec"), F.max_by("amount", "rec").alias("amount"), F.max_by("status", "rec").alias("status"))
    return s.withColumnRenamed("published", "date")


@query("j1_asof", "code date rec status", "amount", SNAP + " ;; SELECT b.code, b.date, rec, status, amount FROM bars b ASOF LEFT JOIN sn ON b.code = sn.code AND b.date >= sn.date", "bars snapshots")
def j1(d: Data):
    return asof_join(d.bars, daily_snapshots(d), ["code"], "date", ["rec", "status", "amount"])


@query("j2_asof_market", "code date", "total",
       "s AS (SELECT published AS date, sum(amount) AS total FROM snapshots GROUP BY published), g AS (SELECT c.date, total FROM (SELECT DISTINCT date FROM bars) c ASOF LEFT JOIN s ON c.date >= s.date) ;; SELECT code, b.date, total FROM bars b JOIN g ON b.date = g.date", "bars snapshots")
def j2(d: Data):
    series = d.snapshots.groupBy(F.col("published").alias("date")).agg(F.sum("amount").alias("total"))
    dates = asof_join(d.bars.select("date").distinct(), series, [], "date", ["total"])  # one row for each date
    return d.bars.join(dates, "date")


@query("j3_asof_forward", "code date rec", "amount", SNAP + " ;; SELECT b.code, b.date, rec, amount FROM bars b ASOF LEFT JOIN sn ON b.code = sn.code AND b.date <= sn.date", "bars snapshots")
def j3(d: Data):
    return asof_join(d.bars, daily_snapshots(d), ["code"], "date", ["rec", "amount"], forward=True)


@query("j4_asof_expiry", "code date rec", "amount", SNAP + " ;; SELECT b.code, b.date, rec, amount FROM bars b ASOF JOIN sn ON b.code = sn.code AND b.date >= sn.date WHERE b.date <= sn.date + 20", "bars snapshots")
def j4(d: Data):
    s = daily_snapshots(d).withColumn("until", F.date_add("date", 20))
    return asof_join(d.bars, s, ["code"], "date", ["rec", "amount", "until"]).where("date <= until")


INTERVALS = """sp AS (SELECT priority, published, sum(amount) AS amount FROM snapshots GROUP BY ALL),
se AS (SELECT sp.*, c.date AS start FROM sp ASOF JOIN (SELECT date FROM calendar) c ON sp.published < c.date), s1 AS (SELECT priority, start, max(published) AS published, arg_max(amount, published) AS amount FROM se GROUP BY ALL),
iv AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY priority ORDER BY start) - 1, DATE '2999-12-31') AS stop FROM s1)"""


def intervals(d: Data):
    """Validity ranges by priority: from the business day after publication to the day before the next range."""
    sums = d.snapshots.groupBy("priority", "published").agg(F.sum("amount").alias("amount"))
    starts = calendar.next_business_day(sums, "published", d.calendar, "start").where("start is not null")
    one = starts.groupBy("priority", "start").agg(F.max("published").alias("published"), F.max_by("amount", "published").alias("amount"))
    until = F.lead("start").over(Window.partitionBy("priority").orderBy("start"))
    return one.withColumn("stop", F.coalesce(F.date_sub(until, 1), F.lit("2999-12-31").cast("date")))


@query("j5_intervals", "priority date start stop", "amount",
       INTERVALS + " ;; SELECT priority, c.date, start, stop, amount FROM calendar c JOIN iv ON c.date BETWEEN start AND stop", "calendar snapshots")
def j5(d: Data):
    # ranges of one priority do not overlap: the join is an as-of join of every date with each priority
    iv = intervals(d).withColumn("date", F.col("start"))
    grid = d.calendar.select("date").join(F.broadcast(iv.select("priority").distinct()))  # a handful of priorities
    return asof_join(grid, iv, ["priority"], "date", ["start", "stop", "amount"]).where("date <= stop")


STATEMENTS = """st AS (SELECT *, rec % 24 AS hour FROM snapshots), sd AS (SELECT code, published, arg_max(struct_pack(rec := rec, amount := amount, hour := hour), hour * 100000000 + rec) AS s FROM st GROUP BY code, published),
sf AS (SELECT code, s.rec AS rec, s.amount AS amount, published, CASE WHEN s.hour < 15 THEN published ELSE n.date END AS date FROM sd ASOF LEFT JOIN (SELECT date FROM calendar) n ON sd.published < n.date),
su AS (SELECT code, date, max(rec) AS rec, arg_max(amount, rec) AS amount FROM sf WHERE date IS NOT NULL GROUP BY code, date)"""


def statements(d: Data):
    """Statements by the date from which they may be used: the day itself before 15:00, else the next business day."""
    s = d.snapshots.withColumn("hour", F.col("rec") % 24)
    last = s.groupBy("code", "published").agg(F.max(F.struct("hour", "rec", "amount")).alias("s")).select("code", "published", "s.*")
    placed = calendar.next_business_day(last, "published", d.calendar, "next")
    placed = placed.withColumn("date", F.when(F.col("hour") < 15, F.col("published")).otherwise(F.col("next"))).where("date is not null")
    return placed.groupBy("code", "date").agg(F.max("rec").alias("rec"), F.max_by("amount", "rec").alias("amount"))


@query("j6_statement_join", "code date rec impulse days_since", "amount",
       STATEMENTS + " ;; SELECT b.code, b.date, rec, CAST(coalesce(b.date = su.date, false) AS INT) AS impulse, coalesce(b.date - su.date, 999) AS days_since, amount FROM bars b ASOF LEFT JOIN su ON b.code = su.code AND b.date >= su.date", "bars snapshots calendar")
def j6(d: Data):
    s = statements(d).withColumn("effective", F.col("date"))
    j = asof_join(d.bars, s, ["code"], "date", ["rec", "amount", "effective"])
    return j.withColumns({"impulse": F.coalesce(F.col("date") == F.col("effective"), F.lit(False)).cast("int"), "days_since": F.coalesce(F.datediff("date", "effective"), F.lit(999))})


@query("j7_availability", "rec available", "",
       "SELECT rec, strftime(CAST(coalesce(n.date, CASE WHEN isodow(published) = 5 THEN published + 3 WHEN isodow(published) = 6 THEN published + 2 ELSE published + 1 END) AS TIMESTAMP) + INTERVAL 9 HOUR - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS available FROM snapshots s ASOF LEFT JOIN (SELECT date FROM calendar) n ON s.published < n.date", "snapshots calendar")
def j7(d: Data):
    s = calendar.next_business_day(d.snapshots, "published", d.calendar, "next")
    weekday = F.weekday("published")  # Monday is 0
    other = F.when(weekday == 4, F.date_add("published", 3)).when(weekday == 5, F.date_add("published", 2)).otherwise(F.date_add("published", 1))
    local = F.coalesce("next", other).cast("timestamp") + F.expr("interval 9 hours")
    return s.select("rec", F.date_format(F.to_utc_timestamp(local, "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("available"))


@query("j8_cutoff", "rec available", "",
       "s AS (SELECT *, rec % 24 AS hour FROM snapshots) ;; SELECT rec, strftime(CASE WHEN hour <= 15 THEN published::TIMESTAMP + INTERVAL 15 HOUR ELSE n.date::TIMESTAMP + INTERVAL 9 HOUR END, '%Y-%m-%d %H:%M') AS available FROM s ASOF LEFT JOIN (SELECT date FROM calendar) n ON s.published < n.date", "snapshots calendar")
def j8(d: Data):
    s = calendar.next_business_day(d.snapshots, "published", d.calendar, "next")
    at = F.when(F.col("rec") % 24 <= 15, F.col("published").cast("timestamp") + F.expr("interval 15 hours")).otherwise(F.col("next").cast("timestamp") + F.expr("interval 9 hours"))
    return s.select("rec", F.date_format(at, "yyyy-MM-dd HH:mm").alias("available"))


@query("j9_latest_correction", "code published rec", "amount",
       "SELECT code, published, max(rec) AS rec, arg_max(amount, rec) AS amount FROM snapshots WHERE status <> 'P' GROUP BY code, published", "snapshots")
def j9(d: Data):
    return select.keep_last(d.snapshots.where("status <> 'P'"), ["code", "published"], ["rec"])


FILL = SNAP + ", f AS (SELECT b.code, b.date, sn.amount AS raw FROM bars b LEFT JOIN sn ON b.code = sn.code AND b.date = sn.date)"


@query("j10_forward_fill", "code date", "raw filled", FILL + f" ;; SELECT code, date, raw, last_value(raw IGNORE NULLS) OVER {over('all', 0)} AS filled FROM f", "bars snapshots")
def j10(d: Data):
    f = d.bars.select("code", "date").join(daily_snapshots(d).select("code", "date", F.col("amount").alias("raw")), ["code", "date"], "left")
    return f.withColumn("filled", F.last("raw", ignorenulls=True).over(frame(Window.unboundedPreceding, 0)))


@query("j11_market_join", "code date values", "m_close", "c AS (SELECT date, count(DISTINCT m_close) AS values FROM market GROUP BY date) ;; SELECT b.code, b.date, m_close, values FROM bars b LEFT JOIN market m ON b.date = m.date LEFT JOIN c ON b.date = c.date", "bars market")
def j11(d: Data):
    one = d.market.groupBy("date").agg(F.max("m_close").alias("m_close"), F.countDistinct("m_close").alias("values"))
    return d.bars.join(one, "date", "left")


@query("j12_outer_join", "date", "a b c",
       "x AS (SELECT date, avg(price) AS a FROM trades GROUP BY date), y AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS b FROM ev GROUP BY ALL), z AS (SELECT published AS date, sum(amount) AS c FROM snapshots GROUP BY published) ;; SELECT coalesce(x.date, y.date, z.date) AS date, a, b, c FROM x FULL JOIN y ON x.date = y.date FULL JOIN z ON coalesce(x.date, y.date) = z.date", "trades ev snapshots")
def j12(d: Data):
    """Three daily series side by side; a date that any of them has stays."""
    x = d.trades.groupBy("date").agg(F.avg("price").alias("a"))
    y = d.ev.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("b"))
    z = d.snapshots.groupBy(F.col("published").alias("date")).agg(F.sum("amount").alias("c"))
    return x.join(y, "date", "full").join(z, "date", "full")


@query("j13_semi_anti", "code date side", "",
       SNAP + " ;; SELECT code, date, 'both' AS side FROM bars SEMI JOIN sn USING (code, date) UNION ALL SELECT code, date, 'bars' FROM bars ANTI JOIN sn USING (code, date) UNION ALL SELECT code, date, 'snapshots' FROM sn ANTI JOIN bars USING (code, date)", "bars snapshots")
def j13(d: Data):
    keys = ["code", "date"]
    # each key once, dealt as the joins need them
    s = d.snapshots.select("code", F.col("published").alias("date"))
    b, s = (d.dealt(x, *keys).distinct() for x in (d.trades.select(*keys), s))
    # one join gives the rows of the semi join and of both anti joins
    met = b.withColumn("_b", F.lit(True)).join(s.withColumn("_s", F.lit(True)), keys, "full")
    return met.withColumn("side", F.when(F.col("_b") & F.col("_s"), "both").when(F.col("_b"), "bars").otherwise("snapshots"))


@query("j14_prior_year", "code fy q", "sales growth",
       "s AS (SELECT code, year(published) AS fy, quarter(published) AS q, sum(amount) AS sales FROM snapshots GROUP BY ALL) ;; SELECT a.code, a.fy, a.q, a.sales, (a.sales - b.sales) / (abs(b.sales) + 1e-12) AS growth FROM s a LEFT JOIN s b ON a.code = b.code AND a.fy = b.fy + 1 AND a.q = b.q", "snapshots")
def j14(d: Data):
    s = d.snapshots.groupBy("code", F.year("published").alias("fy"), F.quarter("published").alias("q")).agg(F.sum("amount").alias("sales"))
    before = s.select("code", (F.col("fy") + 1).alias("fy"), "q", F.col("sales").alias("last"))
    return s.join(before, ["code", "fy", "q"], "left").withColumn("growth", (F.col("sales") - F.col("last")) / (F.abs("last") + EPS))


@query("j15_fallback", "code date", "flow",
       """f AS (SELECT published AS date, (rec % 5)::INT AS section, sum(amount) AS flow FROM snapshots GROUP BY ALL), a AS (SELECT date, avg(flow) AS day FROM f GROUP BY date), p AS (SELECT code, date, CASE WHEN market = 4 THEN 0 ELSE market END AS section FROM panel) ;;
SELECT code, p.date, coalesce(f.flow, g.flow, day) AS flow FROM p LEFT JOIN f ON p.date = f.date AND p.section = f.section LEFT JOIN f g ON p.date = g.date AND g.section = 0 LEFT JOIN a ON p.date = a.date""", "panel snapshots")  # fmt: skip
def j15(d: Data):
    f = d.snapshots.groupBy(F.col("published").alias("date"), (F.col("rec") % 5).cast("int").alias("section")).agg(F.sum("amount").alias("flow"))
    p = d.panel.select("code", "date", F.when(F.col("market") == 4, 0).otherwise(F.col("market")).alias("section"))
    default = f.where("section = 0").select("date", F.col("flow").alias("default"))
    day = f.groupBy("date").agg(F.avg("flow").alias("day"))
    j = p.join(f, ["date", "section"], "left").join(default, "date", "left").join(day, "date", "left")
    return j.withColumn("flow", F.coalesce("flow", "default", "day"))


@query("j16_leak_guard", "code date rec", "", SNAP + " ;; SELECT b.code, b.date, sn.rec FROM bars b JOIN sn ON b.code = sn.code AND sn.date > b.date AND sn.date <= b.date + 3", "bars snapshots")
def j16(d: Data):
    # what a join on nearest dates would leak: records of the three days after a bar
    days = F.explode(F.array(*[F.date_sub("date", k) for k in (1, 2, 3)]))
    early = daily_snapshots(d).select("code", days.alias("date"), "rec")
    return d.bars.select("code", "date").join(early, ["code", "date"])
