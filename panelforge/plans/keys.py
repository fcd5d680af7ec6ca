"""Keys, dimensions, calendars and corporate actions (K rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import EPS, frame, lag, lead, lroll
from ..operators import actions, calendar, select
from ..sources.tables import Data
from .registry import query
from .sql import lag as slag
from .sql import lead as slead
from .sql import lroll as slroll
from .sql import over


@query("k1_code_normalisation", "c_custkey norm valid", "",
       "SELECT c_custkey, lpad(regexp_replace(trim(c_name), '^[^0-9]*0*', ''), 6, '0') AS norm, regexp_matches(c_name, '[0-9]$') AS valid FROM customer", "")
def k1(d: Data):
    return d.table("customer").select("c_custkey", F.lpad(F.regexp_replace(F.trim("c_name"), "^[^0-9]*0*", ""), 6, "0").alias("norm"), F.col("c_name").rlike("[0-9]$").alias("valid"))


@query("k2_canonical_ohlc", "code date", "open high low close",
       "a AS (SELECT *, CASE WHEN code % 3 = 0 THEN close * 0.5 END AS adj FROM bars) ;; SELECT code, date, open * coalesce(adj / close, 1) AS open, high * coalesce(adj / close, 1) AS high, low * coalesce(adj / close, 1) AS low, coalesce(adj, close) AS close FROM a")
def k2(d: Data):
    adjusted = {c: F.when(F.col("code") % 3 == 0, F.col(c) * 0.5) for c in ("open", "high", "low", "close")}
    return d.bars.select("code", "date", *[F.coalesce(a, F.col(c)).alias(c) for c, a in adjusted.items()])


@query("k4_ensure_columns", "code date flag note", "close extra", "SELECT code, date, close, NULL::DOUBLE AS extra, 0 AS flag, NULL::VARCHAR AS note FROM bars")
def k4(d: Data):
    return actions.ensure_columns(d.bars, {"extra": ("double", None), "flag": ("int", 0), "note": ("string", None), "close": ("double", None)})


@query("k5_market_filter", "code date market known", "", "SELECT code, date, market, true AS known FROM panel WHERE market IN (0, 2, 9) UNION ALL SELECT NULL, NULL, m, false FROM (VALUES (0), (2), (9)) v(m) WHERE m NOT IN (SELECT market FROM panel WHERE market IS NOT NULL)", "panel")
def k5(d: Data):
    wanted = d.spark.createDataFrame([(0,), (2,), (9,)], "market int")
    kept = d.panel.join(F.broadcast(wanted), "market", "left_semi").select("code", "date", "market", F.lit(True).alias("known"))
    unknown = wanted.join(d.panel.select("market").distinct(), "market", "left_anti")
    return kept.unionByName(unknown.select(F.lit(None).cast("long").alias("code"), F.lit(None).cast("date").alias("date"), "market", F.lit(False).alias("known")))


DIMENSION = "ds AS (SELECT code, min(date) AS effective, row_number() OVER (ORDER BY code) AS sec_id FROM bars GROUP BY code)"


def dimension(d: Data):
    first = d.bars.groupBy("code").agg(F.min("date").alias("effective"))
    return select.global_rank(first, "code", "sec_id").withColumn("sec_id", F.col("sec_id").cast("long"))  # one row for each code, so ranks are numbers


@query("k6_dim_security", "code effective sec_id", "", DIMENSION + " ;; SELECT * FROM ds")
def k6(d: Data):
    return dimension(d)


@query("k7_attach_id", "code date sec_id status", "", DIMENSION + ", e AS (SELECT * FROM ds WHERE code % 10 <> 7) ;; SELECT b.code, date, sec_id, CASE WHEN sec_id IS NULL THEN 'rejected' ELSE 'ok' END AS status FROM bars b LEFT JOIN e ON b.code = e.code")
def k7(d: Data):
    known = dimension(d).where("code % 10 <> 7")
    return d.bars.join(known, "code", "left").withColumn("status", F.when(F.col("sec_id").isNull(), "rejected").otherwise("ok"))


@query("k8_align_listed", "code date sector", "", "SELECT b.code, date, CASE WHEN b.code % 4 = 0 OR sector IS NULL THEN 'UNKNOWN' ELSE CAST(sector AS VARCHAR) END AS sector FROM bars b LEFT JOIN dim d ON b.code = d.code", "bars dim")
def k8(d: Data):
    listed = d.dim.select("code", F.when(F.col("code") % 4 != 0, F.col("sector").cast("string")).alias("listed"))
    return d.bars.withColumn("own", F.lit("")).join(listed, "code", "left").withColumn("sector", F.coalesce(F.nullif("own", F.lit("")), "listed", F.lit("UNKNOWN")))


@query("k9_calendar_padding", "code date is_calendar_pad is_trading_day", "close",
       "c AS (SELECT DISTINCT code FROM bars), g AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-31', INTERVAL 1 DAY))::DATE AS date), t AS (SELECT DISTINCT date FROM bars) ;; SELECT c.code, g.date, b.close, b.close IS NULL AS is_calendar_pad, t.date IS NOT NULL AS is_trading_day FROM c CROSS JOIN g LEFT JOIN bars b ON b.code = c.code AND b.date = g.date LEFT JOIN t ON t.date = g.date")
def k9(d: Data):
    return actions.padded(d.bars, "1996-01-01", "1996-03-31")


@query("k10_base_quotes", "code date row_idx seq", "price",
       "l AS (SELECT code, date, max(seq) AS seq, arg_max(price, seq) AS price FROM trades GROUP BY code, date) ;; SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS row_idx, seq, price FROM l", "trades")
def k10(d: Data):
    last = select.keep_last(d.trades.select("code", "date", "seq", "price"), ["code", "date"], ["seq"])
    return last.withColumn("row_idx", F.row_number().over(Window.partitionBy("code").orderBy("date")))


@query("k11_business_days", "code date next3 prev2 since", "",
       "f AS (SELECT code, min(date) AS first FROM bars GROUP BY code) ;; SELECT b.code, b.date, n.date AS next3, p.date AS prev2, c.idx - fc.idx AS since FROM bars b JOIN calendar c ON c.date = b.date LEFT JOIN calendar n ON n.idx = c.idx + 3 LEFT JOIN calendar p ON p.idx = c.idx - 2 JOIN f ON f.code = b.code JOIN calendar fc ON fc.date = f.first", "bars calendar")
def k11(d: Data):
    c = d.calendar
    b = calendar.shifted(calendar.shifted(d.bars.select("code", "date"), "date", c, 3, "next3"), "date", c, -2, "prev2")
    idx = c.select("date", "idx")
    b = b.join(idx, "date")
    return b.withColumn("since", F.col("idx") - F.min("idx").over(Window.partitionBy("code")))


@query("k12_next_day", "rec effective", "", "SELECT rec, coalesce(n.date, published + 1) AS effective FROM snapshots s ASOF LEFT JOIN (SELECT date FROM calendar) n ON s.published < n.date", "snapshots calendar")
def k12(d: Data):
    return calendar.next_business_day(d.snapshots, "published", d.calendar, "n").select("rec", F.coalesce("n", F.date_add("published", 1)).alias("effective"))


@query("k13_warm_up", "code date", "mean20",
       f"w AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-12-31' - 365 AND DATE '1997-12-31'), m AS (SELECT code, date, {slroll('avg', 'close', 20, 5)} AS mean20 FROM w) ;; SELECT * FROM m WHERE date BETWEEN DATE '1996-12-31' AND DATE '1997-12-31'")
def k13(d: Data):
    start, end = F.lit("1996-12-31").cast("date"), F.lit("1997-12-31").cast("date")
    wide = d.bars.where(F.col("date").between(F.date_sub(start, 365), end))
    return wide.withColumn("mean20", lroll(F.avg, "close", 20, 5)).where(F.col("date").between(start, end))


@query("k14_liquidity", "code date", "adv60", f"a AS (SELECT code, date, {slroll('avg', 'turnover', 60, 20)} AS adv60 FROM bars) ;; SELECT * FROM a WHERE adv60 >= 30000")
def k14(d: Data):
    return d.bars.withColumn("adv60", lroll(F.avg, "turnover", 60, 20)).where("adv60 >= 30000")


@query("k15_drop_null_columns", "name kept", "null_rate",
       "j AS (SELECT d.doc_id, d.n_chars, l.quality, NULL AS empty FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ;; SELECT 'doc_id' AS name, 1 - count(doc_id) / count(*)::DOUBLE AS null_rate, true AS kept FROM j UNION ALL SELECT 'n_chars', 1 - count(n_chars) / count(*)::DOUBLE, 1 - count(n_chars) / count(*)::DOUBLE <= 0.5 FROM j UNION ALL SELECT 'quality', 1 - count(quality) / count(*)::DOUBLE, 1 - count(quality) / count(*)::DOUBLE <= 0.5 FROM j UNION ALL SELECT 'empty', 1 - count(empty) / count(*)::DOUBLE, false FROM j", "")
def k15(d: Data):
    j = d.table("documents").select("doc_id", "n_chars").join(d.table("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("empty", F.lit(None).cast("int"))
    return actions.null_rates(j).withColumn("kept", (F.col("name") == "doc_id") | (F.col("null_rate") <= 0.5))


@query("k16_macro_lag", "code date", "m_lag fx_same",
       "m AS (SELECT date, lag(m_close) OVER (ORDER BY date) AS m_lag, m_close * 2 AS fx_same FROM market) ;; SELECT code, b.date, m_lag, fx_same FROM bars b JOIN m ON b.date = m.date", "bars market")
def k16(d: Data):
    m = d.market.select("date", F.lag("m_close").over(Window.orderBy("date")).alias("m_lag"), (F.col("m_close") * 2).alias("fx_same"))  # one row for each date
    return d.bars.select("code", "date").join(m, "date")


@query("k17_next_trading_date", "code date", "feature", "SELECT b.code, c.next_date AS date, close / open - 1 AS feature FROM bars b JOIN calendar c ON b.date = c.date WHERE c.next_date IS NOT NULL", "bars calendar")
def k17(d: Data):
    f = d.bars.select("code", "date", (F.col("close") / F.col("open") - 1).alias("feature"))
    return f.join(d.calendar, "date").where("next_date is not null").select("code", F.col("next_date").alias("date"), "feature")


ACTIONS = "ac AS (SELECT code, date, CASE (code + date_diff('day', DATE '1995-01-01', date)) % 3 WHEN 0 THEN 2.0 ELSE 0.5 END AS ratio FROM bars WHERE (code * 7 + date_diff('day', DATE '1995-01-01', date)) % 211 = 0)"


def split_actions(d: Data):
    day = F.datediff("date", F.lit("1995-01-01"))
    return d.bars.where((F.col("code") * 7 + day) % 211 == 0).select("code", "date", F.when((F.col("code") + day) % 3 == 0, 2.0).otherwise(0.5).alias("ratio"))


@query("k18_action_adjustment", "code date", "close volume factor",
       ACTIONS + ", f AS (SELECT b.code, b.date, b.close, b.volume, coalesce((SELECT exp(sum(ln(ratio))) FROM ac WHERE ac.code = b.code AND ac.date > b.date), 1) AS factor FROM bars b) ;; SELECT code, date, close / factor AS close, volume * factor AS volume, factor FROM f")
def k18(d: Data):
    return actions.adjusted(d.bars, split_actions(d))


@query("k19_action_flags", "code date corporate_action", "adjustment_factor", ACTIONS + " ;; SELECT b.code, b.date, CAST(ratio IS NOT NULL AS INT) AS corporate_action, coalesce(ratio, 1.0) AS adjustment_factor FROM bars b LEFT JOIN ac ON ac.code = b.code AND ac.date = b.date")
def k19(d: Data):
    return d.bars.join(split_actions(d), ["code", "date"], "left").withColumns({"corporate_action": F.col("ratio").isNotNull().cast("int"), "adjustment_factor": F.coalesce("ratio", F.lit(1.0))})


@query("k20_listing_diff", "date code change", "",
       "p AS (SELECT b.code, b.date, c.idx, c.next_date FROM bars b JOIN calendar c ON b.date = c.date), n AS (SELECT code, next_date AS date FROM p WHERE next_date IS NOT NULL) ;; SELECT date, code, 'new' AS change FROM p ANTI JOIN n USING (code, date) WHERE idx > 1 UNION ALL SELECT date, code, 'removed' FROM n ANTI JOIN bars USING (code, date)", "bars calendar")
def k20(d: Data):
    p = d.bars.select("code", "date").join(d.calendar, "date")
    before = p.where("next_date is not null").select("code", F.col("next_date").alias("date"))
    keys = ["code", "date"]
    new = p.where("idx > 1").join(before, keys, "left_anti").select(*keys, F.lit("new").alias("change"))
    return new.unionByName(before.join(d.bars.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed")))


@query("k21_membership", "code market effective until", "",
       "e AS (SELECT code, published AS effective, min(rec) AS rec FROM snapshots GROUP BY ALL), f AS (SELECT code, effective, CASE WHEN rec % 9 = 0 THEN 'delist' ELSE CAST(rec % 4 AS VARCHAR) END AS market FROM e), g AS (SELECT *, lead(effective) OVER (PARTITION BY code ORDER BY effective) - 1 AS until FROM f) ;; SELECT code, market, effective, until FROM g WHERE market <> 'delist'", "snapshots")
def k21(d: Data):
    e = d.snapshots.groupBy("code", F.col("published").alias("effective")).agg(F.min("rec").alias("rec"))
    f = e.withColumn("market", F.when(F.col("rec") % 9 == 0, "delist").otherwise((F.col("rec") % 4).cast("string")))
    return f.withColumn("until", F.date_sub(F.lead("effective").over(Window.partitionBy("code").orderBy("effective")), 1)).where("market <> 'delist'")


@query("k22_section_mapping", "code section valid_from valid_to", "",
       """e AS (SELECT code, published AS valid_from, arg_min(CASE WHEN published < DATE '1998-04-04' THEN 'old' ELSE 'new' END || (rec % 3), rec) AS section FROM snapshots GROUP BY ALL), g AS (SELECT *, lag(section) OVER w AS p FROM e WINDOW w AS (PARTITION BY code ORDER BY valid_from)), h AS (SELECT * FROM g WHERE p IS NULL OR p <> section) ;;
SELECT code, section, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) - 1, DATE '2999-12-31') AS valid_to FROM h""", "snapshots")  # fmt: skip
def k22(d: Data):
    name = F.concat(F.when(F.col("published") < F.lit("1998-04-04").cast("date"), "old").otherwise("new"), (F.col("rec") % 3).cast("string"))
    e = d.snapshots.groupBy("code", F.col("published").alias("valid_from")).agg(F.min_by(name, "rec").alias("section"))
    w = Window.partitionBy("code").orderBy("valid_from")
    h = e.withColumn("p", F.lag("section").over(w)).where("p is null or p <> section")
    return h.withColumn("valid_to", F.coalesce(F.date_sub(F.lead("valid_from").over(w), 1), F.lit("2999-12-31").cast("date")))


@query("k23_interval_coalescing", "code start stop merged", "",
       """r AS (SELECT code, published AS a, published + 15 + CAST(rec % 20 AS INT) AS b, rec FROM snapshots), m AS (SELECT *, max(b) OVER (PARTITION BY code ORDER BY a, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY a, rec ROWS UNBOUNDED PRECEDING) AS island FROM m) ;; SELECT code, min(a) AS start, max(b) AS stop, count(*) AS merged FROM g GROUP BY code, island""", "snapshots")  # fmt: skip
def k23(d: Data):
    r = d.snapshots.select("code", F.col("published").alias("a"), F.date_add("published", (15 + F.col("rec") % 20).cast("int")).alias("b"), "rec")
    w = Window.partitionBy("code").orderBy("a", "rec")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = r.withColumn("new", F.when(reach.isNull() | (F.col("a") > F.date_add(reach, 1)), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("code", "island").agg(F.min("a").alias("start"), F.max("b").alias("stop"), F.count(F.lit(1)).alias("merged"))


@query("k24_cleaning", "code date", "x",
       f"""g AS (SELECT code, date, CASE WHEN (code + day(date)) % 3 <> 0 THEN close END AS v FROM bars), f AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER {over('all', 0)}, first_value(v IGNORE NULLS) OVER {over(0, 'end')}) AS w FROM g),
q AS (SELECT quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM f) ;; SELECT code, date, CASE WHEN w IS NOT NULL THEN greatest(lo, least(hi, w)) END AS x FROM f, q""")  # fmt: skip
def k24(d: Data):
    g = d.bars.select("code", "date", F.when((F.col("code") + F.dayofmonth("date")) % 3 != 0, F.col("close")).alias("v"))
    before, after = F.last("v", ignorenulls=True).over(frame(Window.unboundedPreceding, 0)), F.first("v", ignorenulls=True).over(frame(0, Window.unboundedFollowing))
    f = g.select("code", "date", F.coalesce(before, after).alias("w"))
    q = select.quantiles(f, "w", [0.01, 0.99])  # one row
    return f.join(F.broadcast(q)).select("code", "date", F.when(F.col("w").isNotNull(), F.greatest(F.col("q")[0], F.least(F.col("q")[1], F.col("w")))).alias("x"))
