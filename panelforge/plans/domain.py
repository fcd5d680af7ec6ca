"""Domain blocks: published records made available, attached to the panel and windowed (D rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_sector, EPS, average_rank, clip, frame, lag, lead, lroll, normal_cdf, rank01, ratio, roll, zscore
from ..operators import calendar, recursive, select
from ..operators.asof import asof_join
from ..sources.tables import Data
from .crosssection import P, SECTOR, panel, sectors
from .indicators import with_moves
from .joins import SNAP, STATEMENTS, daily_snapshots, statements
from .registry import query
from .sql import average_rank as saverage_rank
from .sql import clip as sclip
from .sql import lag as slag
from .sql import lead as slead
from .sql import lroll as slroll
from .sql import over, rank01 as srank01
from .sql import roll as sroll
from .sql import smooth
from .sql import z as sz
from .windows import RETURNS, WITH_MARKET, _returns, numbered, with_market

R = RETURNS.replace(" ;;", "")
ATTACH = "att AS (SELECT b.*, s.rec, s.amount, s.status, s.date AS eff FROM bars b ASOF LEFT JOIN sn s ON b.code = s.code AND b.date >= s.date)"


def attached(d: Data):
    """Bars with the last record of their code and its date (eff)."""
    return asof_join(d.bars, daily_snapshots(d).withColumn("eff", F.col("date")), ["code"], "date", ["rec", "amount", "status", "eff"])


#: Accounts of a record: sales, profit, assets, equity, cash flow, shares (not in every record), and the end of the period.
ACCOUNTS = SNAP + ", ac AS (SELECT *, amount AS sales, amount * (rec % 7 - 2) / 20.0 AS profit, amount * (3 + rec % 3) AS assets, amount * (3 + rec % 3) * (6 + rec % 5) / 20.0 AS equity, amount * (rec % 7 - 1) / 25.0 AS cash, CASE WHEN rec % 4 <> 1 THEN 1000 + rec % 100 END AS shares, rec % 4 AS quarter, date - CAST(20 + rec % 40 AS INT) AS period_end FROM sn)"
SUMS = ("sales", "profit", "cash")


def accounts(d: Data):
    rec, amount = F.col("rec"), F.col("amount")
    assets = amount * (3 + rec % 3)
    return daily_snapshots(d).withColumns({
        "sales": amount, "profit": amount * (rec % 7 - 2) / 20.0, "assets": assets, "equity": assets * (6 + rec % 5) / 20.0, "cash": amount * (rec % 7 - 1) / 25.0,
        "shares": F.when(rec % 4 != 1, 1000 + rec % 100), "quarter": rec % 4, "period_end": F.date_sub("date", (20 + rec % 40).cast("int")),
    })


@query("d1_ttm", "code date obs valid lag_days shares", "sales_ttm profit_ttm cash_ttm equity_avg assets_avg margin roe roa accruals sales_yoy profit_yoy",
       ACCOUNTS + f""", t AS (SELECT *, count(*) OVER {over('all', 0)} AS obs, {', '.join(f"{slroll('sum', c, 4, 1)} AS {c}_ttm" for c in SUMS)}, {slroll('avg', 'equity', 2, 1)} AS equity_avg, {slroll('avg', 'assets', 2, 1)} AS assets_avg, last_value(shares IGNORE NULLS) OVER {over('all', 0)} AS held, {slag('sales', 4)} AS s4, {slag('profit', 4)} AS p4 FROM ac) ;;
SELECT code, date, obs, CAST(obs > 4 AS INT) AS valid, date - period_end AS lag_days, held AS shares, sales_ttm, profit_ttm, cash_ttm, equity_avg, assets_avg, profit_ttm / nullif(sales_ttm, 0) AS margin, profit_ttm / nullif(equity_avg, 0) AS roe, profit_ttm / nullif(assets_avg, 0) AS roa,
(profit_ttm - cash_ttm) / nullif(assets_avg, 0) AS accruals, (sales - s4) / (abs(s4) + 1e-12) AS sales_yoy, (profit - p4) / (abs(p4) + 1e-12) AS profit_yoy FROM t""", "snapshots")  # fmt: skip
def d1(d: Data):
    """What the four records before say: sums, averages of two, profitability, accruals; change against four records ago; shares carried forward."""
    upto = frame(Window.unboundedPreceding, 0)
    t = accounts(d).withColumns({f"{c}_ttm": lroll(F.sum, c, 4, 1) for c in SUMS} | {"equity_avg": lroll(F.avg, "equity", 2, 1), "assets_avg": lroll(F.avg, "assets", 2, 1), "obs": F.count(F.lit(1)).over(upto), "held": F.last("shares", ignorenulls=True).over(upto)})
    change = lambda c: (F.col(c) - lag(c, 4)) / (F.abs(lag(c, 4)) + EPS)
    return t.select(
        "code", "date", "obs", (F.col("obs") > 4).cast("int").alias("valid"), F.datediff("date", "period_end").alias("lag_days"), F.col("held").alias("shares"), *[f"{c}_ttm" for c in SUMS], "equity_avg", "assets_avg",
        ratio("profit_ttm", "sales_ttm").alias("margin"), ratio("profit_ttm", "equity_avg").alias("roe"), ratio("profit_ttm", "assets_avg").alias("roa"), ratio(F.col("profit_ttm") - F.col("cash_ttm"), "assets_avg").alias("accruals"),
        change("sales").alias("sales_yoy"), change("profit").alias("profit_yoy"),
    )


@query("d2_document_flags", "rec period is_fy is_urgent revised", "",
       "SELECT rec, CASE rec % 4 WHEN 0 THEN 'FY' ELSE (rec % 4) || 'Q' END AS period, CAST(rec % 4 = 0 AS INT) AS is_fy, CAST(contains(priority, 'URGENT') AS INT) AS is_urgent, CAST(status = 'P' AS INT) AS revised FROM snapshots", "snapshots")
def d2(d: Data):
    k = F.col("rec") % 4
    return d.snapshots.select("rec", F.when(k == 0, "FY").otherwise(F.concat(k.cast("string"), F.lit("Q"))).alias("period"), (k == 0).cast("int").alias("is_fy"), F.col("priority").contains("URGENT").cast("int").alias("is_urgent"), (F.col("status") == "P").cast("int").alias("revised"))


GAPS = SNAP + f", gp AS (SELECT *, date - {slag('date')} AS gap, {slead('date')} AS nxt FROM sn), md AS (SELECT code, median(gap) AS gap_median FROM gp WHERE gap BETWEEN 1 AND 550 GROUP BY code), att AS (SELECT b.code, b.date, g.date AS eff, g.nxt FROM bars b ASOF LEFT JOIN gp g ON b.code = g.code AND b.date >= g.date)"


def filings(d: Data):
    s = daily_snapshots(d).withColumns({"gap": F.datediff("date", lag("date")), "nxt": lead("date"), "eff": F.col("date")})
    medians = s.where("gap between 1 and 550").groupBy("code").agg(F.median("gap").alias("gap_median"))
    return asof_join(d.bars, s, ["code"], "date", ["eff", "nxt"]).join(medians, "code", "left")


@query("d3_attach_statements", "code date days_since days_to business_since near pre_window post_window overdue", "gap_median recency",
       GAPS + """, e AS (SELECT DISTINCT eff FROM att WHERE eff IS NOT NULL), ei AS (SELECT e.eff, coalesce(c.idx, 0) AS ei FROM e ASOF LEFT JOIN calendar c ON e.eff >= c.date) ;;
SELECT att.code, att.date, att.date - att.eff AS days_since, nxt - att.date AS days_to, calendar.idx - ei AS business_since, CAST(coalesce(att.date - att.eff <= 5, false) AS INT) AS near, CAST(coalesce(nxt - att.date BETWEEN 1 AND 3, false) AS INT) AS pre_window, CAST(coalesce(att.date - att.eff BETWEEN 0 AND 3, false) AS INT) AS post_window,
CAST(coalesce(att.date - att.eff > 1.5 * gap_median, false) AS INT) AS overdue, gap_median, exp(-(att.date - att.eff) / 30.0) AS recency FROM att JOIN calendar ON calendar.date = att.date LEFT JOIN ei ON ei.eff = att.eff LEFT JOIN md ON att.code = md.code""", "bars snapshots calendar")  # fmt: skip
def d3(d: Data):
    """Days and business days since the last record, windows around records, the usual gap of the code, and whether it is overrun."""
    f = filings(d)
    days = f.select(F.col("eff").alias("date")).where("date is not null").distinct()
    on = asof_join(days, d.calendar.select("date", "idx"), [], "date", ["idx"]).select(F.col("date").alias("eff"), F.coalesce("idx", F.lit(0)).alias("_then"))
    j = f.join(on, "eff", "left").join(d.calendar.select("date", "idx"), "date")
    since, to = F.datediff("date", "eff"), F.datediff("nxt", "date")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.withColumns({"days_since": since, "days_to": to, "business_since": F.col("idx") - F.col("_then"), "near": flag(since <= 5), "pre_window": flag(to.between(1, 3)), "post_window": flag(since.between(0, 3)), "overdue": flag(since > 1.5 * F.col("gap_median")), "recency": F.exp(-since / 30.0)})


@query("d4_forecast_progress", "code date raised cut changed", "progress profit_progress margin forecast_margin revision profit_revision",
       ACCOUNTS + f""", f AS (SELECT *, amount * 4 AS forecast, profit * 4 + amount / 10 AS profit_forecast FROM ac) ;;
SELECT code, date, ({sroll('sum', 'amount', 4, 1)}) / forecast AS progress, ({sroll('sum', 'profit', 4, 1)}) / nullif(profit_forecast, 0) AS profit_progress, profit / nullif(sales, 0) AS margin, profit_forecast / nullif(forecast, 0) AS forecast_margin, forecast / {slag('forecast')} - 1 AS revision,
(profit_forecast - {slag('profit_forecast')}) / (abs({slag('profit_forecast')}) + 1e-12) AS profit_revision, coalesce(forecast > {slag('forecast')}, false) AS raised, coalesce(forecast < {slag('forecast')}, false) AS cut, status = 'P' AS changed FROM f""", "snapshots")  # fmt: skip
def d4(d: Data):
    """Progress towards the forecasts of sales and profit, margins, and revisions."""
    f = accounts(d).withColumns({"forecast": F.col("amount") * 4, "profit_forecast": F.col("profit") * 4 + F.col("amount") / 10})
    flag = lambda c: F.coalesce(c, F.lit(False))
    before = lag("profit_forecast")
    return f.select(
        "code", "date", (roll(F.sum, "amount", 4, 1) / F.col("forecast")).alias("progress"), ratio(roll(F.sum, "profit", 4, 1), "profit_forecast").alias("profit_progress"), ratio("profit", "sales").alias("margin"), ratio("profit_forecast", "forecast").alias("forecast_margin"),
        (F.col("forecast") / lag("forecast") - 1).alias("revision"), ((F.col("profit_forecast") - before) / (F.abs(before) + EPS)).alias("profit_revision"),
        flag(F.col("forecast") > lag("forecast")).alias("raised"), flag(F.col("forecast") < lag("forecast")).alias("cut"), (F.col("status") == "P").alias("changed"),
    )


@query("d5_dividends", "code date special stale", "sum12 next_amount",
       SNAP + f", q AS (SELECT * FROM sn WHERE status <> 'P') ;; SELECT code, date, sum(amount) OVER (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS sum12, {slead('amount')} AS next_amount, amount > 2 * {slag('amount')} AS special, date - {slag('date')} AS stale FROM q", "snapshots")
def d5(d: Data):
    q = daily_snapshots(d).where("status <> 'P'")
    year = Window.partitionBy("code").orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-365, 0)
    return q.select("code", "date", F.sum("amount").over(year).alias("sum12"), lead("amount").alias("next_amount"), (F.col("amount") > 2 * lag("amount")).alias("special"), F.datediff("date", lag("date")).alias("stale"))


EX = SNAP + ", ex AS (SELECT code, date + 10 AS date, max(amount) / 100000 AS dps FROM sn GROUP BY ALL), j AS (SELECT b.*, ex.date AS ex_date, dps FROM bars b ASOF LEFT JOIN ex ON b.code = ex.code AND b.date <= ex.date)"


def ex_dates(d: Data):
    ex = daily_snapshots(d).groupBy("code", F.date_add("date", 10).alias("date")).agg((F.max("amount") / 100000).alias("dps"))
    return asof_join(d.bars, ex.withColumn("ex_date", F.col("date")), ["code"], "date", ["ex_date", "dps"], forward=True)


@query("d6_attach_dividends", "code date days_to_ex pre_window post_window", "yield expected_drop gap_miss cycle_z",
       EX + f""", l AS (SELECT j.*, x.date AS last_ex FROM j ASOF LEFT JOIN ex x ON j.code = x.code AND j.date >= x.date) ;;
SELECT code, date, ex_date - date AS days_to_ex, CAST(coalesce(ex_date - date <= 5, false) AS INT) AS pre_window, CAST(coalesce(date - last_ex BETWEEN 0 AND 5, false) AS INT) AS post_window, dps / close AS yield, CASE WHEN date = ex_date THEN dps / {slag('close')} END AS expected_drop, CASE WHEN date = ex_date THEN open / {slag('close')} - 1 + dps / {slag('close')} END AS gap_miss,
(dps / close - ({sroll('avg', 'dps / close', 60, 20)})) / (({sroll('stddev_samp', 'dps / close', 60, 20)}) + 1e-8) AS cycle_z FROM l""", "bars snapshots")  # fmt: skip
def d6(d: Data):
    j = ex_dates(d)
    ex = daily_snapshots(d).select("code", F.date_add("date", 10).alias("date")).distinct()
    j = asof_join(j, ex.withColumn("last_ex", F.col("date")), ["code"], "date", ["last_ex"])
    days, since = F.datediff("ex_date", "date"), F.datediff("date", "last_ex")
    on = F.col("date") == F.col("ex_date")
    drop = F.col("dps") / lag("close")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    j = j.withColumn("yield", F.col("dps") / F.col("close"))
    return j.withColumns({"days_to_ex": days, "pre_window": flag(days <= 5), "post_window": flag(since.between(0, 5)), "expected_drop": F.when(on, drop), "gap_miss": F.when(on, F.col("open") / lag("close") - 1 + drop), "cycle_z": zscore("yield", 60, 20)})


BREAK = "bd AS (SELECT code, date, sum(amount) FILTER (part % 2 = 0) AS buy, sum(amount) FILTER (part % 2 = 1) AS sell, sum(amount) FILTER (part % 10 = 3) AS short, sum(amount) AS total FROM trades GROUP BY code, date), bn AS (SELECT *, (coalesce(buy, 0) - coalesce(sell, 0)) / total AS net_ratio, coalesce(short, 0) / total AS short_share FROM bd)"


def breakdown(d: Data):
    """Trades of a day by side: even parts buy, odd ones sell, some of these short."""
    side = lambda c: F.sum(F.when(c, F.col("amount")))
    part = F.col("part")
    b = d.trades.groupBy("code", "date").agg(side(part % 2 == 0).alias("buy"), side(part % 2 == 1).alias("sell"), side(part % 10 == 3).alias("short"), F.sum("amount").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return b.withColumns({"net_ratio": (zero("buy") - zero("sell")) / F.col("total"), "short_share": zero("short") / F.col("total")})


@query("d7_breakdown", "code date turned peak trough", "buy_5 sell_5 short_5 net_ratio short_share activity z20 z260",
       BREAK + f""" ;; SELECT code, date, {', '.join(f"{sroll('sum', f'coalesce({c}, 0)', 5, 1)} AS {c}_5" for c in ('buy', 'sell', 'short'))}, net_ratio, short_share, total / nullif({slroll('avg', 'total', 20, 10)}, 0) AS activity, {sz('net_ratio', 20, 10, left=True)} AS z20, {sz('net_ratio', 260, 60, left=True)} AS z260, coalesce(sign(net_ratio) <> sign({slag('net_ratio')}), false) AS turned,
coalesce({slag('net_ratio')} > {slag('net_ratio', 2)} AND {slag('net_ratio')} > net_ratio, false) AS peak, coalesce({slag('net_ratio')} < {slag('net_ratio', 2)} AND {slag('net_ratio')} < net_ratio, false) AS trough FROM bn""", "trades")  # fmt: skip
def d7(d: Data):
    """Sums by side over five rows, net ratio and its deviations, and whether the row before was an extreme."""
    b, one, two = breakdown(d), lag("net_ratio"), lag("net_ratio", 2)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return b.withColumns({f"{c}_5": roll(F.sum, F.coalesce(c, F.lit(0.0)), 5, 1) for c in ("buy", "sell", "short")} | {
        "activity": ratio("total", lroll(F.avg, "total", 20, 10)), "z20": zscore("net_ratio", 20, 10, left=True), "z260": zscore("net_ratio", 260, 60, left=True), "turned": flag(F.signum("net_ratio") != F.signum(one)),
        "peak": flag((one > two) & (one > F.col("net_ratio"))), "trough": flag((one < two) & (one < F.col("net_ratio"))),
    })


@query("d8_earnings_proximity", "code date days_to w1 w3 w5 upcoming recent", "",
       SNAP + ", f AS (SELECT b.code, b.date, s.date AS nxt FROM bars b ASOF LEFT JOIN sn s ON b.code = s.code AND b.date <= s.date), p AS (SELECT f.*, s.date AS prv FROM f ASOF LEFT JOIN sn s ON f.code = s.code AND f.date >= s.date) ;; SELECT code, date, nxt - date AS days_to, coalesce(nxt - date <= 1 OR date - prv <= 1, false) AS w1, coalesce(nxt - date <= 3 OR date - prv <= 3, false) AS w3, coalesce(nxt - date <= 5 OR date - prv <= 5, false) AS w5, coalesce(nxt - date BETWEEN 1 AND 5, false) AS upcoming, coalesce(date - prv BETWEEN 1 AND 5, false) AS recent FROM p", "bars snapshots")
def d8(d: Data):
    s = daily_snapshots(d).select("code", "date", F.col("date").alias("nxt"), F.col("date").alias("prv"))
    p = asof_join(asof_join(d.bars.select("code", "date"), s, ["code"], "date", ["nxt"], forward=True), s, ["code"], "date", ["prv"])
    to, since = F.datediff("nxt", "date"), F.datediff("date", "prv")
    within = lambda c: F.coalesce(c, F.lit(False))
    any_of = lambda n: within(to <= n) | within(since <= n)
    return p.withColumns({"days_to": to, "w1": any_of(1), "w3": any_of(3), "w5": any_of(5), "upcoming": within(to.between(1, 5)), "recent": within(since.between(1, 5))})


@query("d9_event_index", "code date idx_since pre post", "",
       STATEMENTS + """, u AS (SELECT su.code, su.date, c.idx AS e FROM su JOIN calendar c ON c.date = su.date), b AS (SELECT bars.code, bars.date, c.idx FROM bars JOIN calendar c ON c.date = bars.date), p AS (SELECT b.*, u.e AS pe FROM b ASOF LEFT JOIN u ON b.code = u.code AND b.date >= u.date), n AS (SELECT p.*, u.e AS ne FROM p ASOF LEFT JOIN u ON p.code = u.code AND p.date < u.date) ;;
SELECT code, date, idx - pe AS idx_since, coalesce(ne - idx <= 3, false) AS pre, coalesce(idx - pe <= 3, false) AS post FROM n""", "bars snapshots calendar")  # fmt: skip
def d9(d: Data):
    idx = d.calendar.select("date", "idx")
    u = statements(d).select("code", "date").join(idx.withColumnRenamed("idx", "e"), "date").select("code", "date", F.col("e").alias("pe"), F.col("e").alias("ne"))
    b = d.bars.select("code", "date").join(idx, "date")
    n = asof_join(asof_join(b, u, ["code"], "date", ["pe"]), u, ["code"], "date", ["ne"], forward=True, strict=True)
    return n.select("code", "date", (F.col("idx") - F.col("pe")).alias("idx_since"), F.coalesce(F.col("ne") - F.col("idx") <= 3, F.lit(False)).alias("pre"), F.coalesce(F.col("idx") - F.col("pe") <= 3, F.lit(False)).alias("post"))


@query("d10_listed_snapshot", "code date rec", "",
       "l AS (SELECT code, CASE WHEN published > DATE '1998-01-01' THEN published::TIMESTAMP + INTERVAL 1050 MINUTE ELSE published::TIMESTAMP + INTERVAL 9 HOUR END AS ts, max(rec) AS rec FROM snapshots GROUP BY ALL) ;; SELECT b.code, b.date, l.rec FROM bars b ASOF LEFT JOIN l ON b.code = l.code AND b.date::TIMESTAMP + INTERVAL 15 HOUR >= l.ts", "bars snapshots")
def d10(d: Data):
    day = F.col("published").cast("timestamp")
    ts = F.when(F.col("published") > F.lit("1998-01-01").cast("date"), day + F.expr("interval 1050 minutes")).otherwise(day + F.expr("interval 9 hours"))
    l = d.snapshots.groupBy("code", ts.alias("ts")).agg(F.max("rec").alias("rec"))  # noqa: E741
    b = d.bars.withColumn("ts", F.col("date").cast("timestamp") + F.expr("interval 15 hours"))
    return asof_join(b, l, ["code"], "ts", ["rec"])


CAP = SNAP + ", " + ATTACH + f", cp AS (SELECT code, date, close, amount, close * amount AS cap, close * amount * 0.6 AS cap_free, amount / {slag('amount')} - 1 AS shock, date - {slag('date')} AS gap FROM att)"


@query("d11_market_cap", "code date buyback dilution", "cap cap_free shock",
       CAP + " ;; SELECT code, date, cap, cap_free, CASE WHEN gap <= 30 THEN shock END AS shock, coalesce(gap <= 30 AND shock < -0.01, false) AS buyback, coalesce(gap <= 30 AND shock > 0.01, false) AS dilution FROM cp", "bars snapshots")
def d11(d: Data):
    a = attached(d).withColumns({"cap": F.col("close") * F.col("amount"), "shock": F.col("amount") / lag("amount") - 1, "near": F.datediff("date", lag("date")) <= 30})
    yes = lambda c: F.coalesce(F.col("near") & c, F.lit(False))
    return a.withColumns({"cap_free": F.col("cap") * 0.6, "buyback": yes(F.col("shock") < -0.01), "dilution": yes(F.col("shock") > 0.01), "shock": F.when(F.col("near"), F.col("shock"))})


@query("d12_share_master", "code date eff", "shares", SNAP + ", " + ATTACH + " ;; SELECT code, date, eff, amount AS shares FROM att", "bars snapshots")
def d12(d: Data):
    return attached(d).withColumn("shares", F.col("amount"))


MARGIN = "mg AS (SELECT code, published AS date, sum(amount) FILTER (rec % 2 = 0) AS long_, sum(amount) FILTER (rec % 2 = 1) AS short_ FROM snapshots GROUP BY code, published), mc AS (SELECT code, date, coalesce(long_, 0) AS lg, coalesce(short_, 0) AS sh, coalesce(long_, 0) - coalesce(short_, 0) AS net FROM mg)"


def margin(d: Data):
    s = d.snapshots.groupBy("code", F.col("published").alias("date")).agg(*[F.coalesce(F.sum(F.when(F.col("rec") % 2 == k, F.col("amount"))), F.lit(0.0)).alias(n) for k, n in ((0, "lg"), (1, "sh"))])
    return s.withColumn("net", F.col("lg") - F.col("sh"))


@query("d13_margin_core", "code date spike", "net total lsr log_ratio imbalance diff total_diff z20",
       MARGIN + f", mz AS (SELECT *, {sz('net', 20, 5, left=True)} AS z20 FROM mc) ;; SELECT code, date, net, lg + sh AS total, lg / (sh + 1) AS lsr, ln((lg + 1) / (sh + 1)) AS log_ratio, net / (lg + sh + 1e-12) AS imbalance, net - {slag('net')} AS diff, lg + sh - {slag('lg + sh')} AS total_diff, z20, coalesce(abs(z20) > 2, false) AS spike FROM mz", "snapshots")
def d13(d: Data):
    m = margin(d).withColumn("z20", zscore("net", 20, 5, left=True)).withColumn("total", F.col("lg") + F.col("sh"))
    return m.withColumns({"lsr": F.col("lg") / (F.col("sh") + 1), "log_ratio": F.log((F.col("lg") + 1) / (F.col("sh") + 1)), "imbalance": F.col("net") / (F.col("total") + EPS), "diff": F.col("net") - lag("net"), "total_diff": F.col("total") - lag("total"), "spike": F.coalesce(F.abs("z20") > 2, F.lit(False))})


def attached_margin(d: Data, wait: int):
    """Margin balances on bars, from wait days after their date."""
    m = margin(d).withColumns({"eff": F.col("date"), "date": F.date_add("date", wait)})
    return asof_join(d.bars, m, ["code"], "date", ["lg", "sh", "net", "eff"])


def amargin(wait: int) -> str:
    return MARGIN + f", mw AS (SELECT code, date + {wait} AS date, date AS eff, lg, sh, net FROM mc), am AS (SELECT b.*, w.eff, w.lg, w.sh, w.net FROM bars b ASOF LEFT JOIN mw w ON b.code = w.code AND b.date >= w.date)"


@query("d14_margin_attach", "code date staleness obs reason", "long_value short_value net_value net_adv net_adv60 delta delta_5 z20",
       amargin(1) + f""", rs AS (SELECT code, published + 1 AS date, max(priority) AS reason FROM snapshots GROUP BY code, published), ar AS (SELECT am.*, r.reason FROM am LEFT JOIN rs r ON r.code = am.code AND r.date = am.eff + 1) ;;
SELECT code, date, date - eff AS staleness, count(net) OVER {over('all', 0)} AS obs, coalesce(reason, 'none') AS reason, lg * close AS long_value, sh * close AS short_value, net * close AS net_value, net / nullif({slroll('avg', 'turnover', 20, 5)}, 0) AS net_adv, net / nullif({slroll('avg', 'turnover', 60, 20)}, 0) AS net_adv60, net - {slag('net')} AS delta, net - {slag('net', 5)} AS delta_5, {sz('net', 20, 10, '1.0')} AS z20 FROM ar""", "bars snapshots")  # fmt: skip
def d14(d: Data):
    """Balances in money and in days of turnover, changes, and the reason code of the record that they come from."""
    reasons = d.snapshots.groupBy("code", F.col("published").alias("eff")).agg(F.max("priority").alias("reason"))
    a = attached_margin(d, 1).join(reasons, ["code", "eff"], "left")
    return a.select(
        "code", "date", F.datediff("date", "eff").alias("staleness"), F.count("net").over(frame(Window.unboundedPreceding, 0)).alias("obs"), F.coalesce("reason", F.lit("none")).alias("reason"),
        *[(F.col(c) * F.col("close")).alias(n) for c, n in (("lg", "long_value"), ("sh", "short_value"), ("net", "net_value"))],
        ratio("net", lroll(F.avg, "turnover", 20, 5)).alias("net_adv"), ratio("net", lroll(F.avg, "turnover", 60, 20)).alias("net_adv60"), (F.col("net") - lag("net")).alias("delta"), (F.col("net") - lag("net", 5)).alias("delta_5"), zscore("net", 20, 10, 1.0).alias("z20"),
    )


@query("d15_margin_legacy", "code date impulse days_since urgent", "z26 z52",
       MARGIN + f", mz AS (SELECT code, date, {sz('net', 26, 5)} AS z26, {sz('net', 52, 5)} AS z52 FROM mc), ur AS (SELECT code, published AS date, max(CAST(priority = '1-URGENT' AS INT)) AS urgent FROM snapshots GROUP BY ALL), j AS (SELECT b.code, b.date, m.date AS eff, z26, z52 FROM bars b ASOF LEFT JOIN mz m ON b.code = m.code AND b.date > m.date) ;; SELECT j.code, j.date, CAST(coalesce(j.date - eff <= 1, false) AS INT) AS impulse, j.date - eff AS days_since, coalesce(urgent, 0) AS urgent, z26, z52 FROM j LEFT JOIN ur ON ur.code = j.code AND ur.date = j.eff", "bars snapshots")
def d15(d: Data):
    m = margin(d).withColumns({"z26": zscore("net", 26, 5), "z52": zscore("net", 52, 5), "eff": F.col("date")})
    reasons = F.element_at(F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(0)), F.col("priority"))
    urgent = d.snapshots.groupBy("code", F.col("published").alias("eff")).agg(F.max(F.coalesce(F.when(F.col("priority") == "1-URGENT", 1), F.lit(0))).alias("urgent"))
    j = asof_join(d.bars, m, ["code"], "date", ["z26", "z52", "eff"], strict=True).join(urgent, ["code", "eff"], "left")
    since = F.datediff("date", "eff")
    return j.withColumns({"impulse": F.coalesce(since <= 1, F.lit(False)).cast("int"), "days_since": since, "urgent": F.coalesce("urgent", F.lit(0))})


WEEKLY = "wk AS (SELECT code, date_trunc('week', published)::DATE + 6 AS date, sum(amount) FILTER (rec % 2 = 0) AS lg, sum(amount) FILTER (rec % 2 = 1) AS sh FROM snapshots GROUP BY ALL)"


@query("d16_weekly_margin", "code date staleness", "net lsr long_share net_adv week_diff z20 z52",
       WEEKLY + f", wn AS (SELECT code, date, coalesce(lg, 0) - coalesce(sh, 0) AS net, coalesce(lg, 0) / (coalesce(sh, 0) + 1) AS lsr, coalesce(lg, 0) / (coalesce(lg, 0) + coalesce(sh, 0)) AS long_share FROM wk), a AS (SELECT b.code, b.date, b.turnover, w.date AS eff, net, lsr, long_share FROM bars b ASOF LEFT JOIN wn w ON b.code = w.code AND b.date >= w.date) ;; SELECT code, date, date - eff AS staleness, net, lsr, long_share, net / nullif({slroll('avg', 'turnover', 20, 5)}, 0) AS net_adv, {slag('net', 1)} - {slag('net', 6)} AS week_diff, {sz('net', 20, 10, '1.0')} AS z20, {sz('net', 52, 20, '1.0')} AS z52 FROM a", "bars snapshots")
def d16(d: Data):
    week = F.date_add(F.to_date(F.date_trunc("week", "published")), 6)
    s = d.snapshots.groupBy("code", week.alias("date")).agg(*[F.coalesce(F.sum(F.when(F.col("rec") % 2 == k, F.col("amount"))), F.lit(0.0)).alias(n) for k, n in ((0, "lg"), (1, "sh"))])
    s = s.withColumns({"net": F.col("lg") - F.col("sh"), "lsr": F.col("lg") / (F.col("sh") + 1), "long_share": F.col("lg") / (F.col("lg") + F.col("sh")), "eff": F.col("date")})
    a = asof_join(d.bars, s, ["code"], "date", ["net", "lsr", "long_share", "eff"])
    return a.withColumns({"staleness": F.datediff("date", "eff"), "net_adv": ratio("net", lroll(F.avg, "turnover", 20, 5)), "week_diff": lag("net", 1) - lag("net", 6), "z20": zscore("net", 20, 10, 1.0), "z52": zscore("net", 52, 20, 1.0)})


SHORTS = "sm AS (SELECT date, sum(amount) FILTER (part % 10 = 3) / sum(amount) AS ratio FROM trades GROUP BY date), sr AS (SELECT date, coalesce(ratio, 0) AS ratio FROM sm)"


SECTOR_SHORTS = f"ss AS (SELECT date, sector, coalesce(sum(amount) FILTER (part % 10 = 3), 0) / sum(amount) AS sector_ratio FROM trades JOIN dim USING (code) GROUP BY date, sector), sz AS (SELECT *, sector_ratio - {slag('sector_ratio', by='sector')} AS sector_diff, (sector_ratio - ({sroll('avg', 'sector_ratio', 20, 10, by='sector')})) / (({sroll('stddev_samp', 'sector_ratio', 20, 10, by='sector')}) + 1e-8) AS sector_z FROM ss)"


@query("d17_short_market", "code date extreme switched staleness", "ratio diff z20 sector_ratio sector_diff sector_z",
       SHORTS + ", " + SECTOR_SHORTS + """, z AS (SELECT *, ratio - lag(ratio) OVER w AS diff, CASE WHEN count(*) OVER o >= 10 THEN (ratio - avg(ratio) OVER o) / (stddev_samp(ratio) OVER o + 1e-8) END AS z20 FROM sr WINDOW w AS (ORDER BY date), o AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), y AS (SELECT *, coalesce(sign(z20) <> sign(lag(z20) OVER (ORDER BY date)), false) AS switched FROM z),
m AS (SELECT p.code, p.date, p.sector, y.date AS eff, ratio, diff, z20, switched FROM panel p ASOF LEFT JOIN y ON p.date > y.date) ;;
SELECT m.code, m.date, coalesce(abs(z20) > 2, false) AS extreme, coalesce(switched, false) AS switched, m.date - eff AS staleness, ratio, diff, z20, sector_ratio, sector_diff, sector_z FROM m ASOF LEFT JOIN sz ON m.sector = sz.sector AND m.date > sz.date""", "trades panel")  # fmt: skip
def d17(d: Data):
    """Short ratios of the market and of the sector as known from the day before, with extremes and switches of sign."""
    part = F.sum(F.when(F.col("part") % 10 == 3, F.col("amount")))
    s = d.trades.groupBy("date").agg(F.coalesce(part / F.sum("amount"), F.lit(0.0)).alias("ratio"))
    w = Window.orderBy("date")  # one row for each date
    z = (F.col("ratio") - roll(F.avg, "ratio", 20, 10, w)) / (roll(F.stddev_samp, "ratio", 20, 10, w) + 1e-8)
    s = s.withColumns({"diff": F.col("ratio") - F.lag("ratio").over(w), "z20": z})
    s = s.withColumns({"switched": F.coalesce(F.signum("z20") != F.signum(F.lag("z20").over(w)), F.lit(False)), "eff": F.col("date")})
    own = Window.partitionBy("sector").orderBy("date")
    g = d.trades.join(d.dim.select("code", "sector"), "code").groupBy("date", "sector").agg((F.coalesce(part, F.lit(0.0)) / F.sum("amount")).alias("sector_ratio"))
    g = g.withColumns({"sector_diff": F.col("sector_ratio") - lag("sector_ratio", 1, own), "sector_z": (F.col("sector_ratio") - roll(F.avg, "sector_ratio", 20, 10, own)) / (roll(F.stddev_samp, "sector_ratio", 20, 10, own) + 1e-8)})
    columns = ["ratio", "diff", "z20", "switched", "eff"]
    days = asof_join(d.calendar.select("date"), s, [], "date", columns, strict=True)  # one row for each date
    j = asof_join(d.panel.select("code", "date", "sector").join(days, "date", "left"), g, ["sector"], "date", ["sector_ratio", "sector_diff", "sector_z"], strict=True)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({"extreme": flag(F.abs("z20") > 2), "switched": flag(F.col("switched")), "staleness": F.datediff("date", "eff")})


@query("d18_short_by_code", "code date high low", "short_share mean5 mean20 std20 z short_adv",
       BREAK + f", q AS (SELECT *, {sroll('quantile_cont({}, 0.95)', 'short_share', 60, 20)} AS hi, {sroll('quantile_cont({}, 0.05)', 'short_share', 60, 20)} AS lo FROM bn) ;; SELECT code, date, short_share, {sroll('avg', 'short_share', 5, 2)} AS mean5, {sroll('avg', 'short_share', 20, 5)} AS mean20, {sroll('stddev_samp', 'short_share', 20, 5)} AS std20, {sz('short_share', 20, 5)} AS z, coalesce(short, 0) / nullif({sroll('avg', 'total', 20, 5)}, 0) AS short_adv, coalesce(short_share >= hi AND hi > lo, false) AS high, coalesce(short_share <= lo AND hi > lo, false) AS low FROM q", "trades")
def d18(d: Data):
    """Share of short sales with its means, deviations and extremes, and its size in days of turnover."""
    edge = lambda q: roll(lambda x: F.percentile(x, q), "short_share", 60, 20)
    b = breakdown(d).withColumns({"hi": edge(0.95), "lo": edge(0.05)})
    spread = F.col("hi") > F.col("lo")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return b.withColumns({
        "mean5": roll(F.avg, "short_share", 5, 2), "mean20": roll(F.avg, "short_share", 20, 5), "std20": roll(F.stddev_samp, "short_share", 20, 5), "z": zscore("short_share", 20, 5),
        "short_adv": ratio(F.coalesce("short", F.lit(0.0)), roll(F.avg, "total", 20, 5)), "high": flag((F.col("short_share") >= F.col("hi")) & spread), "low": flag((F.col("short_share") <= F.col("lo")) & spread),
    })


@query("d19_short_by_sector", "date sector pressure squeeze", "share restricted diff mom z market_share relative breadth",
       f"""t AS (SELECT trades.*, sector FROM trades JOIN dim USING (code)), s AS (SELECT date, sector, coalesce(sum(amount) FILTER (part % 10 = 3), 0) AS short, coalesce(sum(amount) FILTER (part % 20 = 3), 0) AS tied, sum(amount) AS total FROM t GROUP BY ALL), q AS (SELECT *, short / total AS share, tied / nullif(short, 0) AS restricted, short / nullif(sum(short) OVER (PARTITION BY date), 0) AS market_share, short / total - sum(short) OVER (PARTITION BY date) / sum(total) OVER (PARTITION BY date) AS relative FROM s), c AS (SELECT date, quantile_cont(share, 0.8) AS cut FROM q GROUP BY date),
r AS (SELECT q.*, cut, share - lag(share) OVER (PARTITION BY sector ORDER BY q.date) AS diff, {sroll('avg', 'share', 5, 2, by='sector', order='q.date')} AS mom, (share - ({sroll('avg', 'share', 20, 10, by='sector', order='q.date')})) / (({sroll('stddev_samp', 'share', 20, 10, by='sector', order='q.date')}) + 1e-8) AS z FROM q JOIN c ON q.date = c.date) ;;
SELECT date, sector, coalesce(z > 1 AND diff > 0, false) AS pressure, coalesce(z > 1 AND diff < 0, false) AS squeeze, share, restricted, diff, mom, z, market_share, relative, avg(CASE WHEN share > cut THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY date) AS breadth FROM r""", "trades dim")  # fmt: skip
def d19(d: Data):
    """Short share of each sector, the restricted part of it, its momentum and deviations, its place in the market, and flags of pressure and squeeze."""
    t = d.trades.join(d.dim.select("code", "sector"), "code")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0))
    s = t.groupBy("date", "sector").agg(part(F.col("part") % 10 == 3).alias("short"), part(F.col("part") % 20 == 3).alias("tied"), F.sum("amount").alias("total"))
    by_date, own = Window.partitionBy("date"), Window.partitionBy("sector").orderBy("date")
    share = F.col("short") / F.col("total")
    q = s.withColumns({"share": share, "restricted": ratio("tied", "short"), "market_share": ratio("short", F.sum("short").over(by_date)), "relative": share - F.sum("short").over(by_date) / F.sum("total").over(by_date)})
    cuts = q.groupBy("date").agg(F.percentile("share", 0.8).alias("cut"))
    r = q.join(cuts, "date").withColumns({"diff": F.col("share") - lag("share", 1, own), "mom": roll(F.avg, "share", 5, 2, own), "z": (F.col("share") - roll(F.avg, "share", 20, 10, own)) / (roll(F.stddev_samp, "share", 20, 10, own) + 1e-8)})
    flag = lambda c: F.coalesce(c, F.lit(False))
    return r.withColumns({"pressure": flag((F.col("z") > 1) & (F.col("diff") > 0)), "squeeze": flag((F.col("z") > 1) & (F.col("diff") < 0)), "breadth": F.avg(F.when(F.col("share") > F.col("cut"), 1.0).otherwise(0.0)).over(by_date)})


@query("d20_short_positions", "code date reporters new staleness valid", "total top hhi delta mean10 z20",
       f"""p AS (SELECT code, published AS date, count(*) AS reporters, sum(amount) AS total, max(amount) AS top, sum(amount * amount) / (sum(amount) * sum(amount)) AS hhi FROM snapshots GROUP BY ALL), q AS (SELECT *, total - {slag('total')} AS delta, {slag('total')} IS NULL AS new FROM p), a AS (SELECT b.code, b.date, q.date AS eff, reporters, new, total, top, hhi, delta FROM bars b ASOF LEFT JOIN q ON b.code = q.code AND b.date > q.date) ;;
SELECT code, date, reporters, new, date - eff AS staleness, CAST(coalesce(date - eff <= 60, false) AS INT) AS valid, total, top, hhi, delta, {sroll('avg', 'total', 10, 3)} AS mean10, {sz('total', 20, 10, '1.0')} AS z20 FROM a""", "bars snapshots")  # fmt: skip
def d20(d: Data):
    """Positions reported on a day, known from the next day on, with their age, means and deviations along the bars."""
    p = d.snapshots.groupBy("code", F.col("published").alias("date")).agg(F.count(F.lit(1)).alias("reporters"), F.sum("amount").alias("total"), F.max("amount").alias("top"), (F.sum(F.col("amount") * F.col("amount")) / (F.sum("amount") * F.sum("amount"))).alias("hhi"))
    p = p.withColumns({"delta": F.col("total") - lag("total"), "new": lag("total").isNull(), "eff": F.col("date")})
    a = asof_join(d.bars.select("code", "date"), p, ["code"], "date", ["reporters", "new", "total", "top", "hhi", "delta", "eff"], strict=True)
    age = F.datediff("date", "eff")
    return a.withColumns({"staleness": age, "valid": F.coalesce(age <= 60, F.lit(False)).cast("int"), "mean10": roll(F.avg, "total", 10, 3), "z20": zscore("total", 20, 10, 1.0)})


@query("d21_float_crowding", "code date", "float_turnover crowding roc5 mean_known",
       amargin(1) + f", f AS (SELECT code, date, turnover / (lg + sh + 1) AS float_turnover, lg / nullif({sroll('avg', 'turnover', 20, 5)}, 0) AS crowding FROM am) ;; SELECT code, date, float_turnover, crowding, crowding / nullif({slag('crowding', 5)}, 0) - 1 AS roc5, (coalesce(float_turnover, 0) + coalesce(crowding, 0)) / nullif((float_turnover IS NOT NULL)::INT + (crowding IS NOT NULL)::INT, 0) AS mean_known FROM f", "bars snapshots")
def d21(d: Data):
    f = attached_margin(d, 1).select("code", "date", (F.col("turnover") / (F.col("lg") + F.col("sh") + 1)).alias("float_turnover"), ratio("lg", roll(F.avg, "turnover", 20, 5)).alias("crowding"))
    parts = ("float_turnover", "crowding")
    known = sum(F.col(c).isNotNull().cast("int") for c in parts)
    return f.withColumns({"roc5": ratio("crowding", lag("crowding", 5)) - 1, "mean_known": F.try_divide(sum(F.coalesce(F.col(c), F.lit(0.0)) for c in parts), known)})


@query("d22_squeeze_risk", "code date", "pain squeeze pre_flow impact",
       amargin(1) + f""", nx AS (SELECT DISTINCT code, published AS date FROM snapshots), f AS (SELECT am.*, x.date AS nxt, am.close / nullif({sroll('avg', 'close', 20, 5, by='am.code', order='am.date')}, 0) - 1 AS mom, sh / (lg + 1) AS sr, abs(am.close / lag(am.close) OVER (PARTITION BY am.code ORDER BY am.date) - 1) / nullif(turnover, 0) AS illiq FROM am ASOF LEFT JOIN nx x ON am.code = x.code AND am.date < x.date) ;;
SELECT code, date, coalesce(-mom * lg / nullif(turnover, 0), 0) AS pain, coalesce({sz('sr', 20, 5, '0.01', left=True)}, 0) + coalesce({sz('mom', 20, 5, left=True)}, 0) AS squeeze, CASE WHEN nxt - date <= 10 THEN coalesce(net / nullif({slroll('avg', 'turnover', 20, 5)}, 0), 0) ELSE 0 END AS pre_flow,
(coalesce({sz('illiq', 20, 5, '1e-8', left=True)}, 0) + coalesce(net / nullif({slroll('avg', 'turnover', 20, 5)}, 0), 0)) / 2 AS impact FROM f""", "bars snapshots")  # fmt: skip
def d22(d: Data):
    """Pain of long holders, squeeze of short ones, balances ahead of a record within ten days, and their size against illiquidity."""
    a = asof_join(attached_margin(d, 1), daily_snapshots(d).select("code", "date", F.col("date").alias("nxt")), ["code"], "date", ["nxt"], forward=True, strict=True)
    f = a.withColumns({"mom": ratio("close", roll(F.avg, "close", 20, 5)) - 1, "sr": F.col("sh") / (F.col("lg") + 1), "illiq": ratio(F.abs(F.col("close") / lag("close") - 1), "turnover")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    size = zero(ratio("net", lroll(F.avg, "turnover", 20, 5)))
    return f.select(
        "code", "date", zero(ratio(-F.col("mom") * F.col("lg"), "turnover")).alias("pain"), (zero(zscore("sr", 20, 5, 0.01, left=True)) + zero(zscore("mom", 20, 5, left=True))).alias("squeeze"),
        F.when(F.datediff("nxt", "date") <= 10, size).otherwise(0.0).alias("pre_flow"), ((zero(zscore("illiq", 20, 5, 1e-8, left=True)) + size) / 2).alias("impact"),
    )


@query("d23_squeeze_score", "code date", "score cover_days",
       amargin(1) + f", f AS (SELECT code, date, sh / nullif({sroll('avg', 'turnover', 20, 5)}, 0) AS cover_days, sh / (lg + 1) AS b, close / {slag('close', 5)} - 1 AS c FROM am), r AS (SELECT code, date, cover_days, {srank01('cover_days', 'code')} AS r1, {srank01('b', 'code')} AS r2, {srank01('c', 'code')} AS r3 FROM f) ;; SELECT code, date, 0.4 * r1 + 0.4 * r2 + 0.2 * r3 AS score, cover_days FROM r", "bars snapshots")
def d23(d: Data):
    f = attached_margin(d, 1).select("code", "date", ratio("sh", roll(F.avg, "turnover", 20, 5)).alias("cover_days"), (F.col("sh") / (F.col("lg") + 1)).alias("b"), (F.col("close") / lag("close", 5) - 1).alias("c"))
    return f.withColumn("score", 0.4 * rank01("cover_days", "code") + 0.4 * rank01("b", "code") + 0.2 * rank01("c", "code"))


@query("d24_margin_stress", "code date", "velocity momentum stress cap_share",
       MARGIN + f", ca AS (SELECT code, date, close * volume AS cap FROM bars), v AS (SELECT mc.code, mc.date, net, cap, net - lag(net) OVER w AS velocity, net - lag(net, 4) OVER w AS momentum FROM mc ASOF LEFT JOIN ca ON mc.code = ca.code AND mc.date >= ca.date WINDOW w AS (PARTITION BY mc.code ORDER BY mc.date))"
       + f" ;; SELECT code, date, velocity, momentum, ({srank01('velocity', 'date')} + {srank01('momentum', 'date')}) / 2 AS stress, net / nullif(cap, 0) AS cap_share FROM v", "snapshots bars")
def d24(d: Data):
    """Changes of the margin balance, their ranks of the date, and the balance against the value traded (the stand-in of the market value)."""
    caps = d.bars.select("code", "date", (F.col("close") * F.col("volume")).alias("cap"))
    v = asof_join(margin(d), caps, ["code"], "date", ["cap"]).withColumns({"velocity": F.col("net") - lag("net"), "momentum": F.col("net") - lag("net", 4), "cap_share": ratio("net", "cap")})
    return v.withColumn("stress", (rank01("velocity", "date") + rank01("momentum", "date")) / 2)


#: Investors whose flows lead, and those whose flows lag.
SMART, CROWD = "1-URGENT", "5-LOW"

FLOW = "fl AS (SELECT published AS date, priority AS who, sum(CASE WHEN rec % 2 = 0 THEN amount ELSE -amount END) AS net, sum(amount) AS gross FROM snapshots GROUP BY ALL), fd AS (SELECT date, sum(net) AS net, sum(gross) AS gross, sum(gross * gross) / (sum(gross) * sum(gross)) AS hhi, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS breadth FROM fl GROUP BY date)"


def flows(d: Data, *keys):
    sign = F.when(F.col("rec") % 2 == 0, 1.0).otherwise(-1.0)
    who = d.snapshots.groupBy(F.col("published").alias("date"), *keys, F.col("priority").alias("who")).agg(F.sum(sign * F.col("amount")).alias("net"), F.sum("amount").alias("gross"))
    names = [k if isinstance(k, str) else "section" for k in keys]
    return who.groupBy("date", *names).agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"), (F.sum(F.col("gross") * F.col("gross")) / (F.sum("gross") * F.sum("gross"))).alias("hhi"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("breadth"),
                                        *[(F.coalesce(F.sum(F.when(F.col("who") == k, F.col("net"))), F.lit(0.0)) / F.sum("gross")).alias(n) for k, n in ((SMART, "smart"), (CROWD, "crowd"))])


FLOW2 = FLOW + f", fs AS (SELECT date, coalesce(sum(net) FILTER (who = '{SMART}'), 0) / sum(gross) AS smart, coalesce(sum(net) FILTER (who = '{CROWD}'), 0) / sum(gross) AS crowd FROM fl GROUP BY date)"


@query("d25_investor_flow", "date", "net sentiment hhi persistence divergence smart_flow smart_mom",
       FLOW2 + """ ;; SELECT fd.date, net, net / gross AS sentiment, hhi, avg(sign(net)) OVER p AS persistence, smart - crowd AS divergence, smart AS smart_flow, avg(smart) OVER s - avg(smart) OVER l AS smart_mom
FROM fd JOIN fs ON fd.date = fs.date WINDOW p AS (ORDER BY fd.date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), s AS (ORDER BY fd.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), l AS (ORDER BY fd.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "snapshots")  # fmt: skip
def d25(d: Data):
    w = lambda n: Window.orderBy("date").rowsBetween(-n, 0)  # noqa: E731  one row for each date
    f = flows(d).withColumns({"sentiment": F.col("net") / F.col("gross"), "divergence": F.col("smart") - F.col("crowd"), "smart_flow": F.col("smart")})
    return f.withColumns({"persistence": F.avg(F.signum("net")).over(w(9)), "smart_mom": F.avg("smart").over(w(4)) - F.avg("smart").over(w(19))})


SFLOW = "sw AS (SELECT published AS date, code % 3 AS section, priority AS who, sum(CASE WHEN rec % 2 = 0 THEN amount ELSE -amount END) AS net, sum(amount) AS gross FROM snapshots GROUP BY ALL), sf2 AS (SELECT date, section, sum(net) AS net, sum(gross) AS gross, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS breadth, coalesce(sum(net) FILTER (who = '1-URGENT'), 0) / sum(gross) - coalesce(sum(net) FILTER (who = '5-LOW'), 0) / sum(gross) AS smart FROM sw GROUP BY ALL)"


def by_section():
    return Window.partitionBy("section").orderBy("date")


@query("d26_flow_by_section", "date section shock", "net_ratio breadth z52 activity smart smart_mom",
       SFLOW + f", z AS (SELECT date, section, net / gross AS net_ratio, breadth, (net - ({sroll('avg', 'net', 52, 10, by='section')})) / (({sroll('stddev_samp', 'net', 52, 10, by='section')}) + 1e-8) AS z52, gross / nullif({sroll('avg', 'gross', 52, 10, by='section')}, 0) AS activity, smart, smart - ({sroll('avg', 'smart', 4, 2, by='section')}) AS smart_mom FROM sf2) ;; SELECT *, coalesce(abs(z52) > 2, false) AS shock FROM z", "snapshots")
def d26(d: Data):
    f = flows(d, (F.col("code") % 3).alias("section"))
    z = (F.col("net") - roll(F.avg, "net", 52, 10, by_section())) / (roll(F.stddev_samp, "net", 52, 10, by_section()) + 1e-8)
    smart = F.col("smart") - F.col("crowd")
    f = f.withColumns({"net_ratio": F.col("net") / F.col("gross"), "z52": z, "activity": ratio("gross", roll(F.avg, "gross", 52, 10, by_section())), "smart": smart})
    return f.withColumns({"shock": F.coalesce(F.abs("z52") > 2, F.lit(False)), "smart_mom": F.col("smart") - roll(F.avg, "smart", 4, 2, by_section())})


#: Names of the sections that market codes belong to.
SECTIONS = {0: "prime", 1: "standard", 2: "growth"}


@query("d27_section_flow", "date section name turned staleness", "net_ratio wow z20 z65 z260",
       SFLOW + f" ;; SELECT date, section, CASE section {' '.join(f"WHEN {k} THEN '{v}'" for k, v in SECTIONS.items())} END AS name, net / gross AS net_ratio, net - {slag('net', 5, by='section')} AS wow, {', '.join(f"(net - ({slroll('avg', 'net', n, m, by='section')})) / (({slroll('stddev_samp', 'net', n, m, by='section')}) + 1e-8) AS z{n}" for n, m in ((20, 10), (65, 20), (260, 60)))}, coalesce(sign(net) <> sign({slag('net', by='section')}), false) AS turned, date - {slag('date', by='section')} AS staleness FROM sf2", "snapshots")
def d27(d: Data):
    f = flows(d, (F.col("code") % 3).alias("section"))
    z = lambda n, m: (F.col("net") - lroll(F.avg, "net", n, m, by_section())) / (lroll(F.stddev_samp, "net", n, m, by_section()) + 1e-8)
    name = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("section").cast("int")]
    return f.withColumns({"name": name, "net_ratio": F.col("net") / F.col("gross"), "wow": F.col("net") - lag("net", 5, by_section()), "z20": z(20, 10), "z65": z(65, 20), "z260": z(260, 60), "turned": F.coalesce(F.signum("net") != F.signum(lag("net", 1, by_section())), F.lit(False)), "staleness": F.datediff("date", lag("date", 1, by_section()))})


# Contracts: the records of a code and day by the fifth part that they belong to are contracts of different months.
CONTRACTS = "fc AS (SELECT code, date, part % 5 AS month, arg_max(price, seq) AS settle, arg_min(price, seq) AS first, sum(quantity) AS oi FROM trades GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY CASE WHEN month = 2 THEN 1 ELSE 0 END DESC, oi DESC, month) AS r FROM fc), nr AS (SELECT code, date, max(month) FILTER (r = 1) AS month, max(settle) FILTER (r = 1) AS near, max(first) FILTER (r = 1) AS near_open, max(oi) FILTER (r = 1) AS oi, max(settle) FILTER (r = 2) AS far FROM fr GROUP BY code, date)"


def contracts(d: Data):
    return d.trades.groupBy("code", "date", (F.col("part") % 5).alias("month")).agg(F.max_by("price", "seq").alias("settle"), F.min_by("price", "seq").alias("first"), F.sum("quantity").alias("oi"))


def chosen(d: Data):
    """The front and the next contract of each code and date: the central month first, then by open interest."""
    w = Window.partitionBy("code", "date").orderBy(F.when(F.col("month") == 2, 1).otherwise(0).desc(), F.desc("oi"), "month")
    r = contracts(d).withColumn("r", F.row_number().over(w))
    pick = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    return r.groupBy("code", "date").agg(pick("month", 1).alias("month"), pick("settle", 1).alias("near"), pick("first", 1).alias("near_open"), pick("oi", 1).alias("oi"), pick("settle", 2).alias("far"))


@query("d28_contract_selection", "code date month", "near oi far", CONTRACTS + " ;; SELECT code, date, month, near, oi, far FROM nr", "trades")
def d28(d: Data):
    return chosen(d)


@query("d29_futures_block", "code date days_to_roll roll_soon", "ret overnight intraday oi_change slope basis carry",
       CONTRACTS + f""", j AS (SELECT nr.*, close, date_diff('day', nr.date, last_day(nr.date)) AS left_ FROM nr JOIN bars b ON b.code = nr.code AND b.date = nr.date) ;; SELECT code, date, left_ AS days_to_roll, CAST(left_ <= 5 AS INT) AS roll_soon, near / {slag('near')} - 1 AS ret, near_open / {slag('near')} - 1 AS overnight, near / near_open - 1 AS intraday, oi - {slag('oi')} AS oi_change, far / near - 1 AS slope, near / close - 1 AS basis, (near / close - 1) * 365.0 / (left_ + 1) AS carry FROM j""", "trades bars")
def d29(d: Data):
    """Returns and term structure of the front contract, its basis against the close, and the days to the end of the month, when it rolls."""
    n = chosen(d).join(d.bars.select("code", "date", "close"), ["code", "date"]).withColumn("days_to_roll", F.datediff(F.last_day("date"), "date"))
    basis = F.col("near") / F.col("close") - 1
    return n.withColumns({
        "roll_soon": (F.col("days_to_roll") <= 5).cast("int"), "ret": F.col("near") / lag("near") - 1, "overnight": F.col("near_open") / lag("near") - 1, "intraday": F.col("near") / F.col("near_open") - 1,
        "oi_change": F.col("oi") - lag("oi"), "slope": F.col("far") / F.col("near") - 1, "basis": basis, "carry": basis * 365.0 / (F.col("days_to_roll") + 1),
    })


@query("d30_continuous_contract", "code date rolled quadrant", "log_link ret z252 oi_z252",
       CONTRACTS + f""", c AS (SELECT *, coalesce(month <> {slag('month')}, false) AS rolled, {slag('far')} AS pf, {slag('near')} AS pn, near > {slag('near')} AS pu, oi > {slag('oi')} AS ou FROM nr),
k AS (SELECT *, sum(CASE WHEN rolled AND pf IS NOT NULL THEN ln(pf / pn) ELSE 0 END) OVER {over('all', 0)} AS log_link FROM c), l AS (SELECT *, ln(near) - log_link AS level FROM k), m AS (SELECT *, level - {slag('level')} AS ret FROM l) ;;
SELECT code, date, rolled, CASE WHEN pu AND ou THEN 1 WHEN pu THEN 2 WHEN ou THEN 3 WHEN pu IS NULL THEN 0 ELSE 4 END AS quadrant, log_link, ret, {sz('ret', 252, 60)} AS z252, {sz('oi', 252, 60)} AS oi_z252 FROM m""", "trades")  # fmt: skip
def d30(d: Data):
    """The front contracts linked at their rolls: log returns of the linked series and their deviations."""
    c = chosen(d).withColumns({"rolled": F.coalesce(F.col("month") != lag("month"), F.lit(False)), "pf": lag("far"), "pn": lag("near"), "pu": F.col("near") > lag("near"), "ou": F.col("oi") > lag("oi")})
    step = F.when(F.col("rolled") & F.col("pf").isNotNull(), F.log(F.col("pf") / F.col("pn"))).otherwise(0.0)
    quadrant = F.when(F.col("pu") & F.col("ou"), 1).when(F.col("pu"), 2).when(F.col("ou"), 3).when(F.col("pu").isNull(), 0).otherwise(4)
    k = c.withColumns({"quadrant": quadrant, "log_link": F.sum(step).over(frame(Window.unboundedPreceding, 0))})
    m = k.withColumn("level", F.log("near") - F.col("log_link")).select("code", "date", "rolled", "quadrant", "log_link", (F.col("level") - lag("level")).alias("ret"), "oi")
    return recursive.rolling_scores(m, {"z252": ("ret", 252, 60, 1e-8), "oi_z252": ("oi", 252, 60, 1e-8)})


@query("d31_overnight_attach", "code date", "same_day next_day",
       CONTRACTS + f", o AS (SELECT date, avg(on_) AS x FROM (SELECT date, near_open / {slag('near')} - 1 AS on_ FROM nr) GROUP BY date), l AS (SELECT date, x, lag(x) OVER (ORDER BY date) AS y FROM o) ;; SELECT b.code, b.date, x AS same_day, y AS next_day FROM bars b LEFT JOIN l ON b.date = l.date", "bars trades")
def d31(d: Data):
    o = chosen(d).select("date", (F.col("near_open") / lag("near") - 1).alias("on_")).groupBy("date").agg(F.avg("on_").alias("same_day"))
    o = o.withColumn("next_day", F.lag("same_day").over(Window.orderBy("date")))  # one row for each date
    return d.bars.select("code", "date").join(o, "date", "left")


@query("d32_futures_categories", "date n", "spread oi_share slope",
       "fc AS (SELECT code, date, part % 5 AS month, arg_max(price, seq) AS settle, sum(quantity) AS oi FROM trades GROUP BY ALL), s AS (SELECT *, lead(settle) OVER (PARTITION BY code, date ORDER BY month) - settle AS sp, oi / sum(oi) OVER (PARTITION BY code, date) AS share FROM fc) ;; SELECT date, count(*) AS n, avg(sp) AS spread, max(share) AS oi_share, sum(sp * oi) / nullif(sum(CASE WHEN sp IS NOT NULL THEN oi END), 0) AS slope FROM s GROUP BY date", "trades")
def d32(d: Data):
    w = Window.partitionBy("code", "date")
    s = contracts(d).withColumns({"sp": F.lead("settle").over(w.orderBy("month")) - F.col("settle"), "share": F.col("oi") / F.sum("oi").over(w)})
    return s.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("sp").alias("spread"), F.max("share").alias("oi_share"), ratio(F.sum(F.col("sp") * F.col("oi")), F.sum(F.when(F.col("sp").isNotNull(), F.col("oi")))).alias("slope"))


# Options: each raw record is an option on its code and date; strike, expiry and volatility come from its columns.
CHAIN = "oc AS (SELECT seq, code, date, price, quantity AS oi, 1000.0 + 100 * (part % 20) AS strike, (10 + seq % 80) / 365.0 AS tau, 0.1 + (part % 30) / 100.0 AS iv, part % 2 = 0 AS is_put, seq % 3 AS expiry FROM trades), og AS (SELECT *, (ln(price / strike) + iv * iv / 2 * tau) / (iv * sqrt(tau)) AS d1 FROM oc)"


def chain(d: Data):
    o = d.trades.select(
        "seq", "code", "date", "price", F.col("quantity").alias("oi"), (1000.0 + 100 * (F.col("part") % 20)).alias("strike"), ((10 + F.col("seq") % 80) / 365.0).alias("tau"),
        (0.1 + (F.col("part") % 30) / 100.0).alias("iv"), (F.col("part") % 2 == 0).alias("is_put"), (F.col("seq") % 3).alias("expiry"),
    )
    return o.withColumn("d1", (F.log(F.col("price") / F.col("strike")) + F.col("iv") * F.col("iv") / 2 * F.col("tau")) / (F.col("iv") * F.sqrt("tau")))


def _scdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-{x} * {x} / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query("d33_option_chain", "seq days", "moneyness d1 d2 delta gamma vega iv_spread ret rank",
       CHAIN + f""" ;; SELECT seq, CAST(round(tau * 365) AS BIGINT) AS days, price / strike AS moneyness, d1, d1 - iv * sqrt(tau) AS d2, ({_scdf('d1')}) - CASE WHEN is_put THEN 1 ELSE 0 END AS delta, exp(-d1 * d1 / 2) / 2.5066282746310002 / (price * iv * sqrt(tau)) AS gamma, price * exp(-d1 * d1 / 2) / 2.5066282746310002 * sqrt(tau) AS vega,
iv - avg(iv) OVER (PARTITION BY code, date) AS iv_spread, price / lag(price) OVER (PARTITION BY code, strike, is_put ORDER BY date, seq) - 1 AS ret, {srank01('iv', 'code, date, expiry')} AS rank FROM og""", "trades")  # fmt: skip
def d33(d: Data):
    """Moneyness, greeks, spread of the volatility against the chain's mean, return of the contract, and the rank of its volatility."""
    o = chain(d)
    pdf = F.exp(-F.col("d1") * F.col("d1") / 2) / 2.5066282746310002
    root = F.sqrt("tau")
    own = Window.partitionBy("code", "strike", "is_put").orderBy("date", "seq")
    return o.select(
        "seq", F.round(F.col("tau") * 365).cast("long").alias("days"), (F.col("price") / F.col("strike")).alias("moneyness"), "d1", (F.col("d1") - F.col("iv") * root).alias("d2"), (normal_cdf("d1") - F.when(F.col("is_put"), 1.0).otherwise(0.0)).alias("delta"),
        (pdf / (F.col("price") * F.col("iv") * root)).alias("gamma"), (F.col("price") * pdf * root).alias("vega"), (F.col("iv") - F.avg("iv").over(Window.partitionBy("code", "date"))).alias("iv_spread"), (F.col("price") / F.lag("price").over(own) - 1).alias("ret"), rank01("iv", "code", "date", "expiry").alias("rank"),
    )


CMIV = CHAIN + ", g AS (SELECT date, tau, avg(iv) AS iv FROM oc GROUP BY date, tau), c AS (SELECT date, " + ", ".join(f"max(tau) FILTER (tau <= {t}) AS lo{n}, arg_max(iv, tau) FILTER (tau <= {t}) AS il{n}, min(tau) FILTER (tau > {t}) AS hi{n}, arg_min(iv, tau) FILTER (tau > {t}) AS ih{n}" for n, t in ((30, "30 / 365.0"), (60, "60 / 365.0"))) + " FROM g GROUP BY date), cm AS (SELECT date, " + ", ".join(f"CASE WHEN lo{n} IS NULL THEN ih{n} WHEN hi{n} IS NULL THEN il{n} ELSE il{n} + (ih{n} - il{n}) * ({n} / 365.0 - lo{n}) / (hi{n} - lo{n}) END AS iv{n}" for n in (30, 60)) + " FROM c)"


def constant_maturity(d: Data):
    """Volatility at 30 and 60 days, between the nearest maturities of a date."""
    g = chain(d).groupBy("date", "tau").agg(F.avg("iv").alias("iv"))
    parts = []
    for n in (30, 60):
        t = F.lit(n) / 365.0
        below, above = F.col("tau") <= t, F.col("tau") > t
        parts += [F.max(F.when(below, F.struct("tau", "iv"))).alias(f"lo{n}"), F.min(F.when(above, F.struct("tau", "iv"))).alias(f"hi{n}")]
    c = g.groupBy("date").agg(*parts)

    def at(n: int):
        lo, hi = F.col(f"lo{n}"), F.col(f"hi{n}")
        return F.when(lo.isNull(), hi["iv"]).when(hi.isNull(), lo["iv"]).otherwise(lo["iv"] + (hi["iv"] - lo["iv"]) * (n / 365.0 - lo["tau"]) / (hi["tau"] - lo["tau"]))

    return c.select("date", at(30).alias("iv30"), at(60).alias("iv60"))


@query("d34_constant_maturity", "date", "iv30 iv60 slope", CMIV + " ;; SELECT date, iv30, iv60, iv60 - iv30 AS slope FROM cm", "trades")
def d34(d: Data):
    return constant_maturity(d).withColumn("slope", F.col("iv60") - F.col("iv30"))


@query("d35_option_market", "date", "near_iv next_iv skew smile put_call shock",
       CHAIN + """, g AS (SELECT date, median(iv) FILTER (expiry = 0) AS near_iv, median(iv) FILTER (expiry = 1) AS next_iv, median(iv) FILTER (is_put AND price < strike) - median(iv) FILTER (NOT is_put AND price > strike) AS skew, median(iv) FILTER (abs(price / strike - 1) > 0.2) - median(iv) FILTER (abs(price / strike - 1) <= 0.2) AS smile, sum(oi) FILTER (is_put) / nullif(sum(oi) FILTER (NOT is_put), 0) AS put_call FROM oc GROUP BY date) ;;
SELECT *, CASE WHEN count(near_iv) OVER o >= 10 THEN (near_iv - avg(near_iv) OVER o) / (stddev_samp(near_iv) OVER o + 1e-8) END AS shock FROM g WINDOW o AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "trades")  # fmt: skip
def d35(d: Data):
    """Medians of the volatility of a date by tenor, side and distance from the money, and how unusual the nearest is."""
    iv = lambda c: F.median(F.when(c, F.col("iv")))
    put, off = F.col("is_put"), F.abs(F.col("price") / F.col("strike") - 1)
    g = chain(d).groupBy("date").agg(
        iv(F.col("expiry") == 0).alias("near_iv"), iv(F.col("expiry") == 1).alias("next_iv"), (iv(put & (F.col("price") < F.col("strike"))) - iv(~put & (F.col("price") > F.col("strike")))).alias("skew"),
        (iv(off > 0.2) - iv(off <= 0.2)).alias("smile"), ratio(F.sum(F.when(put, F.col("oi"))), F.sum(F.when(~put, F.col("oi")))).alias("put_call"),
    )
    w = Window.orderBy("date")  # one row for each date
    return g.withColumn("shock", (F.col("near_iv") - roll(F.avg, "near_iv", 20, 10, w)) / (roll(F.stddev_samp, "near_iv", 20, 10, w) + 1e-8))


@query("d36_underlying_iv", "code date", "e0 e1 e2 slope put_call put_call_value skew",
       CHAIN + ", w AS (SELECT code, date, " + ", ".join(f"sum(iv * oi) FILTER (expiry = {k}) / sum(oi) FILTER (expiry = {k}) AS e{k}" for k in range(3)) + ", coalesce(sum(oi) FILTER (is_put), 0) / nullif(sum(oi) FILTER (NOT is_put), 0) AS put_call, coalesce(sum(oi * price) FILTER (is_put), 0) / nullif(sum(oi * price) FILTER (NOT is_put), 0) AS put_call_value, sum(iv * oi) FILTER (is_put AND price > strike) / sum(oi) FILTER (is_put AND price > strike) - sum(iv * oi) FILTER (NOT is_put AND price < strike) / sum(oi) FILTER (NOT is_put AND price < strike) AS skew FROM oc GROUP BY code, date) ;; SELECT *, e1 - e0 AS slope FROM w", "trades")
def d36(d: Data):
    """Volatility by expiry, weighted by open interest, ratios of puts to calls, and the skew of what is out of the money."""
    o, put = chain(d), F.col("is_put")
    wide = o.withColumn("e", F.concat(F.lit("e"), F.col("expiry").cast("string"))).groupBy("code", "date").pivot("e", ["e0", "e1", "e2"]).agg(F.sum(F.col("iv") * F.col("oi")) / F.sum("oi"))
    of = lambda c, x: F.sum(F.when(c, x))
    value, oi = F.col("oi") * F.col("price"), F.col("oi")
    weighted = lambda c: ratio(of(c, F.col("iv") * oi), of(c, oi))
    sides = o.groupBy("code", "date").agg(
        ratio(F.coalesce(of(put, oi), F.lit(0.0)), of(~put, oi)).alias("put_call"), ratio(F.coalesce(of(put, value), F.lit(0.0)), of(~put, value)).alias("put_call_value"),
        (weighted(put & (F.col("price") > F.col("strike"))) - weighted(~put & (F.col("price") < F.col("strike")))).alias("skew"),
    )
    return wide.join(sides, ["code", "date"]).withColumn("slope", F.col("e1") - F.col("e0"))


@query("d37_vrp", "date", "iv30 iv60 rv rv60 blend vrp_gap vrp_ratio z20",
       CMIV + ", m AS (SELECT date, m_close / lag(m_close) OVER (ORDER BY date) - 1 AS r FROM market), v AS (SELECT date, CASE WHEN count(r) OVER o >= 10 THEN stddev_samp(r) OVER o * sqrt(252) END AS rv, CASE WHEN count(r) OVER l >= 20 THEN stddev_samp(r) OVER l * sqrt(252) END AS rv60 FROM m WINDOW o AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), l AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), k AS (SELECT cm.date, iv30, iv60, rv, rv60, 0.5 * iv30 + 0.3 * rv + 0.2 * rv60 AS blend, iv30 - rv AS vrp_gap, iv30 / (rv + 1e-12) AS vrp_ratio FROM cm JOIN v ON cm.date = v.date) ;; SELECT *, CASE WHEN count(vrp_gap) OVER o >= 10 THEN (vrp_gap - avg(vrp_gap) OVER o) / (stddev_samp(vrp_gap) OVER o + 1e-8) END AS z20 FROM k WINDOW o AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "trades market")
def d37(d: Data):
    w = Window.orderBy("date")  # one row for each date
    m = d.market.withColumn("r", F.col("m_close") / F.lag("m_close").over(w) - 1)
    year = F.sqrt(F.lit(252.0))
    v = m.select("date", (roll(F.stddev_samp, "r", 20, 10, w) * year).alias("rv"), (roll(F.stddev_samp, "r", 60, 20, w) * year).alias("rv60"))
    k = constant_maturity(d).join(v, "date").withColumns({"vrp_gap": F.col("iv30") - F.col("rv"), "vrp_ratio": F.col("iv30") / (F.col("rv") + EPS), "blend": 0.5 * F.col("iv30") + 0.3 * F.col("rv") + 0.2 * F.col("rv60")})
    return k.withColumn("z20", (F.col("vrp_gap") - roll(F.avg, "vrp_gap", 20, 10, w)) / (roll(F.stddev_samp, "vrp_gap", 20, 10, w) + 1e-8))


@query("d38_option_sentiment", "date", "put_iv call_iv large_put",
       CHAIN + ", q AS (SELECT quantile_cont(oi, 0.9) AS cut FROM oc) ;; SELECT date, sum(iv * oi) FILTER (is_put) / sum(oi) FILTER (is_put) AS put_iv, sum(iv * oi) FILTER (NOT is_put) / sum(oi) FILTER (NOT is_put) AS call_iv, coalesce(sum(oi) FILTER (is_put AND oi >= cut), 0) / sum(oi) AS large_put FROM oc, q GROUP BY date", "trades")
def d38(d: Data):
    o = chain(d)
    q = select.quantiles(o, "oi", [0.9]).select(F.col("q")[0].alias("cut"))  # one row
    put = F.col("is_put")
    side = lambda c: ratio(F.sum(F.when(c, F.col("iv") * F.col("oi"))), F.sum(F.when(c, F.col("oi"))))
    return o.join(F.broadcast(q)).groupBy("date").agg(side(put).alias("put_iv"), side(~put).alias("call_iv"), (F.coalesce(F.sum(F.when(put & (F.col("oi") >= F.col("cut")), F.col("oi"))), F.lit(0.0)) / F.sum("oi")).alias("large_put"))


INDEX = "ix AS (SELECT market AS code, date, avg(close) AS close, max(high) AS high, min(low) AS low FROM panel GROUP BY market, date), ir AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM ix)"


def index_series(d: Data):
    ix = d.panel.groupBy(F.col("market").alias("code"), "date").agg(F.avg("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"))
    return ix.withColumn("r", F.col("close") / lag("close") - 1)


@query("d39_index_regime", "code date halted", "ret1 ret5 ret20 atr natr vol20 vol60 trend_gap vol_z regime",
       INDEX + f", v AS (SELECT *, close / {slag('close', 5)} - 1 AS ret5, close / {slag('close', 20)} - 1 AS ret20, greatest(high - low, abs(high - {slag('close')}), abs(low - {slag('close')})) AS tr, {sroll('stddev_samp', 'r', 20, 10)} AS vol20, {sroll('stddev_samp', 'r', 60, 20)} AS vol60, close / nullif({sroll('avg', 'close', 60, 20)}, 0) - 1 AS trend_gap FROM ir), a AS (SELECT *, {sroll('avg', 'tr', 14, 14)} AS atr FROM v) ;; SELECT code, date, r AS ret1, ret5, ret20, atr, atr / close AS natr, vol20, vol60, trend_gap, {sz('vol20', 60, 20)} AS vol_z, trend_gap / (vol20 + 1e-12) AS regime, high = low AS halted FROM a", "panel")
def d39(d: Data):
    """Returns, true range, volatilities and trend of the index series; days without a range are halts."""
    close, before = F.col("close"), lag("close")
    v = index_series(d).withColumns({"ret1": F.col("r"), "ret5": close / lag("close", 5) - 1, "ret20": close / lag("close", 20) - 1, "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
                                     "vol20": roll(F.stddev_samp, "r", 20, 10), "vol60": roll(F.stddev_samp, "r", 60, 20), "trend_gap": ratio("close", roll(F.avg, "close", 60, 20)) - 1})
    v = v.withColumn("atr", roll(F.avg, "tr", 14))
    return v.withColumns({"natr": F.col("atr") / close, "vol_z": zscore("vol20", 60, 20), "regime": F.col("trend_gap") / (F.col("vol20") + EPS), "halted": F.col("high") == F.col("low")})


@query("d40_index_relative", "code date family", "rel spread breadth",
       INDEX + f", b AS (SELECT date, r AS br, close AS bc FROM ir WHERE code = 0), q AS (SELECT *, close > ({sroll('avg', 'close', 50, 10)}) AS above FROM ir) ;; SELECT code, q.date, CASE WHEN code <= 1 THEN 'core' ELSE 'other' END AS family, r - br AS rel, close / bc AS spread, avg(CASE WHEN above THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY q.date) AS breadth FROM q LEFT JOIN b ON q.date = b.date", "panel")
def d40(d: Data):
    q = index_series(d).withColumn("above", F.col("close") > roll(F.avg, "close", 50, 10))
    at_date = Window.partitionBy("date")
    base = lambda c: F.max(F.when(F.col("code") == 0, F.col(c))).over(at_date)
    return q.select("code", "date", F.when(F.col("code") <= 1, "core").otherwise("other").alias("family"), (F.col("r") - base("r")).alias("rel"), (F.col("close") / base("close")).alias("spread"), F.avg(F.when(F.col("above"), 1.0).otherwise(0.0)).over(at_date).alias("breadth"))


@query("d41_sector_index", "code date", "index_return", SECTOR + " ;; SELECT d.code, b.date, g.eq AS index_return FROM bars b JOIN dim d ON b.code = d.code LEFT JOIN g ON g.sector = d.sector AND g.date = b.date", "panel bars dim")
def d41(d: Data):
    map_ = d.dim.select("code", "sector")
    series = sectors(d).select("date", "sector", F.col("eq").alias("index_return"))
    return d.bars.select("code", "date").join(map_, "code").join(series, ["date", "sector"], "left")


MKT = "mk0 AS (SELECT 0 AS code, date, m_close AS close, m_close / lag(m_close) OVER (ORDER BY date) - 1 AS r FROM market)"


def market_series(d: Data):
    m = d.market.select(F.lit(0).alias("code"), "date", F.col("m_close").alias("close"))  # one series
    return m.withColumn("r", F.col("close") / lag("close") - 1)


@query("d42_market_block", "date bull high_vol crossed", "ret1 ret5 ret20 rsi14 vol20 z252 drawdown pct_b width gap_5_20 gap_20_60",
       MKT + f", u AS (SELECT *, CASE WHEN close - {slag('close')} IS NOT NULL THEN greatest(close - {slag('close')}, 0) END AS up, CASE WHEN close - {slag('close')} IS NOT NULL THEN greatest({slag('close')} - close, 0) END AS down FROM mk0), " + smooth("u", {f"e{n}": ("close", 2 / (n + 1)) for n in (5, 20, 60)}, "es")
       + f""", v AS (SELECT *, {sroll('avg', 'close', 20, 20)} AS m, {sroll('stddev_samp', 'close', 20, 20)} AS s, {sroll('stddev_samp', 'r', 20, 10)} AS vol20, e5 / e20 - 1 AS gap_5_20, e20 / e60 - 1 AS gap_20_60 FROM es) ;;
SELECT date, r AS ret1, close / {slag('close', 5)} - 1 AS ret5, close / {slag('close', 20)} - 1 AS ret20, 100 - 100 / (1 + ({sroll('avg', 'up', 14)}) / (({sroll('avg', 'down', 14)}) + 1e-12)) AS rsi14, vol20, {sz('close', 252, 60)} AS z252, close / max(close) OVER {over(-251, 0)} - 1 AS drawdown, (close - (m - 2 * s)) / (4 * s + 1e-12) AS pct_b, 4 * s / (m + 1e-12) AS width, gap_5_20, gap_20_60,
coalesce(close > m, false) AS bull, coalesce({sz('vol20', 252, 60)} > 1, false) AS high_vol, coalesce(sign(gap_5_20) <> sign({slag('gap_5_20')}), false) AS crossed FROM v""", "market")  # fmt: skip
def d42(d: Data):
    """Returns, RSI, volatility, bands and gaps of exponential means of the market series, with flags of its regime."""
    v = recursive.smooth(with_moves(market_series(d)), {f"e{n}": ("close", recursive.span(n)) for n in (5, 20, 60)})  # one series, a row for each date
    c = F.col("close")
    v = v.withColumns({"m": roll(F.avg, "close", 20), "s": roll(F.stddev_samp, "close", 20), "vol20": roll(F.stddev_samp, "r", 20, 10), "gap_5_20": F.col("e5") / F.col("e20") - 1, "gap_20_60": F.col("e20") / F.col("e60") - 1})
    flag = lambda x: F.coalesce(x, F.lit(False))
    return v.withColumns({
        "ret1": F.col("r"), "ret5": c / lag("close", 5) - 1, "ret20": c / lag("close", 20) - 1, "rsi14": 100 - 100 / (1 + roll(F.avg, "up", 14) / (roll(F.avg, "down", 14) + EPS)), "z252": zscore("close", 252, 60),
        "drawdown": c / F.max("close").over(frame(-251, 0)) - 1, "pct_b": (c - (F.col("m") - 2 * F.col("s"))) / (4 * F.col("s") + EPS), "width": 4 * F.col("s") / (F.col("m") + EPS),
        "bull": flag(c > F.col("m")), "high_vol": flag(zscore("vol20", 252, 60) > 1), "crossed": flag(F.signum("gap_5_20") != F.signum(lag("gap_5_20"))),
    })


ASSETS = "as0 AS (SELECT part % 4 AS code, date, avg(price) AS close FROM trades GROUP BY ALL), ar AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM as0)"


def assets(d: Data):
    a = d.trades.groupBy((F.col("part") % 4).alias("code"), "date").agg(F.avg("price").alias("close"))
    return a.withColumn("r", F.col("close") / lag("close") - 1)


@query("d43_cross_asset", "code date surge", "vol mom pos52",
       ASSETS + f", v AS (SELECT *, {sroll('stddev_samp', 'r', 20, 10)} AS vol FROM ar) ;; SELECT code, date, vol, close / {slag('close', 20)} - 1 AS mom, (close - min(close) OVER {over(-251, 0)}) / nullif(max(close) OVER {over(-251, 0)} - min(close) OVER {over(-251, 0)}, 0) AS pos52, coalesce(vol > 1.5 * ({sroll('avg', 'vol', 60, 20)}), false) AS surge FROM v", "trades")
def d43(d: Data):
    v = assets(d).withColumn("vol", roll(F.stddev_samp, "r", 20, 10))
    low, high = F.min("close").over(frame(-251, 0)), F.max("close").over(frame(-251, 0))
    return v.select("code", "date", "vol", (F.col("close") / lag("close", 20) - 1).alias("mom"), ratio(F.col("close") - low, high - low).alias("pos52"), F.coalesce(F.col("vol") > 1.5 * roll(F.avg, "vol", 60, 20), F.lit(False)).alias("surge"))


@query("d44_cross_market", "date", "c0 c1 c2 c3 spread01 ratio23",
       ASSETS + ", w AS (SELECT date, " + ", ".join(f"max(close) FILTER (code = {k}) AS c{k}" for k in range(4)) + " FROM ar GROUP BY date) ;; SELECT *, c0 - c1 AS spread01, c2 / c3 AS ratio23 FROM w", "trades")
def d44(d: Data):
    w = assets(d).withColumn("k", F.concat(F.lit("c"), F.col("code").cast("string"))).groupBy("date").pivot("k", [f"c{k}" for k in range(4)]).agg(F.max("close"))
    return w.withColumns({"spread01": F.col("c0") - F.col("c1"), "ratio23": F.col("c2") / F.col("c3")})


@query("d45_calendar_features", "date dow month_end quarter_end fiscal_end sq_day sq_week to_weekend", "",
       "SELECT date, isodow(date) - 1 AS dow, last_day(date) = date AS month_end, last_day(date) = date AND month(date) % 3 = 0 AS quarter_end, last_day(date) = date AND month(date) = 3 AS fiscal_end, isodow(date) = 5 AND day(date) BETWEEN 8 AND 14 AS sq_day, isodow(date) <= 5 AND day(date + CAST(5 - isodow(date) AS INT)) BETWEEN 8 AND 14 AS sq_week, greatest(0, 5 - (isodow(date) - 1)) AS to_weekend FROM calendar", "calendar")
def d45(d: Data):
    """Weekday and period ends; the second Friday of a month settles contracts, and its week is Monday to Friday."""
    dow, end = F.weekday("date"), F.last_day("date") == F.col("date")
    friday = F.dayofmonth(F.date_add("date", (4 - dow).cast("int")))
    return d.calendar.select("date", dow.alias("dow"), end.alias("month_end"), (end & (F.month("date") % 3 == 0)).alias("quarter_end"), (end & (F.month("date") == 3)).alias("fiscal_end"), ((dow == 4) & F.dayofmonth("date").between(8, 14)).alias("sq_day"),
                             ((dow <= 4) & friday.between(8, 14)).alias("sq_week"), F.greatest(F.lit(0), 5 - dow).alias("to_weekend"))


@query("d46_gap_predictor", "code date", "signal z rel",
       WITH_MARKET + f""", t AS (SELECT bm.*, sector FROM bm JOIN dim USING (code)), b AS (SELECT *, (({sroll('avg', 'r * mr', 60, 30)}) - ({sroll('avg', 'r', 60, 30)}) * ({sroll('avg', 'mr', 60, 30)})) / (({sroll('avg', 'mr * mr', 60, 30)}) - ({sroll('avg', 'mr', 60, 30)}) * ({sroll('avg', 'mr', 60, 30)}) + 1e-12) AS beta FROM t), s AS (SELECT *, beta * mr AS signal FROM b) ;;
SELECT code, date, signal, {sz('signal', 20, 10, left=True)} AS z, signal - avg(signal) OVER (PARTITION BY date, sector) AS rel FROM s""".replace(", b AS (SELECT *, ((", ", b2 AS (SELECT *, ((").replace("FROM b), s AS", "FROM b), s AS").replace("AS signal FROM b)", "AS signal FROM b2)"), "bars market dim")  # fmt: skip
def d46(d: Data):
    m = lambda c: roll(F.avg, c, 60, 30)
    t = with_market(d).join(d.dim.select("code", "sector"), "code")
    beta = (m(F.col("r") * F.col("mr")) - m("r") * m("mr")) / (m(F.col("mr") * F.col("mr")) - m("mr") * m("mr") + EPS)
    s = t.withColumn("signal", beta * F.col("mr"))
    return s.select("code", "date", "signal", zscore("signal", 20, 10, left=True).alias("z"), (F.col("signal") - F.avg("signal").over(by_sector())).alias("rel"))


@query("d47_event_flags", "code date flag", "",
       "e AS (SELECT DISTINCT CASE WHEN rec % 20 = 0 THEN NULL ELSE code END AS code, published AS date FROM snapshots) ;; SELECT b.code, b.date, CAST(o.code IS NOT NULL OR w.date IS NOT NULL AS INT) AS flag FROM bars b LEFT JOIN (SELECT * FROM e WHERE code IS NOT NULL) o ON o.code = b.code AND o.date = b.date LEFT JOIN (SELECT DISTINCT date FROM e WHERE code IS NULL) w ON w.date = b.date", "bars snapshots")
def d47(d: Data):
    e = d.snapshots.select(F.when(F.col("rec") % 20 != 0, F.col("code")).alias("code"), F.col("published").alias("date")).distinct()
    own = e.where("code is not null").withColumn("own", F.lit(1))
    every = e.where("code is null").select("date", F.lit(1).alias("every")).distinct()
    return d.bars.select("code", "date").join(own, ["code", "date"], "left").join(every, "date", "left").withColumn("flag", F.coalesce("own", "every", F.lit(0)))


@query("d48_output_flags", "code date limit_hit halted delisted", "",
       f"m AS (SELECT max(date) AS last FROM bars) ;; SELECT code, date, coalesce(abs(close / {slag('close')} - 1) >= 0.5, false) AS limit_hit, high = low AND volume < 10 AS halted, {slead('date')} IS NULL AND date < last - 90 AS delisted FROM bars, m")
def d48(d: Data):
    last = d.bars.agg(F.max("date").alias("last"))
    b = d.bars.join(F.broadcast(last))
    return b.select("code", "date", F.coalesce(F.abs(F.col("close") / lag("close") - 1) >= 0.5, F.lit(False)).alias("limit_hit"), ((F.col("high") == F.col("low")) & (F.col("volume") < 10)).alias("halted"), (lead("date").isNull() & (F.col("date") < F.date_sub("last", 90))).alias("delisted"))


@query("d49_earnings_legacy", "code date days_since days_to week", "surprise momentum",
       SNAP + f", s AS (SELECT code, date, amount / nullif({slroll('avg', 'amount', 4, 1)}, 0) - 1 AS surprise, amount / {slag('amount')} - 1 AS momentum FROM sn), p AS (SELECT b.code, b.date, s.date AS prv, surprise, momentum FROM bars b ASOF LEFT JOIN s ON b.code = s.code AND b.date >= s.date), n AS (SELECT p.*, s.date AS nxt FROM p ASOF LEFT JOIN s ON p.code = s.code AND p.date < s.date) ;; SELECT code, date, CASE WHEN prv IS NOT NULL THEN least(90, date - prv) END AS days_since, CASE WHEN nxt IS NOT NULL THEN least(90, nxt - date) END AS days_to, CAST(coalesce(nxt - date <= 5, false) AS INT) AS week, surprise, momentum FROM n", "bars snapshots")
def d49(d: Data):
    s = daily_snapshots(d)
    s = s.select("code", "date", F.col("date").alias("prv"), F.col("date").alias("nxt"), (ratio("amount", lroll(F.avg, "amount", 4, 1)) - 1).alias("surprise"), (F.col("amount") / lag("amount") - 1).alias("momentum"))
    n = asof_join(asof_join(d.bars.select("code", "date"), s, ["code"], "date", ["prv", "surprise", "momentum"]), s, ["code"], "date", ["nxt"], forward=True, strict=True)
    capped = lambda c: F.when(c.isNotNull(), F.least(F.lit(90), c))
    to = F.datediff("nxt", "date")
    return n.withColumns({"days_since": capped(F.datediff("date", "prv")), "days_to": capped(to), "week": F.coalesce(to <= 5, F.lit(False)).cast("int")})


@query("d50_share_master", "code date", "total free",
       STATEMENTS + " ;; SELECT code, date, amount * 1.1 - amount * 0.1 AS total, coalesce(CASE WHEN rec % 3 <> 0 THEN amount * 0.8 END, amount * 0.5) AS free FROM su", "snapshots calendar")
def d50(d: Data):
    a = F.col("amount")
    return statements(d).select("code", "date", (a * 1.1 - a * 0.1).alias("total"), F.coalesce(F.when(F.col("rec") % 3 != 0, a * 0.8), a * 0.5).alias("free"))


@query("d51_scaled_breakdown", "code date", "scaled", BREAK + f" ;; SELECT code, date, net_ratio * total / nullif({slroll('avg', 'total', 60, 10)}, 0) AS scaled FROM bn", "trades")
def d51(d: Data):
    return breakdown(d).select("code", "date", ratio(F.col("net_ratio") * F.col("total"), lroll(F.avg, "total", 60, 10)).alias("scaled"))
