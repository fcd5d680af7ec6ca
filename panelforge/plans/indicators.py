"""Technical indicators of each code (R rows)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_code, EPS, average_rank, clip, correlation, frame, lag, lroll, rank01, ratio, roll, zscore
from ..operators import recursive, runs
from ..operators.recursive import span
from ..sources.tables import Data
from .registry import query
from .sql import clip as sclip
from .sql import lag as slag
from .sql import lroll as slroll
from .sql import over, smooth
from .sql import rank01 as srank01
from .sql import roll as sroll
from .sql import z as sz
from .windows import IDX, RETURNS, WITH_MARKET, _returns, numbered, with_market

B = RETURNS.replace(" ;;", "")
SPANS = (5, 20, 60, 200)


@query("r1_ema", "code date", " ".join(f"ema_{n}" for n in SPANS), smooth("bars", {f"ema_{n}": ("close", span(n)) for n in SPANS}) + " ;; SELECT * FROM sm")
def r1(d: Data):
    return recursive.smooth(d.bars, {f"ema_{n}": ("close", span(n)) for n in SPANS})


@query("w9_left_closed_ema", "code date", "ewm_20", f"l AS (SELECT code, date, {slag('close')} AS x FROM bars), " + smooth("l", {"ewm_20": ("x", span(20))}) + " ;; SELECT * FROM sm")
def w9(d: Data):
    return recursive.smooth(d.bars.select("code", "date", lag("close").alias("x")), {"ewm_20": ("x", span(20))})


def adjusted_mean(source: str, out: str, x: str, a: float, name: str) -> str:
    """Adjusted exponential mean: weighted sums and their weights, both by recursion."""
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM {source}),
{name}_r AS (SELECT code, rn, coalesce({x}, 0)::DOUBLE AS a, CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM {name}_n WHERE rn = 1 UNION ALL
SELECT s.code, s.rn, CASE WHEN s.{x} IS NULL THEN r.a ELSE s.{x} + {1 - a} * r.a END, CASE WHEN s.{x} IS NULL THEN r.b ELSE 1 + {1 - a} * r.b END FROM {name}_r r JOIN {name}_n s ON s.code = r.code AND s.rn = r.rn + 1),
{name} AS (SELECT n.* EXCLUDE (rn), r.a / nullif(r.b, 0) AS {out} FROM {name}_n n JOIN {name}_r r ON n.code = r.code AND n.rn = r.rn)"""


@query("r2_ema_adjusted", "code date", "ema_r20", B + ", " + adjusted_mean("b", "ema_r20", "r", span(20), "ad") + " ;; SELECT * FROM ad")
def r2(d: Data):
    return recursive.smooth(_returns(d), {"ema_r20": ("r", span(20))}, adjust=True)


@query("r3_macd", "code date", "macd signal hist slope",
       adjusted_mean("bars", "fast", "close", span(12), "f1") + ", " + adjusted_mean("f1", "slow", "close", span(26), "f2") + ", f3 AS (SELECT *, fast - slow AS macd FROM f2), "
       + adjusted_mean("f3", "signal", "macd", span(9), "f4") + f" ;; SELECT code, date, macd, signal, macd - signal AS hist, macd - signal - {slag('macd - signal')} AS slope FROM f4")
def r3(d: Data):
    m = recursive.smooth(d.bars, {"fast": ("close", span(12)), "slow": ("close", span(26))}, adjust=True).withColumn("macd", F.col("fast") - F.col("slow"))
    m = recursive.smooth(m, {"signal": ("macd", span(9))}, adjust=True).withColumn("hist", F.col("macd") - F.col("signal"))
    return m.withColumn("slope", F.col("hist") - lag("hist"))


def with_moves(bars):
    """bars with the rise (up) and the fall (down) of the close."""
    change = F.col("close") - lag("close")
    return bars.withColumn("up", F.greatest(change, F.lit(0.0) * change)).withColumn("down", F.greatest(-change, F.lit(0.0) * change))


def moves(d: Data):
    return with_moves(d.bars)


MOVES = f"mv AS (SELECT *, CASE WHEN close - {slag('close')} IS NOT NULL THEN greatest(close - {slag('close')}, 0) END AS up, CASE WHEN close - {slag('close')} IS NOT NULL THEN greatest({slag('close')} - close, 0) END AS down FROM bars)"


def _rsi(up, down):
    return 100 - 100 / (1 + up / (down + EPS))


@query("r4_rsi_simple", "code date", "rsi14", MOVES + f" ;; SELECT code, date, 100 - 100 / (1 + ({sroll('avg', 'up', 14)}) / (({sroll('avg', 'down', 14)}) + 1e-12)) AS rsi14 FROM mv")
def r4(d: Data):
    return moves(d).select("code", "date", _rsi(roll(F.avg, "up", 14), roll(F.avg, "down", 14)).alias("rsi14"))


@query("r5_rsi_left_closed", "code date", "rsi14", MOVES + f" ;; SELECT code, date, 100 - 100 / (1 + ({slroll('avg', 'up', 14, 7)}) / (({slroll('avg', 'down', 14, 7)}) + 1e-12)) AS rsi14 FROM mv")
def r5(d: Data):
    return moves(d).select("code", "date", _rsi(lroll(F.avg, "up", 14, 7), lroll(F.avg, "down", 14, 7)).alias("rsi14"))


@query("r6_rsi_ema", "code date", "rsi14", MOVES + ", " + smooth("mv", {"eu": ("up", 1 / 14), "ed": ("down", 1 / 14)}) + " ;; SELECT code, date, 100 - 100 / (1 + eu / (ed + 1e-12)) AS rsi14 FROM sm")
def r6(d: Data):
    return recursive.smooth(moves(d), {"eu": ("up", 1 / 14), "ed": ("down", 1 / 14)}).withColumn("rsi14", _rsi(F.col("eu"), F.col("ed")))


@query("r7_sma", "code date", "sma_5 sma_20 sma_60 sma_120 to_sma_20 ema_gap",
       smooth("bars", {"e5": ("close", span(5)), "e20": ("close", span(20))}) + " ;; SELECT code, date, " + ", ".join(f"{sroll('avg', 'close', n)} AS sma_{n}" for n in (5, 20, 60, 120)) + f", close / ({sroll('avg', 'close', 20)}) AS to_sma_20, e5 / e20 - 1 AS ema_gap FROM sm")
def r7(d: Data):
    s = recursive.smooth(d.bars, {"e5": ("close", span(5)), "e20": ("close", span(20))})
    return s.select("code", "date", *[roll(F.avg, "close", n).alias(f"sma_{n}") for n in (5, 20, 60, 120)], (F.col("close") / roll(F.avg, "close", 20)).alias("to_sma_20"), (F.col("e5") / F.col("e20") - 1).alias("ema_gap"))


@query("r8_volume_ratios", "code date", "vr_5 vr_20 acceleration",
       f"SELECT code, date, volume / ({sroll('avg', 'volume', 5)}) AS vr_5, volume / ({sroll('avg', 'volume', 20)}) AS vr_20, ({sroll('avg', 'volume', 5)}) / ({sroll('avg', 'volume', 20)}) AS acceleration FROM bars")
def r8(d: Data):
    v5, v20 = roll(F.avg, "volume", 5), roll(F.avg, "volume", 20)
    return d.bars.select("code", "date", ratio("volume", v5).alias("vr_5"), ratio("volume", v20).alias("vr_20"), ratio(v5, v20).alias("acceleration"))


def true_range(d: Data):
    before = lag("close")
    return d.bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


TR = f"tr AS (SELECT *, greatest(high - low, abs(high - {slag('close')}), abs(low - {slag('close')})) AS tr FROM bars)"


@query("r9_atr", "code date", "tr atr14 atr2 atr_left natr",
       TR + ", " + smooth("tr", {"atr14": ("tr", span(14)), "atr2": ("tr", span(2))}) + f" ;; SELECT code, date, tr, atr14, atr2, {slroll('avg', 'tr', 14, 5)} AS atr_left, ({slroll('avg', 'tr', 14, 5)}) / close AS natr FROM sm")
def r9(d: Data):
    s = recursive.smooth(true_range(d), {"atr14": ("tr", span(14)), "atr2": ("tr", span(2))})
    left = lroll(F.avg, "tr", 14, 5)
    return s.select("code", "date", "tr", "atr14", "atr2", left.alias("atr_left"), (left / F.col("close")).alias("natr"))


@query("r10_volatility", "code date", "vol_5 vol_20 vol_60 ewm_var",
       B + ", b2 AS (SELECT *, r * r AS r2 FROM b), " + smooth("b2", {"ewm_var": ("r2", 0.06)}) + " ;; SELECT code, date, " + ", ".join(f"({sroll('stddev_samp', 'r', n)}) * {math.sqrt(252)!r} AS vol_{n}" for n in (5, 20, 60)) + ", ewm_var FROM sm")
def r10(d: Data):
    s = recursive.smooth(_returns(d).withColumn("r2", F.col("r") * F.col("r")), {"ewm_var": ("r2", 0.06)})
    return s.select("code", "date", *[(roll(F.stddev_samp, "r", n) * math.sqrt(252)).alias(f"vol_{n}") for n in (5, 20, 60)], "ewm_var")


def _positive(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, 0) END)"


N = 20
K = 0.34 / (1.34 + (N + 1) / (N - 1))


@query("r11_range_vols", "code date", "parkinson rogers_satchell yang_zhang vol_of_vol",
       f"""q AS (SELECT *, ln(high / low) * ln(high / low) AS hl, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / {slag('close')}) AS o, ln(close / open) AS c FROM bars),
v AS (SELECT code, date, sqrt(({slroll('avg', 'hl', 20, 10)}) / {4 * math.log(2)!r}) AS parkinson, sqrt({_positive(slroll('avg', 'rs', 20, 10))}) AS rogers_satchell,
sqrt({_positive('(' + slroll('var_samp', 'o', 20, 10) + ') + ' + repr(K) + ' * (' + slroll('var_samp', 'c', 20, 10) + ') + ' + repr(1 - K) + ' * (' + slroll('avg', 'rs', 20, 10) + ')')}) AS yang_zhang FROM q) ;;
SELECT *, {slroll('stddev_samp', 'yang_zhang', 20, 10)} AS vol_of_vol FROM v""")  # fmt: skip
def r11(d: Data):
    ln = lambda a, b: F.log(F.col(a) / F.col(b))
    q = d.bars.withColumns({"hl": ln("high", "low") * ln("high", "low"), "rs": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"), "o": F.log(F.col("open") / lag("close")), "c": ln("close", "open")})
    positive = lambda x: F.sqrt(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))
    rs = lroll(F.avg, "rs", N, 10)
    v = q.select(
        "code", "date", F.sqrt(lroll(F.avg, "hl", N, 10) / (4 * math.log(2))).alias("parkinson"), positive(rs).alias("rogers_satchell"),
        positive(lroll(F.var_samp, "o", N, 10) + K * lroll(F.var_samp, "c", N, 10) + (1 - K) * rs).alias("yang_zhang"),
    )
    return v.withColumn("vol_of_vol", lroll(F.stddev_samp, "yang_zhang", N, 10))


@query("r12_index_vols", "code date", "gk park rs",
       f"""m AS (SELECT market AS code, date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close FROM panel GROUP BY market, date),
q AS (SELECT *, ln(high / low) * ln(high / low) AS hl, ln(close / open) * ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r FROM m) ;;
SELECT code, date, sqrt({_positive(sroll('avg', f'(0.5 * hl - {2 * math.log(2) - 1!r} * co)', 20, 10))}) AS gk, sqrt(({sroll('avg', 'hl', 20, 10)}) / {4 * math.log(2)!r}) AS park, sqrt({_positive(sroll('avg', 'r', 20, 10))}) AS rs FROM q""", "panel")  # fmt: skip
def r12(d: Data):
    m = d.panel.groupBy(F.col("market").alias("code"), "date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")])
    ln = lambda a, b: F.log(F.col(a) / F.col(b))
    hl, co = ln("high", "low") * ln("high", "low"), ln("close", "open") * ln("close", "open")
    q = m.withColumns({"hl": hl, "g": 0.5 * hl - (2 * math.log(2) - 1) * co, "r": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")})
    positive = lambda x: F.sqrt(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))
    return q.select("code", "date", positive(roll(F.avg, "g", 20, 10)).alias("gk"), F.sqrt(roll(F.avg, "hl", 20, 10) / (4 * math.log(2))).alias("park"), positive(roll(F.avg, "r", 20, 10)).alias("rs"))


@query("r13_bollinger", "code date", "pct_b bandwidth z_close_20",
       f"m AS (SELECT *, {sroll('avg', 'close', 20)} AS m, {sroll('stddev_samp', 'close', 20)} AS s FROM bars) ;; SELECT code, date, {sclip('(close - (m - 2 * s)) / (4 * s + 1e-12)', 0, 1)} AS pct_b, 4 * s / (m + 1e-12) AS bandwidth, (close - m) / (s + 1e-12) AS z_close_20 FROM m")
def r13(d: Data):
    m = d.bars.withColumns({"m": roll(F.avg, "close", 20), "s": roll(F.stddev_samp, "close", 20)})
    c, mean, std = F.col("close"), F.col("m"), F.col("s")
    return m.select("code", "date", clip((c - (mean - 2 * std)) / (4 * std + EPS), 0.0, 1.0).alias("pct_b"), (4 * std / (mean + EPS)).alias("bandwidth"), ((c - mean) / (std + EPS)).alias("z_close_20"))


DM = f"""dm AS (SELECT *, CASE WHEN high - {slag('high')} > {slag('low')} - low AND high > {slag('high')} THEN high - {slag('high')} ELSE 0 END AS pdm,
CASE WHEN {slag('low')} - low > high - {slag('high')} AND {slag('low')} > low THEN {slag('low')} - low ELSE 0 END AS ndm FROM tr)"""


@query("r14_adx", "code date", "plus_di minus_di adx adx_z20",
       TR + ", " + DM + ", " + smooth("dm", {"st": ("tr", 1 / 14), "sp": ("pdm", 1 / 14), "sn": ("ndm", 1 / 14)}, "s1") + ", di AS (SELECT code, date, 100 * sp / (st + 1e-12) AS p, 100 * sn / (st + 1e-12) AS m, 100 * abs(sp - sn) / (sp + sn + 1e-12) AS dx FROM s1), "
       + smooth("di", {"ax": ("dx", 1 / 14)}, "s2") + f", lg AS (SELECT code, date, {slag('p')} AS plus_di, {slag('m')} AS minus_di, {slag('ax')} AS adx FROM s2) ;; SELECT *, {sz('adx', 20, 10)} AS adx_z20 FROM lg")
def r14(d: Data):
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    t = true_range(d).withColumns({"pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "ndm": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    s = recursive.smooth(t, {"st": ("tr", 1 / 14), "sp": ("pdm", 1 / 14), "sn": ("ndm", 1 / 14)})
    di = s.select("code", "date", (100 * F.col("sp") / (F.col("st") + EPS)).alias("p"), (100 * F.col("sn") / (F.col("st") + EPS)).alias("m"), (100 * F.abs(F.col("sp") - F.col("sn")) / (F.col("sp") + F.col("sn") + EPS)).alias("dx"))
    di = recursive.smooth(di, {"ax": ("dx", 1 / 14)}).select("code", "date", lag("p").alias("plus_di"), lag("m").alias("minus_di"), lag("ax").alias("adx"))
    return di.withColumn("adx_z20", zscore("adx", 20, 10))


@query("r15_donchian", "code date up_break down_break", "dc_high dc_low dc_width",
       f"c AS (SELECT *, max(high) OVER {over(-20, -1)} AS h, min(low) OVER {over(-20, -1)} AS l FROM bars) ;; SELECT code, date, h AS dc_high, l AS dc_low, (h - l) / close AS dc_width, close > h AS up_break, close < l AS down_break FROM c")
def r15(d: Data):
    w = frame(-20, -1)
    c = d.bars.withColumns({"dc_high": F.max("high").over(w), "dc_low": F.min("low").over(w)})
    return c.withColumns({"dc_width": (F.col("dc_high") - F.col("dc_low")) / F.col("close"), "up_break": F.col("close") > F.col("dc_high"), "down_break": F.col("close") < F.col("dc_low")})


@query("r16_keltner_squeeze", "code date squeeze fire", "mid upper lower",
       TR + ", " + smooth("tr", {"mid": ("close", span(20)), "atr": ("tr", span(14))}) + f""", k AS (SELECT *, mid + 1.5 * atr AS upper, mid - 1.5 * atr AS lower, {sroll('avg', 'close', 20)} AS m, {sroll('stddev_samp', 'close', 20)} AS s FROM sm),
q AS (SELECT *, coalesce(m + 2 * s < upper AND m - 2 * s > lower, false) AS squeeze FROM k) ;; SELECT code, date, squeeze, coalesce({slag('squeeze')}, false) AND NOT squeeze AS fire, mid, upper, lower FROM q""")  # fmt: skip
def r16(d: Data):
    k = recursive.smooth(true_range(d), {"mid": ("close", span(20)), "atr": ("tr", span(14))})
    k = k.withColumns({"upper": F.col("mid") + 1.5 * F.col("atr"), "lower": F.col("mid") - 1.5 * F.col("atr"), "m": roll(F.avg, "close", 20), "s": roll(F.stddev_samp, "close", 20)})
    k = k.withColumn("squeeze", F.coalesce((F.col("m") + 2 * F.col("s") < F.col("upper")) & (F.col("m") - 2 * F.col("s") > F.col("lower")), F.lit(False)))
    return k.withColumn("fire", F.coalesce(lag("squeeze"), F.lit(False)) & ~F.col("squeeze"))


@query("r17_aroon", "code date", "aroon_up aroon_down aroon_osc",
       IDX + f""", a AS (SELECT code, date, n, count(*) OVER {over(-24, 0)} AS c, -max(struct_pack(h := high, i := -n)) OVER {over(-24, 0)}.i AS hi, min(struct_pack(l := low, i := n)) OVER {over(-24, 0)}.i AS li FROM i) ;;
SELECT code, date, CASE WHEN c = 25 THEN (hi - n + 24) / 24.0 * 100 END AS aroon_up, CASE WHEN c = 25 THEN (li - n + 24) / 24.0 * 100 END AS aroon_down, CASE WHEN c = 25 THEN (hi - li) / 24.0 * 100 END AS aroon_osc FROM a""".replace(f"-max(struct_pack(h := high, i := -n)) OVER {over(-24, 0)}.i", f"-(max(struct_pack(h := high, i := -n)) OVER {over(-24, 0)}).i").replace(f"min(struct_pack(l := low, i := n)) OVER {over(-24, 0)}.i", f"(min(struct_pack(l := low, i := n)) OVER {over(-24, 0)}).i"))  # fmt: skip
def r17(d: Data):
    w = frame(-24, 0)
    high = -F.max(F.struct(F.col("high"), (-F.col("n")).alias("i"))).over(w)["i"]
    low = F.min(F.struct(F.col("low"), F.col("n").alias("i"))).over(w)["i"]
    full = F.count(F.lit(1)).over(w) == 25
    a = numbered(d.bars).withColumns({"hi": high, "li": low, "full": full})
    at = lambda c: F.when(F.col("full"), (F.col(c) - F.col("n") + 24) / 24.0 * 100)
    return a.select("code", "date", at("hi").alias("aroon_up"), at("li").alias("aroon_down"), (at("hi") - at("li")).alias("aroon_osc"))


@query("r18_gap_to_atr", "code date", "gap_atr range_atr",
       TR + ", " + smooth("tr", {"atr": ("tr", span(14))}) + f" ;; SELECT code, date, (open - {slag('close')}) / ({slag('atr')} + 1e-12) AS gap_atr, (high - low) / ({slag('atr')} + 1e-12) AS range_atr FROM sm")
def r18(d: Data):
    s = recursive.smooth(true_range(d), {"atr": ("tr", span(14))})
    return s.select("code", "date", ((F.col("open") - lag("close")) / (lag("atr") + EPS)).alias("gap_atr"), ((F.col("high") - F.col("low")) / (lag("atr") + EPS)).alias("range_atr"))


def _srsi(x: str, n: int, by: str = "code") -> str:
    g, l = f"CASE WHEN {x} - {slag(x)} IS NOT NULL THEN greatest({x} - {slag(x)}, 0) END", f"CASE WHEN {x} - {slag(x)} IS NOT NULL THEN greatest({slag(x)} - {x}, 0) END"  # noqa: E741
    return g, l


@query("r19_connors_rsi", "code date", "crsi",
       B + f""", s AS (SELECT *, CAST(coalesce(sign(r), 0) AS INT) AS dir FROM b), e AS (SELECT *, CASE WHEN dir = {slag('dir')} THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER {over('all', 0)} AS island FROM e),
k AS (SELECT *, dir * row_number() OVER (PARTITION BY code, island ORDER BY date) AS streak FROM g),
c AS (SELECT *, {_srsi('close', 3)[0]} AS cu, {_srsi('close', 3)[1]} AS cd, {_srsi('streak', 2)[0]} AS su, {_srsi('streak', 2)[1]} AS sd, list(r) FILTER (r IS NOT NULL) OVER {over(-100, 0)} AS rs FROM k),
p AS (SELECT *, CASE WHEN len(rs) >= 101 THEN len(list_filter(rs, lambda x: x < r)) / 100.0 * 100 END AS pr FROM c) ;;
SELECT code, date, (100 - 100 / (1 + ({sroll('avg', 'cu', 3)}) / (({sroll('avg', 'cd', 3)}) + 1e-12)) + 100 - 100 / (1 + ({sroll('avg', 'su', 2)}) / (({sroll('avg', 'sd', 2)}) + 1e-12)) + pr) / 3 AS crsi FROM p""")  # fmt: skip
def r19(d: Data):
    s = _returns(d).withColumn("dir", F.coalesce(F.signum("r"), F.lit(0.0)).cast("int"))
    k = runs.islands(s, "code", "date", F.col("dir")).withColumn("streak", F.col("dir") * F.row_number().over(Window.partitionBy("code", "island").orderBy("date")))
    for name, x in (("c", "close"), ("s", "streak")):
        change = F.col(x) - lag(x)
        k = k.withColumns({f"{name}u": F.greatest(change, change * 0), f"{name}d": F.greatest(-change, change * 0)})
    k = k.withColumn("rs", F.collect_list("r").over(frame(-100, 0)))
    smaller = F.size(F.filter("rs", lambda x: x < F.col("r")))
    pr = F.when(F.size("rs") >= 101, smaller / 100.0 * 100)
    return k.select("code", "date", ((_rsi(roll(F.avg, "cu", 3), roll(F.avg, "cd", 3)) + _rsi(roll(F.avg, "su", 2), roll(F.avg, "sd", 2)) + pr) / 3).alias("crsi"))


@query("r20_obv", "code date", "obv obv_z20",
       B + f", o AS (SELECT *, sum(coalesce(sign(r), 0) * volume) OVER {over('all', 0)} AS obv FROM b) ;; SELECT code, date, obv, {sz('obv', 20, 10)} AS obv_z20 FROM o")
def r20(d: Data):
    o = _returns(d).withColumn("obv", F.sum(F.coalesce(F.signum("r"), F.lit(0.0)) * F.col("volume")).over(frame(Window.unboundedPreceding, 0)))
    return o.select("code", "date", "obv", zscore("obv", 20, 10).alias("obv_z20"))


@query("r21_chaikin", "code date", "cmf20",
       f"m AS (SELECT *, coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume AS mfv FROM bars) ;; SELECT code, date, ({sroll('sum', 'mfv', 20)}) / nullif({sroll('sum', 'volume', 20)}, 0) AS cmf20 FROM m")
def r21(d: Data):
    m = d.bars.withColumn("mfv", F.coalesce(F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume"))
    return m.select("code", "date", ratio(roll(F.sum, "mfv", 20), roll(F.sum, "volume", 20)).alias("cmf20"))


@query("r22_amihud", "code date", "illiq illiq_z20",
       B + f", a AS (SELECT *, abs(r) / turnover * 1e6 AS il FROM b), m AS (SELECT *, {sroll('median', 'il', 20, 10)} AS med FROM a), l AS (SELECT code, date, {slag('med')} AS illiq FROM m) ;; SELECT code, date, illiq, {sz('illiq', 20, 10)} AS illiq_z20 FROM l")
def r22(d: Data):
    a = _returns(d).withColumn("il", F.abs("r") / F.col("turnover") * 1e6)
    m = a.withColumn("med", roll(lambda x: F.percentile(x, 0.5), "il", 20, 10)).select("code", "date", lag("med").alias("illiq"))
    return m.withColumn("illiq_z20", zscore("illiq", 20, 10))


def _adaptive(constant: str, out: str, n: int) -> str:
    return f"""k_n AS MATERIALIZED (SELECT *, {slag('close')} AS pc FROM (SELECT *, {constant} AS c, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM st)),
k_r AS (SELECT code, rn, pc + c * (close - pc) AS v FROM k_n WHERE rn = {n + 1} UNION ALL SELECT s.code, s.rn, r.v + s.c * (s.close - r.v) FROM k_r r JOIN k_n s ON s.code = r.code AND s.rn = r.rn + 1) ;;
SELECT n.code, n.date, r.v AS {out} FROM k_n n LEFT JOIN k_r r ON n.code = r.code AND n.rn = r.rn"""


STEPS = f"st AS (SELECT *, close - {slag('close')} AS step FROM bars)"


@query("r23_kama", "code date", "kama",
       STEPS + ", " + _adaptive(f"power(coalesce(abs(close - {slag('close', 10)}) / nullif({sroll('sum(abs({}))', 'step', 10)}, 0), 0) * {span(2) - span(30)!r} + {span(30)!r}, 2)", "kama", 10))
def r23(d: Data):
    return recursive.kama(d.bars)


@query("r24_vidya", "code date", "vidya",
       STEPS + ", " + _adaptive(f"{span(14)!r} * coalesce(abs({sroll('sum', 'step', 14)}) / nullif({sroll('sum(abs({}))', 'step', 14)}, 0), 0)", "vidya", 14))
def r24(d: Data):
    return recursive.vidya(d.bars)


def _weights(order: float, n: int) -> list[float]:
    w = [1.0]
    for k in range(1, n):
        w.append(-w[-1] * (order - k + 1) / k)
    return w


FRACTION = _weights(0.4, 100)


@query("r25_fractional_diff", "code date", "fd",
       f"v AS (SELECT code, date, list(ln(close)) OVER {over(-99, 0)} AS a FROM bars) ;; SELECT code, date, CASE WHEN len(a) = 100 THEN list_sum(list_transform(list_zip(list_reverse(a), {FRACTION}::DOUBLE[]), lambda p: p[1] * p[2])) END AS fd FROM v")
def r25(d: Data):
    values = F.reverse(F.collect_list(F.log("close")).over(frame(-99, 0)))
    v = d.bars.select("code", "date", values.alias("a"))
    products = F.zip_with("a", F.array(*map(F.lit, FRACTION)), lambda x, w: x * w)
    return v.select("code", "date", F.when(F.size("a") == 100, F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).alias("fd"))


@query("r26_stochastic", "code date", "k14",
       f"m AS (SELECT *, {sroll('min', 'low', 14)} AS l, {sroll('max', 'high', 14)} AS h FROM bars) ;; SELECT code, date, 100 * (close - l) / nullif(h - l, 0) AS k14 FROM m")
def r26(d: Data):
    low, high = roll(F.min, "low", 14), roll(F.max, "high", 14)
    return d.bars.select("code", "date", ratio(100 * (F.col("close") - low), high - low).alias("k14"))


@query("r27_interactions", "code date", "rsi_x_vol mom_confirmed x_up x_down x_decay x_trend_vol",
       MOVES + f""", x AS (SELECT *, 100 - 100 / (1 + ({sroll('avg', 'up', 14)}) / (({sroll('avg', 'down', 14)}) + 1e-12)) AS rsi, close / {slag('close', 20)} - 1 AS mom, volume / nullif({sroll('avg', 'volume', 20)}, 0) AS vr, ({sroll('stddev_samp', 'close', 20)}) / close AS v FROM mv) ;;
SELECT code, date, rsi * v AS rsi_x_vol, mom * vr AS mom_confirmed, CASE WHEN rsi IS NOT NULL THEN greatest(rsi - 70, 0) END * mom AS x_up, CASE WHEN rsi IS NOT NULL THEN greatest(30 - rsi, 0) END * mom AS x_down, mom * exp(-v) AS x_decay, sign(mom) * v * vr AS x_trend_vol FROM x""")  # fmt: skip
def r27(d: Data):
    x = moves(d).withColumns({
        "rsi": _rsi(roll(F.avg, "up", 14), roll(F.avg, "down", 14)), "mom": F.col("close") / lag("close", 20) - 1,
        "vr": ratio("volume", roll(F.avg, "volume", 20)), "v": roll(F.stddev_samp, "close", 20) / F.col("close"),
    })
    rsi, mom, vr, v = (F.col(c) for c in ("rsi", "mom", "vr", "v"))
    hinge = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return x.select("code", "date", (rsi * v).alias("rsi_x_vol"), (mom * vr).alias("mom_confirmed"), (hinge(rsi - 70) * mom).alias("x_up"), (hinge(30 - rsi) * mom).alias("x_down"), (mom * F.exp(-v)).alias("x_decay"), (F.signum(mom) * v * vr).alias("x_trend_vol"))


@query("r28_variance_ratio", "code date consensus", "vr_2 vr_5 vr_10 inefficiency slope_short slope_long slope_total agree_5_10 agree_10_21",
       f"""l AS (SELECT *, ln(close) AS p FROM bars), k AS (SELECT *, {', '.join(f"p - {slag('p', n)} AS l{n}" for n in (1, 2, 5, 10, 21))} FROM l),
v AS (SELECT *, {', '.join(f"({sroll('var_samp', f'l{n}', 21)}) / ({n} * ({sroll('var_samp', 'l1', 21)}) + 1e-12) AS vr_{n}" for n in (2, 5, 10))}, {', '.join(f"{sroll('stddev_samp', 'l1', n)} AS s{n}" for n in (5, 21, 63))} FROM k) ;;
SELECT code, date, vr_2, vr_5, vr_10, (abs(vr_2 - 1) + abs(vr_5 - 1) + abs(vr_10 - 1)) / 3 AS inefficiency, (s21 - s5) / (s5 + 1e-12) AS slope_short, (s63 - s21) / (s21 + 1e-12) AS slope_long, (s63 - s5) / (s5 + 1e-12) AS slope_total,
(l5 > 0)::INT + (l10 > 0)::INT + (l21 > 0)::INT AS consensus, CASE WHEN l10 IS NOT NULL THEN (l5 * l10 > 0)::INT END AS agree_5_10, CASE WHEN l21 IS NOT NULL THEN (l10 * l21 > 0)::INT END AS agree_10_21 FROM v""")  # fmt: skip
def r28(d: Data):
    """Variance ratios over 2, 5 and 10 rows, slopes of the volatility over 5, 21 and 63 rows, and how far momenta agree."""
    k = d.bars.withColumn("p", F.log("close"))
    k = k.withColumns({f"l{n}": F.col("p") - lag("p", n) for n in (1, 2, 5, 10, 21)})
    var = lambda c: roll(F.var_samp, c, 21)
    k = k.withColumns({f"vr_{n}": var(f"l{n}") / (n * var("l1") + EPS) for n in (2, 5, 10)} | {f"s{n}": roll(F.stddev_samp, "l1", n) for n in (5, 21, 63)})
    slope = lambda a, b: (F.col(b) - F.col(a)) / (F.col(a) + EPS)
    up = lambda c: (F.col(c) > 0).cast("int")
    off = sum((F.abs(F.col(f"vr_{n}") - 1) for n in (2, 5, 10)), F.lit(0.0)) / 3
    return k.withColumns({"inefficiency": off, "slope_short": slope("s5", "s21"), "slope_long": slope("s21", "s63"), "slope_total": slope("s5", "s63"), "consensus": up("l5") + up("l10") + up("l21"),
                          "agree_5_10": (F.col("l5") * F.col("l10") > 0).cast("int"), "agree_10_21": (F.col("l10") * F.col("l21") > 0).cast("int")})


@query("r29_uncertainty_index", "code date", "cui",
       B + f""", x AS (SELECT code, date, {sroll('stddev_samp', 'r', 20, 10)} AS a, (high - low) / close AS b, abs(r) AS c FROM b),
q AS (SELECT code, date, {srank01('a', 'code')} AS ra, {srank01('b', 'code')} AS rb, {srank01('c', 'code')} AS rc FROM x) ;; SELECT code, date, 10 + 40 * (0.5 * ra + 0.3 * rb + 0.2 * rc) AS cui FROM q""")  # fmt: skip
def r29(d: Data):
    x = _returns(d).select("code", "date", roll(F.stddev_samp, "r", 20, 10).alias("a"), ((F.col("high") - F.col("low")) / F.col("close")).alias("b"), F.abs("r").alias("c"))
    return x.select("code", "date", (10 + 40 * (0.5 * rank01("a", "code") + 0.3 * rank01("b", "code") + 0.2 * rank01("c", "code"))).alias("cui"))


@query("r30_regime_class", "code date regime", "trend_r2",
       IDX + f""", v AS (SELECT *, CASE WHEN count(close) OVER {over(-20, 0)} = 21 THEN power(corr(close, n) OVER {over(-20, 0)}, 2) END AS trend_r2, {sroll('stddev_samp', 'close', 21)} AS s FROM i), p AS (SELECT *, {srank01('s', 'code')} AS vp FROM v) ;;
SELECT code, date, trend_r2, CASE WHEN vp IS NULL OR trend_r2 IS NULL THEN NULL WHEN vp >= 0.5 AND trend_r2 >= 0.5 THEN 3 WHEN vp >= 0.5 THEN 2 WHEN trend_r2 >= 0.5 THEN 1 ELSE 0 END AS regime FROM p""")  # fmt: skip
def r30(d: Data):
    w = frame(-20, 0)
    v = numbered(d.bars).withColumns({"trend_r2": F.when(F.count("close").over(w) == 21, F.pow(correlation("close", "n", w), 2)), "s": roll(F.stddev_samp, "close", 21)})
    v = v.withColumn("vp", rank01("s", "code"))
    high, trend = F.col("vp") >= 0.5, F.col("trend_r2") >= 0.5
    return v.withColumn("regime", F.when(high & trend, 3).when(high & ~trend, 2).when(~high & trend, 1).when(~high & ~trend, 0))
