"""Cross sections of a date and groups of a date (X rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kernels import by_date, by_sector, EPS, average_rank, clip, frame, lag, lead, lroll, rank01, ratio, roll, zscore
from ..operators import recursive, select
from ..sources.tables import Data
from .indicators import MOVES, adjusted_mean, with_moves
from .registry import query
from .sql import average_rank as saverage_rank
from .sql import clip as sclip
from .sql import lag as slag
from .sql import over
from .sql import rank01 as srank01
from .sql import roll as sroll
from .sql import z as sz
from .windows import WITH_MARKET, with_market

P = "p AS (SELECT *, close / lag(close) OVER w - 1 AS r, close / lag(close, 5) OVER w - 1 AS r_5 FROM panel WINDOW w AS (PARTITION BY code ORDER BY date))"
CUT = "DATE '1999-01-01'"


def panel(d: Data):
    return d.panel.withColumns({"r": F.col("close") / lag("close") - 1, "r_5": F.col("close") / lag("close", 5) - 1})


def _train():
    return F.col("date") < F.lit("1999-01-01").cast("date")


@query("x1_average_rank", "code date", "rank_close rank_sector", P + f" ;; SELECT code, date, {srank01('close', 'date')} AS rank_close, {srank01('r', 'date, sector')} AS rank_sector FROM p", "panel")
def x1(d: Data):
    return panel(d).select("code", "date", rank01("close", "date").alias("rank_close"), rank01("r", "date", "sector").alias("rank_sector"))


@query("x2_cross_z", "code date", "z", P + " ;; SELECT code, date, (r - avg(r) OVER d) / nullif(stddev_samp(r) OVER d, 0) AS z FROM p WINDOW d AS (PARTITION BY date)", "panel")
def x2(d: Data):
    return panel(d).select("code", "date", ratio(F.col("r") - F.avg("r").over(by_date()), F.stddev_samp("r").over(by_date())).alias("z"))


@query("x3_cross_z_safe", "code date", "z", P + f" , q AS (SELECT code, date, (r - avg(r) OVER d) / ((stddev_samp(r) OVER d) + 1e-8) AS z0 FROM p WINDOW d AS (PARTITION BY date)) ;; SELECT code, date, coalesce({sclip('z0', -5, 5)}, 0) AS z FROM q", "panel")
def x3(d: Data):
    z = (F.col("r") - F.avg("r").over(by_date())) / (F.stddev_samp("r").over(by_date()) + 1e-8)
    return panel(d).select("code", "date", F.coalesce(clip(z, -5.0, 5.0), F.lit(0.0)).alias("z"))


@query("x4_ordinal_flags", "code date rank top20 bottom20", "pct",
       """q AS (SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, code) AS rank, count(*) OVER (PARTITION BY date) AS n FROM bars) ;;
SELECT code, date, rank, rank / n::DOUBLE AS pct, rank / n::DOUBLE <= 0.2 AS top20, rank / n::DOUBLE > 0.8 AS bottom20 FROM q""")  # fmt: skip
def x4(d: Data):
    q = d.bars.withColumns({"rank": F.row_number().over(by_date().orderBy(F.desc("close"), "code")), "n": F.count(F.lit(1)).over(by_date())}).withColumn("pct", F.col("rank") / F.col("n"))
    return q.withColumns({"top20": F.col("pct") <= 0.2, "bottom20": F.col("pct") > 0.8})


@query("x5_train_normaliser", "code date", "z",
       P + f", s AS (SELECT sector, month(date) AS m, avg(r) AS mu, stddev_samp(r) AS sd FROM p WHERE date < {CUT} GROUP BY ALL) ;; SELECT code, date, (r - mu) / (sd + 1e-8) AS z FROM p LEFT JOIN s ON p.sector = s.sector AND month(p.date) = s.m", "panel")
def x5(d: Data):
    p = panel(d).withColumn("m", F.month("date"))
    s = p.where(_train()).groupBy("sector", "m").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    return p.join(s, ["sector", "m"], "left").select("code", "date", ((F.col("r") - F.col("mu")) / (F.col("sd") + 1e-8)).alias("z"))


@query("x6_normaliser_fallback", "code date", "z",
       P + f""", s AS (SELECT date, avg(r) AS mu, stddev_samp(r) AS sd FROM p GROUP BY date HAVING count(r) >= 3), g AS (SELECT avg(r) AS gm, stddev_samp(r) AS gs FROM p WHERE date < {CUT}),
q AS (SELECT code, p.date, (r - coalesce(mu, gm)) / (coalesce(sd, gs) + 1e-8) AS z0 FROM p LEFT JOIN s ON p.date = s.date, g) ;; SELECT code, date, {sclip('z0', -5, 5)} AS z FROM q""", "panel")  # fmt: skip
def x6(d: Data):
    p = panel(d)
    s = p.groupBy("date").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n")).where("n >= 3").drop("n")
    g = p.where(_train()).agg(F.avg("r").alias("gm"), F.stddev_samp("r").alias("gs"))
    z = (F.col("r") - F.coalesce("mu", "gm")) / (F.coalesce("sd", "gs") + 1e-8)
    return p.join(s, "date", "left").join(F.broadcast(g)).select("code", "date", clip(z, -5.0, 5.0).alias("z"))  # g is one row


@query("x7_winsorise_sigma", "code date", "w", P.replace("p AS (", "p AS MATERIALIZED (", 1) + f", g AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM p WHERE date < {CUT}) ;; SELECT code, date, CASE WHEN r IS NOT NULL THEN greatest((SELECT m - 2 * s FROM g), least((SELECT m + 2 * s FROM g), r)) END AS w FROM p", "panel")
def x7(d: Data):
    p = panel(d)
    g = p.where(_train()).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return p.join(F.broadcast(g)).select("code", "date", F.when(F.col("r").isNotNull(), F.greatest(F.col("m") - 2 * F.col("s"), F.least(F.col("m") + 2 * F.col("s"), F.col("r")))).alias("w"))


@query("x8_quantile_clip", "code date", "clipped anomaly",
       P.replace("p AS (", "p AS MATERIALIZED (", 1) + ", g AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi, avg(r) AS m, stddev_samp(r) AS s FROM p) ;; SELECT code, date, CASE WHEN r IS NOT NULL THEN greatest((SELECT lo FROM g), least((SELECT hi FROM g), r)) END AS clipped, abs((r - (SELECT m FROM g)) / ((SELECT s FROM g) + 1e-8)) AS anomaly FROM p", "panel")
def x8(d: Data):
    p = panel(d)
    g = p.agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    q = select.quantiles(p, "r", [0.01, 0.99])  # one row, as g
    return p.join(F.broadcast(g)).join(F.broadcast(q)).select("code", "date", F.when(F.col("r").isNotNull(), F.greatest(F.col("q")[0], F.least(F.col("q")[1], F.col("r")))).alias("clipped"), F.abs((F.col("r") - F.col("m")) / (F.col("s") + 1e-8)).alias("anomaly"))


@query("x9_entity_winsorise", "code date", "w",
       P + f", g AS (SELECT code, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM p WHERE date < {CUT} GROUP BY code) ;; SELECT p.code, date, CASE WHEN r IS NOT NULL THEN greatest(lo, least(hi, r)) END AS w FROM p LEFT JOIN g ON p.code = g.code", "panel")
def x9(d: Data):
    p = panel(d)
    g = p.where(_train()).groupBy("code").agg(F.percentile("r", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return p.join(g, "code", "left").select("code", "date", F.when(F.col("r").isNotNull(), F.greatest(F.col("q")[0], F.least(F.col("q")[1], F.col("r")))).alias("w"))


@query("x10_robust_scaler", "code date", "z",
       P + f", m AS (SELECT median(r) AS med FROM p WHERE code % 2 = 0), a AS (SELECT median(abs(r - med)) AS mad FROM p, m WHERE code % 2 = 0), q AS (SELECT code, date, (r - med) / (1.4826 * mad + 1e-8) AS z0 FROM p, m, a) ;; SELECT code, date, {sclip('z0', -5, 5)} AS z FROM q", "panel")
def x10(d: Data):
    p = panel(d)
    sample = p.where("code % 2 = 0")
    m = select.quantiles(sample, "r", [0.5]).select(F.col("q")[0].alias("med"))  # one row, as a
    a = select.quantiles(sample.join(F.broadcast(m)).select(F.abs(F.col("r") - F.col("med")).alias("d")), "d", [0.5]).select(F.col("q")[0].alias("mad"))
    return p.join(F.broadcast(m)).join(F.broadcast(a)).select("code", "date", clip((F.col("r") - F.col("med")) / (1.4826 * F.col("mad") + 1e-8), -5.0, 5.0).alias("z"))


GROUP = "(PARTITION BY date, sector)"


def loo_mean(x: str, w=None):
    w = w or by_sector()
    return F.when(F.count(x).over(w) > 1, ratio(F.sum(x).over(w) - F.col(x), F.count(x).over(w) - 1))


@query("x11_leave_one_out", "code date", "loo med",
       P + f" ;; SELECT code, date, CASE WHEN count(r) OVER g > 1 THEN (sum(r) OVER g - r) / nullif(count(r) OVER g - 1, 0) END AS loo, median(r) OVER g AS med FROM p WINDOW g AS {GROUP}", "panel")
def x11(d: Data):
    p = panel(d)
    medians = p.groupBy("date", "sector").agg(F.median("r").alias("med"))
    return p.withColumn("loo", loo_mean("r")).join(medians, ["date", "sector"], "left")


@query("x12_peers", "code date", "peer_mean peer_std diff ratio",
       P + f""", q AS (SELECT *, count(r) OVER g - 1 AS n, sum(r) OVER g - r AS s, sum(r * r) OVER g - r * r AS ss FROM p WINDOW g AS {GROUP}), m AS (SELECT *, s / nullif(n, 0) AS peer_mean, sqrt(greatest((ss - s * s / nullif(n, 0)) / nullif(n - 1, 0), 0)) AS sd FROM q) ;;
SELECT code, date, peer_mean, CASE WHEN n > 1 AND r IS NOT NULL THEN sd END AS peer_std, r - peer_mean AS diff, r / nullif(peer_mean, 0) AS ratio FROM m""", "panel")  # fmt: skip
def x12(d: Data):
    q = panel(d).withColumns({"n": F.count("r").over(by_sector()) - 1, "s": F.sum("r").over(by_sector()) - F.col("r"), "ss": F.sum(F.col("r") * F.col("r")).over(by_sector()) - F.col("r") * F.col("r")})
    m = q.withColumn("peer_mean", ratio("s", "n"))
    var = ratio(F.col("ss") - ratio(F.col("s") * F.col("s"), "n"), F.col("n") - 1)
    return m.select("code", "date", "peer_mean", F.when((F.col("n") > 1) & F.col("r").isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("peer_std"), (F.col("r") - F.col("peer_mean")).alias("diff"), ratio("r", "peer_mean").alias("ratio"))


SECTOR = P + ", g AS (SELECT date, sector, median(r) AS s1, median(r_5) AS s5, count(*) AS members, avg(r) AS eq, sum(r * turnover) / nullif(sum(CASE WHEN r IS NOT NULL THEN turnover END), 0) AS cw FROM p GROUP BY date, sector)"


def by_sector_series():
    return Window.partitionBy("sector").orderBy("date")


def sectors(d: Data):
    """One row for each date and sector: median returns of one and five rows, mean and turnover-weighted return, and the number of members."""
    return panel(d).groupBy("date", "sector").agg(F.median("r").alias("s1"), F.median("r_5").alias("s5"), F.count(F.lit(1)).alias("members"), F.avg("r").alias("eq"), ratio(F.sum(F.col("r") * F.col("turnover")), F.sum(F.when(F.col("r").isNotNull(), F.col("turnover")))).alias("cw"))


@query("x13_sector_aggregates", "code date members small", "s1 s5 s_mom s_vol s_z vol_z ema_5 ema_20 gap rel rel_5",
       SECTOR + ", sk AS (SELECT sector AS code, date, s1, s5, members FROM g), " + adjusted_mean("sk", "ema_5", "s1", 2 / 6, "e1") + ", " + adjusted_mean("e1", "ema_20", "s1", 2 / 21, "e2")
       + f""", v AS (SELECT *, {sroll('sum', 's1', 20, 10)} AS s_mom, sqrt(252) * ({sroll('stddev_samp', 's1', 20, 10)}) AS s_vol, {sz('s1', 252, 60)} AS s_z FROM e2), h AS (SELECT *, {sz('s_vol', 252, 60)} AS vol_z, (ema_5 - ema_20) / (abs(ema_20) + 1e-12) AS gap FROM v) ;;
SELECT p.code, p.date, members, members < 3 AS small, s1, s5, s_mom, s_vol, s_z, vol_z, ema_5, ema_20, gap, r - s1 AS rel, r_5 - s5 AS rel_5 FROM p JOIN h ON p.date = h.date AND p.sector = h.code""", "panel")  # fmt: skip
def x13(d: Data):
    """Series of each sector, and the code's returns against them."""
    # a sector's series is the code of the recursions: its group has one row for each date
    k = sectors(d).select(F.col("sector").alias("code"), "date", "s1", "s5", "members")
    h = recursive.smooth(k, {"ema_5": ("s1", recursive.span(5)), "ema_20": ("s1", recursive.span(20))}, adjust=True)
    h = h.withColumns({"s_mom": roll(F.sum, "s1", 20, 10), "s_vol": roll(F.stddev_samp, "s1", 20, 10) * F.sqrt(F.lit(252.0)), "s_z": zscore("s1", 252, 60)})
    h = h.withColumns({"vol_z": zscore("s_vol", 252, 60), "gap": (F.col("ema_5") - F.col("ema_20")) / (F.abs("ema_20") + EPS)}).withColumnRenamed("code", "sector")
    return panel(d).join(h, ["date", "sector"]).withColumns({"small": F.col("members") < 3, "rel": F.col("r") - F.col("s1"), "rel_5": F.col("r_5") - F.col("s5")})


@query("x14_sector_beta", "code date", "beta alpha z alpha_z",
       SECTOR + f""", j AS (SELECT p.*, eq FROM p JOIN g ON p.date = g.date AND p.sector = g.sector), m AS (SELECT *, {sroll('avg', 'r * eq', 60, 30)} AS xy, {sroll('avg', 'r', 60, 30)} AS x, {sroll('avg', 'eq', 60, 30)} AS y, {sroll('avg', 'eq * eq', 60, 30)} AS yy FROM j),
b AS (SELECT *, (xy - x * y) / (yy - y * y + 1e-12) AS beta FROM m), a AS (SELECT *, x - beta * y AS alpha FROM b) ;;
SELECT code, date, beta, alpha, (beta - avg(beta) OVER {GROUP}) / (stddev_samp(beta) OVER {GROUP} + 1e-8) AS z, (alpha - avg(alpha) OVER {GROUP}) / (stddev_samp(alpha) OVER {GROUP} + 1e-8) AS alpha_z FROM a""", "panel")  # fmt: skip
def x14(d: Data):
    j = panel(d).join(F.broadcast(sectors(d).select("date", "sector", "eq")), ["date", "sector"])  # one row for each date and sector
    m = lambda c: roll(F.avg, c, 60, 30)
    b = j.withColumn("beta", (m(F.col("r") * F.col("eq")) - m("r") * m("eq")) / (m(F.col("eq") * F.col("eq")) - m("eq") * m("eq") + EPS))
    b = b.withColumn("alpha", m("r") - F.col("beta") * m("eq"))
    z = lambda c: (F.col(c) - F.avg(c).over(by_sector())) / (F.stddev_samp(c).over(by_sector()) + 1e-8)
    return b.select("code", "date", "beta", "alpha", z("beta").alias("z"), z("alpha").alias("alpha_z"))


#: Inputs of the statistics within sectors: returns known before the row, volume, volatility, RSI and slope.
WITHIN = ("r1", "r5", "r10", "volume", "vol", "rsi", "slope")


def _inside(x: str) -> str:
    return f"({x} - avg({x}) OVER {GROUP}) / (stddev_samp({x}) OVER {GROUP} + 1e-12) AS {x}_z"


@query("x15_within_sector", "code date valid", "r1_demeaned r5_demeaned r10_demeaned " + " ".join(f"{x}_z" for x in WITHIN) + " r1_rank volume_rank r1_x_volume r1_x_vol",
       P.replace("p AS (", "q AS (", 1) + ", " + MOVES.replace("FROM bars", "FROM q")
       + f""", k AS (SELECT *, {slag('r')} AS r1, {slag('r_5', 5)} AS r5, close / {slag('close', 10)} - 1 AS r_10, {sroll('stddev_samp', 'r', 20, 10)} AS vol, 100 - 100 / (1 + ({sroll('avg', 'up', 14)}) / (({sroll('avg', 'down', 14)}) + 1e-12)) AS rsi, (close - {slag('close', 5)}) / (5 * close) AS slope FROM mv),
l AS (SELECT *, {slag('r_10', 10)} AS r10 FROM k), z AS (SELECT *, {', '.join(map(_inside, WITHIN))}, {', '.join(f'{x} - avg({x}) OVER {GROUP} AS {x}_demeaned' for x in ('r1', 'r5', 'r10'))}, {srank01('r1', 'date, sector')} AS r1_rank, {srank01('volume', 'date, sector')} AS volume_rank, CAST(count(r1) OVER {GROUP} >= 2 AS INT) AS valid FROM l) ;;
SELECT *, r1_z * volume_z AS r1_x_volume, r1_z * vol_z AS r1_x_vol FROM z""", "panel bars")  # fmt: skip
def x15(d: Data):
    """Deviations, z values and ranks within date and sector of lagged returns (h rows back for h rows), volume, volatility, RSI and slope."""
    m = with_moves(panel(d)).withColumn("r_10", F.col("close") / lag("close", 10) - 1)
    rsi = 100 - 100 / (1 + roll(F.avg, "up", 14) / (roll(F.avg, "down", 14) + EPS))
    l = m.withColumns({"r1": lag("r"), "r5": lag("r_5", 5), "r10": lag("r_10", 10), "vol": roll(F.stddev_samp, "r", 20, 10), "rsi": rsi, "slope": (F.col("close") - lag("close", 5)) / (5 * F.col("close"))})  # noqa: E741
    centred = lambda x: F.col(x) - F.avg(x).over(by_sector())
    z = l.withColumns({f"{x}_z": centred(x) / (F.stddev_samp(x).over(by_sector()) + EPS) for x in WITHIN} | {f"{x}_demeaned": centred(x) for x in ("r1", "r5", "r10")})
    z = z.withColumns({"r1_rank": rank01("r1", "date", "sector"), "volume_rank": rank01("volume", "date", "sector"), "valid": (F.count("r1").over(by_sector()) >= 2).cast("int")})
    return z.withColumns({"r1_x_volume": F.col("r1_z") * F.col("volume_z"), "r1_x_vol": F.col("r1_z") * F.col("vol_z")})


@query("x16_group_relative", "code date", "rel mom_lag",
       P.replace("FROM panel", "FROM panel") + f""", c AS (SELECT *, sector % 17 AS g17 FROM p), g AS (SELECT date, g17, avg(r) AS gr FROM c GROUP BY ALL), h AS (SELECT *, {sroll('sum', 'gr', 20, 10, by='g17')} AS mom FROM g), k AS (SELECT *, {slag('mom', by='g17')} AS mom_lag FROM h) ;;
SELECT code, c.date, r - gr AS rel, mom_lag FROM c JOIN k ON c.date = k.date AND c.g17 = k.g17""", "panel")  # fmt: skip
def x16(d: Data):
    c = panel(d).withColumn("g17", F.col("sector") % 17)
    w = Window.partitionBy("g17").orderBy("date")
    g = c.groupBy("date", "g17").agg(F.avg("r").alias("gr"))
    g = g.withColumn("mom", roll(F.sum, "gr", 20, 10, w)).withColumn("mom_lag", lag("mom", 1, w))
    return c.join(g, ["date", "g17"]).withColumn("rel", F.col("r") - F.col("gr"))


@query("x17_sector_series", "date sector", "eq cw eq_mom cw_mom",
       SECTOR + f" ;; SELECT date, sector, eq, cw, {sroll('sum', 'eq', 20, 10, by='sector')} AS eq_mom, {sroll('sum', 'cw', 20, 10, by='sector')} AS cw_mom FROM g", "panel")
def x17(d: Data):
    return sectors(d).withColumns({"eq_mom": roll(F.sum, "eq", 20, 10, by_sector_series()), "cw_mom": roll(F.sum, "cw", 20, 10, by_sector_series())})


@query("x18_sector_encoding", "code date kept other", "frequency",
       """s AS (SELECT sector, count(*) / (SELECT count(*) FROM panel)::DOUBLE AS share FROM panel GROUP BY sector) ;;
SELECT code, date, CASE WHEN share >= 0.05 THEN p.sector END AS kept, CAST(share < 0.05 AS INT) AS other, count(*) OVER (PARTITION BY date, p.sector) / (count(*) OVER (PARTITION BY date))::DOUBLE AS frequency FROM panel p JOIN s ON p.sector = s.sector""", "panel")  # fmt: skip
def x18(d: Data):
    p = d.panel
    total = p.agg(F.count(F.lit(1)).alias("n"))
    shares = p.groupBy("sector").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(total)).select("sector", (F.col("m") / F.col("n")).alias("share"))
    counts = F.count(F.lit(1))
    return p.join(shares, "sector").select("code", "date", F.when(F.col("share") >= 0.05, F.col("sector")).alias("kept"), (F.col("share") < 0.05).cast("int").alias("other"), (counts.over(by_sector()) / counts.over(by_date())).alias("frequency"))


@query("x19_relative_to_sector", "code date", "rel z", P + f" ;; SELECT code, date, r - avg(r) OVER {GROUP} AS rel, (r - avg(r) OVER {GROUP}) / (stddev_pop(r) OVER {GROUP} + 1e-8) AS z FROM p", "panel")
def x19(d: Data):
    rel = F.col("r") - F.avg("r").over(by_sector())
    return panel(d).select("code", "date", rel.alias("rel"), (rel / (F.stddev_pop("r").over(by_sector()) + 1e-8)).alias("z"))


@query("x20_target_encoding", "code date fold", "encoded",
       f"""y AS (SELECT code, date, sector, code % 5 AS fold, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS y FROM panel),
g AS (SELECT date, sector, fold, sum(y) AS s, count(y) AS n FROM y GROUP BY ALL), a AS (SELECT date, sector, sum(s) AS s, sum(n) AS n FROM g GROUP BY ALL), m AS (SELECT date, sum(s) AS s, sum(n) AS n FROM a GROUP BY ALL),
gc AS (SELECT date, sector, fold, sum(s) OVER w AS s, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY sector, fold ORDER BY date)), ac AS (SELECT date, sector, sum(s) OVER w AS s, sum(n) OVER w AS n FROM a WINDOW w AS (PARTITION BY sector ORDER BY date)), mc AS (SELECT date, sum(s) OVER w AS s, sum(n) OVER w AS n FROM m WINDOW w AS (ORDER BY date)),
j1 AS (SELECT y.*, ac.s AS as_, ac.n AS an FROM y ASOF LEFT JOIN ac ON y.sector = ac.sector AND y.date > ac.date), j2 AS (SELECT j1.*, gc.s AS gs, gc.n AS gn FROM j1 ASOF LEFT JOIN gc ON j1.sector = gc.sector AND j1.fold = gc.fold AND j1.date > gc.date), j3 AS (SELECT j2.*, mc.s / nullif(mc.n, 0) AS mean FROM j2 ASOF LEFT JOIN mc ON j2.date > mc.date) ;;
SELECT code, date, fold, (coalesce(as_, 0) - coalesce(gs, 0) + 100 * mean) / (coalesce(an, 0) - coalesce(gn, 0) + 100) AS encoded FROM j3""", "panel")  # fmt: skip
def x20(d: Data):
    from ..operators.asof import asof_join

    y = d.panel.select("code", "date", "sector", (F.col("code") % 5).alias("fold"), (lead("close") / F.col("close") - 1).alias("y"))
    sums = (F.sum("y").alias("s"), F.count("y").alias("n"))
    so_far = lambda df, *k: df.select("date", *k, *[F.sum(c).over(Window.partitionBy(*k).orderBy("date")).alias(c) for c in ("s", "n")])
    by_fold = so_far(y.groupBy("date", "sector", "fold").agg(*sums), "sector", "fold")
    by_sector = so_far(y.groupBy("date", "sector").agg(*sums), "sector")
    overall = y.groupBy("date").agg(*sums)
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row for each date
    overall = overall.select("date", ratio(F.sum("s").over(w), F.sum("n").over(w)).alias("mean"))
    j = asof_join(y, by_sector.select("sector", "date", F.col("s").alias("as_"), F.col("n").alias("an")), ["sector"], "date", ["as_", "an"], strict=True)
    j = asof_join(j, by_fold.select("sector", "fold", "date", F.col("s").alias("gs"), F.col("n").alias("gn")), ["sector", "fold"], "date", ["gs", "gn"], strict=True)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.join(overall, "date").withColumn("encoded", (z("as_") - z("gs") + 100 * F.col("mean")) / (z("an") - z("gn") + 100))


FEATURES = ("close", "volume", "turnover")


@query("x21_sector_mean_relative", "code date", " ".join(f"{c}_mean {c}_rel" for c in FEATURES),
       "SELECT code, date, " + ", ".join(f"avg({c}) OVER {GROUP} AS {c}_mean, {c} - avg({c}) OVER {GROUP} AS {c}_rel" for c in FEATURES) + " FROM panel", "panel")
def x21(d: Data):
    means = {c: F.avg(c).over(by_sector()) for c in FEATURES}
    return d.panel.select("code", "date", *[x for c, m in means.items() for x in (m.alias(f"{c}_mean"), (F.col(c) - m).alias(f"{c}_rel"))])


@query("x22_dispersion", "date", "std var r9010 r7525 roll_std",
       P + f", g AS (SELECT date, stddev_samp(r) AS std, var_samp(r) AS var, quantile_cont(r, 0.9) - quantile_cont(r, 0.1) AS r9010, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS r7525 FROM p GROUP BY date) ;; SELECT *, CASE WHEN count(std) OVER o >= 10 THEN avg(std) OVER o END AS roll_std FROM g WINDOW o AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "panel")
def x22(d: Data):
    q = F.percentile("r", F.array(*[F.lit(x) for x in (0.9, 0.1, 0.75, 0.25)]))
    g = panel(d).groupBy("date").agg(F.stddev_samp("r").alias("std"), F.var_samp("r").alias("var"), q.alias("q"))
    g = g.select("date", "std", "var", (F.col("q")[0] - F.col("q")[1]).alias("r9010"), (F.col("q")[2] - F.col("q")[3]).alias("r7525"))
    return g.withColumn("roll_std", roll(F.avg, "std", 20, 10, Window.orderBy("date")))  # one row for each date


@query("x23_segments", "code date", "seg_mean seg_std rel_pos liquidity sector_mom sector_mom_rank",
       SECTOR + f""", h AS (SELECT date, sector, {sroll('sum', 'eq', 20, 10, by='sector')} AS sector_mom FROM g), k AS (SELECT *, {srank01('sector_mom', 'date')} AS sector_mom_rank FROM h) ;;
SELECT p.code, p.date, avg(close) OVER m AS seg_mean, stddev_samp(close) OVER m AS seg_std, (close - avg(close) OVER m) / (stddev_samp(close) OVER m + 1e-8) AS rel_pos, ln(1 + ({sroll('avg', 'turnover', 20, 5, order='p.date')})) AS liquidity, sector_mom, sector_mom_rank
FROM p LEFT JOIN k ON k.date = p.date AND k.sector = p.sector WINDOW m AS (PARTITION BY p.date, market)""", "panel")  # fmt: skip
def x23(d: Data):
    """Place within the market of the date, liquidity, and the momentum of the sector with its rank among sectors."""
    m = Window.partitionBy("date", "market")
    mean, std = F.avg("close").over(m), F.stddev_samp("close").over(m)
    mom = sectors(d).select("date", "sector", roll(F.sum, "eq", 20, 10, by_sector_series()).alias("sector_mom")).withColumn("sector_mom_rank", rank01("sector_mom", "date"))
    own = panel(d).select("code", "date", "sector", mean.alias("seg_mean"), std.alias("seg_std"), ((F.col("close") - mean) / (std + 1e-8)).alias("rel_pos"), F.log(1 + roll(F.avg, "turnover", 20, 5)).alias("liquidity"))
    return own.join(mom, ["date", "sector"], "left")


@query("x24_rank_buckets", "code size_bucket liquidity_bucket", "",
       f"""c AS (SELECT code, avg(turnover) AS t, avg(close * volume) AS cap FROM bars GROUP BY code), q AS (SELECT code, {srank01('t', '1')} AS rt, {srank01('cap', '1')} AS rc FROM c) ;;
SELECT code, CASE WHEN rc >= 0.7 THEN 'large' WHEN rc >= 0.3 THEN 'mid' ELSE 'small' END AS size_bucket, CASE WHEN rt >= 0.7 THEN 'high' WHEN rt >= 0.3 THEN 'mid' ELSE 'low' END AS liquidity_bucket FROM q""")  # fmt: skip
def x24(d: Data):
    c = d.bars.groupBy("code").agg(F.avg("turnover").alias("t"), F.avg(F.col("close") * F.col("volume")).alias("cap")).withColumn("_all", F.lit(1))  # one row for each code
    bucket = lambda r, names: F.when(r >= 0.7, names[0]).when(r >= 0.3, names[1]).otherwise(names[2])
    return c.select("code", bucket(rank01("cap", "_all"), ("large", "mid", "small")).alias("size_bucket"), bucket(rank01("t", "_all"), ("high", "mid", "low")).alias("liquidity_bucket"))
