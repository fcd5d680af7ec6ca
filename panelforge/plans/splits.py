"""Walk-forward and purged splits over the dates of the panel (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..sources.tables import Data
from .registry import query

DATES = "dt AS (SELECT date, row_number() OVER (ORDER BY date) AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
FOLDS = DATES + ", fo AS (SELECT f AS fold, f * 120 + 1 AS a, f * 120 + 500 AS b, f * 120 + 506 AS c, f * 120 + 625 AS e FROM (SELECT DISTINCT unnest(range(0, CAST((n - 625) // 120 AS BIGINT) + 1)) AS f FROM dt))"


@query("c1_walk_forward", "fold part rows dates first last", "",
       FOLDS + ", p AS (SELECT fold, 'train' AS part, a, b FROM fo UNION ALL SELECT fold, 'test', c, e FROM fo) ;; SELECT fold, part, count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last FROM p JOIN (SELECT b.code, dt.date, dt.idx FROM bars b JOIN dt ON b.date = dt.date) x ON x.idx BETWEEN p.a AND p.b GROUP BY fold, part")
def c1(d: Data):
    return folds.sizes(folds.assigned(d.bars, d.calendar, train=500, test=120, step=120, gap=5))


@query("c2_walk_forward_min", "fold part rows dates first last", "",
       DATES + ", fo AS (SELECT f AS fold, f * 300 + 505 AS c, least(f * 300 + 804, n) AS e FROM (SELECT DISTINCT n, unnest(range(0, CAST(n // 300 AS BIGINT) + 1)) AS f FROM dt) WHERE least(f * 300 + 804, n) - (f * 300 + 505) + 1 >= 60), p AS (SELECT fold, 'train' AS part, 1 AS a, c - 5 AS b FROM fo UNION ALL SELECT fold, 'test', c, e FROM fo) ;; SELECT fold, part, count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last FROM p JOIN (SELECT b.code, dt.date, dt.idx FROM bars b JOIN dt ON b.date = dt.date) x ON x.idx BETWEEN p.a AND p.b GROUP BY fold, part")
def c2(d: Data):
    return folds.sizes(folds.assigned(d.bars, d.calendar, train=500, test=300, step=300, gap=4, expanding=True, least_test=60))


@query("c3_backward_folds", "fold part rows dates first last", "",
       DATES + ", fo AS (SELECT f AS fold, n - f * 200 - 199 AS c, n - f * 200 AS e FROM (SELECT DISTINCT n, unnest(range(0, 5)) AS f FROM dt)), p AS (SELECT fold, 'train' AS part, greatest(1, c - 10 - 600) AS a, c - 11 AS b FROM fo UNION ALL SELECT fold, 'test', c, e FROM fo) ;; SELECT fold, part, count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last FROM p JOIN (SELECT b.code, dt.date, dt.idx FROM bars b JOIN dt ON b.date = dt.date) x ON x.idx BETWEEN p.a AND p.b GROUP BY fold, part")
def c3(d: Data):
    return folds.sizes(folds.placed(d.bars, d.calendar, folds.backward(d.calendar, 5, 200, 600, 10)))


BLOCKS = DATES + ", bk AS (SELECT date, idx, ((idx - 1) * 5) // n AS block FROM dt), bo AS (SELECT block, min(idx) AS a, max(idx) AS b FROM bk GROUP BY block)"


@query("c4_purged_group_split", "fold part rows", "",
       BLOCKS + ", x AS (SELECT b.code, bk.idx, bk.block, year(b.date) * 4 + quarter(b.date) AS grp FROM bars b JOIN bk ON b.date = bk.date), v AS (SELECT DISTINCT block AS fold, grp FROM x), t AS (SELECT bo.block AS fold, x.* FROM bo JOIN x ON x.idx < bo.a - 5 OR x.idx > bo.b + 10), k AS (SELECT t.* FROM t ANTI JOIN v ON t.fold = v.fold AND t.grp = v.grp) ;; SELECT fold, 'train' AS part, count(*) AS rows FROM k GROUP BY fold UNION ALL SELECT block, 'valid', count(*) FROM x GROUP BY block")
def c4(d: Data):
    return folds.purged_groups(d.bars, d.calendar, blocks=5, purge=5, embargo=10)


@query("c5_purged_kfold", "fold part rows", "",
       BLOCKS + ", x AS (SELECT b.code, bk.idx, bk.block FROM bars b JOIN bk ON b.date = bk.date) ;; SELECT bo.block AS fold, 'train' AS part, count(*) AS rows FROM bo JOIN x ON x.idx < bo.a - 30 OR x.idx > bo.b + 30 GROUP BY bo.block HAVING count(*) >= 100 UNION ALL SELECT block, 'valid', count(*) FROM x GROUP BY block")
def c5(d: Data):
    return folds.purged(d.bars, d.calendar, blocks=5, purge=30, least_train=100)


@query("c6_ratio_split", "part rows first last", "",
       "r AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS n, count(*) AS c FROM bars GROUP BY date), p AS (SELECT *, CASE WHEN upto <= 0.7 * n THEN 'train' WHEN upto <= 0.85 * n THEN 'valid' ELSE 'test' END AS part FROM r) ;; SELECT part, CAST(sum(c) AS BIGINT) AS rows, min(date) AS first, max(date) AS last FROM p GROUP BY part")
def c6(d: Data):
    return folds.by_ratio(d.bars, 0.7, 0.15)


@query("c7_gap_check", "fold least gap_days ok", "",
       FOLDS + " ;; SELECT fold, least, y.date - x.date AS gap_days, y.date - x.date >= least AS ok FROM fo JOIN dt x ON x.idx = fo.b JOIN dt y ON y.idx = fo.c, (VALUES (5), (10)) v(least)")
def c7(d: Data):
    """Days between training and test of each fold, against two least gaps, the second of which the folds miss."""
    parts = folds.sizes(folds.assigned(d.bars, d.calendar, train=500, test=120, step=120, gap=5))
    gaps = parts.groupBy("fold").agg(F.datediff(F.min(F.when(F.col("part") == "test", F.col("first"))), F.max(F.when(F.col("part") == "train", F.col("last")))).alias("gap_days"))
    return gaps.withColumn("least", F.explode(F.array(F.lit(5), F.lit(10)))).withColumn("ok", F.col("gap_days") >= F.col("least"))
