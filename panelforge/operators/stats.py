"""Statistics of many series at once, keyed by series."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import normal_cdf


def newey_west(x: DataFrame, key: str, lags: int) -> DataFrame:
    """(key, n, mean, lrv): long-run variance of series x(key, date, x, e), e being x less its mean, with Bartlett weights."""
    w = Window.partitionBy(key).orderBy("date")
    lagged = x.select(key, "x", "e", *[F.lag("e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    n = F.count(F.lit(1))
    terms = [F.sum(F.col("e") * F.col("e")) / n, *[2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"_l{k}")), F.lit(0.0)) / n for k in range(1, lags + 1)]]
    return lagged.groupBy(key).agg(n.alias("n"), F.avg("x").alias("mean"), reduce(lambda a, b: a + b, terms).alias("lrv"))


def sharpe_difference(pairs: DataFrame) -> DataFrame:
    """Difference of the Sharpe ratios of a and b, with its standard error from means, deviations and correlation."""
    m = pairs.agg(F.count(F.lit(1)).alias("n"), (F.avg("a") / F.stddev_pop("a")).alias("x"), (F.avg("b") / F.stddev_pop("b")).alias("y"), (F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b"))).alias("r"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    m = m.select("n", (x - y).alias("diff"), F.sqrt((2 - 2 * r + 0.5 * (x * x + y * y - 2 * x * y * r * r)) / F.col("n")).alias("se"))
    return m.withColumn("z", F.col("diff") / F.col("se"))


def deflated_sharpe(x: DataFrame, key: str, benchmark: float) -> DataFrame:
    """Sharpe ratio, skew, kurtosis and the probability that the ratio is above a benchmark."""
    m = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("_mu"), F.stddev_pop("x").alias("_sd"))
    u = (F.col("x") - F.col("_mu")) / F.col("_sd")
    c = x.join(m, key).groupBy(key, "n").agg(F.max(F.col("_mu") / F.col("_sd")).alias("sharpe"), F.avg(F.pow(u, 3)).alias("skew"), F.avg(F.pow(u, 4)).alias("kurt"))
    s = F.col("sharpe")
    spread = F.sqrt(F.greatest(F.lit(1e-9), 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s))
    return c.withColumn("psr", normal_cdf((s - benchmark) * F.sqrt(F.col("n") - 1) / spread))


def block_bootstrap(x: DataFrame, key: str, block: int, reps: int) -> DataFrame:
    """Interval of the mean: replicates draw blocks by hash, so reruns agree; block sums are made once."""
    w = Window.partitionBy(key).orderBy("date")
    b = x.withColumn("_blk", F.floor((F.row_number().over(w) - 1) / block)).groupBy(key, "_blk").agg(F.sum("x").alias("_s"), F.count(F.lit(1)).alias("_c"))
    slots = b.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).select(key, "_k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep")).select(key, "_k", "_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_slot"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "_rep", "_slot", key)), 1, 8), 16, 10).cast("long") % F.col("_k")
    means = slots.select(key, "_rep", drawn.alias("_blk")).join(b, [key, "_blk"]).groupBy(key, "_rep").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    return means.groupBy(key).agg(F.count(F.lit(1)).alias("reps"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix; the cross products come from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b) for a, b in pairs]).first()
    r = np.eye(len(columns))
    for (a, b), v in zip(pairs, row, strict=True):
        i, j = columns.index(a), columns.index(b)
        r[i, j] = r[j, i] = v
    return df.sparkSession.createDataFrame(list(zip(columns, np.diag(np.linalg.inv(r)).tolist(), strict=True)), "name string, vif double")


def overfitting(x: DataFrame, blocks: int) -> DataFrame:
    """(combination, winner, place, logit) of x(strategy, date, x): half of the blocks of dates choose, the other half tests.

    Dates are cut into blocks of equal length; sums of each strategy and block come
    from one aggregate, and every combination of half of the blocks is a row of a
    small table. The strategy of the best Sharpe ratio in those has a place among all
    in the others; logit is that of place / (number + 1). Probability of
    over-fitting is the share of negative ones.
    """
    dates = x.select("date").distinct()
    at = dates.withColumns({"_i": F.row_number().over(Window.orderBy("date")) - 1})  # one row for each date
    of = at.withColumn("block", F.floor(F.col("_i") * blocks / F.count(F.lit(1)).over(Window.partitionBy())).cast("int")).drop("_i")
    sums = x.join(of, "date").groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    halves = [(k, b, b in half) for k, half in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    table = x.sparkSession.createDataFrame(halves, "combination int, block int, chooses boolean")
    m = sums.join(table, "block").groupBy("combination", "strategy", "chooses").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    m = m.withColumn("sharpe", F.round(mean / F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-18))), 9))
    by = Window.partitionBy("combination", "chooses")
    m = m.withColumns({"best": F.row_number().over(by.orderBy(F.desc("sharpe"), "strategy")), "place": F.row_number().over(by.orderBy("sharpe", F.desc("strategy"))), "all": F.count(F.lit(1)).over(by)})
    chosen = m.where("chooses and best = 1").select("combination", F.col("strategy").alias("winner"))
    tested = m.where("not chooses").select("combination", F.col("strategy").alias("winner"), "place", "all")
    share = F.col("place") / (F.col("all") + 1)
    return chosen.join(tested, ["combination", "winner"]).select("combination", "winner", "place", F.log(share / (1 - share)).alias("logit"))


def f_tail(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability above f of an F distribution of a and b degrees of freedom, by the power series of the incomplete beta function."""
    x = a * f / (a * f + b)
    p, q = a / 2, b / 2
    flip = x > (p + 1) / (p + q + 2)  # where the series of the other tail is the shorter one
    x, p, q = np.where(flip, 1 - x, x), np.where(flip, q, p), np.where(flip, p, q)
    log = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        lead = np.exp(p * np.log(x) + q * np.log1p(-x) - np.log(p) - log(p) - log(q) + log(p + q))
    total = term = np.ones_like(x)
    for i in range(100_000):
        term = term * (p + q + i) / (p + 1 + i) * x
        total = total + term
        if not (term > 1e-17 * total).any():
            break
    low = np.where(x > 0, lead * total, 0.0)
    return np.clip(np.where(flip, low, 1 - low), 0.0, 1.0)


def granger(x: DataFrame, key: str, lags: int) -> DataFrame:
    """(key, lag, n, f, p): whether lag values of x before add to lag values of y before, for each series of x(key, y, x, y1.., x1..) and lag up to lags.

    Covariances come from one aggregate by key and lag; both regressions (with a
    constant) are solved from them, a batch of keys at a time.
    """
    names = [f"y{i}" for i in range(1, lags + 1)] + [f"x{i}" for i in range(1, lags + 1)]
    rows = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    whole = reduce(lambda a, b: a & b, [F.col("y").isNotNull(), *[F.col(c).isNotNull() | (F.col("lag") < int(c[1:])) for c in names]])
    used = rows.where(whole).select(key, "lag", "y", *[F.when(F.col("lag") >= int(c[1:]), F.col(c)).otherwise(0.0).alias(c) for c in names])
    m = len(names)
    at = np.triu_indices(m)
    upper = [F.covar_pop(names[i], names[j]) for i, j in zip(*at, strict=True)]
    sums = used.groupBy(key, "lag").agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("yy"), F.array(*upper).alias("cc"), F.array(*[F.covar_pop(c, "y") for c in names]).alias("cy"))
    sums = sums.where(F.col("n") > 2 * F.col("lag") + 10)
    order = np.array([int(c[1:]) for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            c = np.zeros((len(pdf), m, m))
            c[:, at[0], at[1]] = c[:, at[1], at[0]] = np.stack(pdf["cc"].to_list())
            b, lag, n = np.stack(pdf["cy"].to_list()), pdf["lag"].to_numpy(), pdf["n"].to_numpy()

            def left(active: np.ndarray) -> np.ndarray:
                """What the active columns leave of the variance; the others get equations of their own."""
                both = active[:, :, None] & active[:, None, :]
                a = np.where(both, c, 0.0) + np.where(active, 0.0, 1.0)[:, :, None] * np.eye(m)
                right = np.where(active, b, 0.0)
                return pdf["yy"].to_numpy() - (np.linalg.solve(a, right[..., None])[..., 0] * right).sum(1)

            ok = np.linalg.cond(np.where((order <= lag[:, None])[:, :, None] & (order <= lag[:, None])[:, None, :], c, np.eye(m))) < 1e12
            pdf, c, b, lag, n = pdf[ok], c[ok], b[ok], lag[ok], n[ok]
            if not len(pdf):
                continue
            active = order <= lag[:, None]
            r0, r1 = left(active & (np.arange(m) < lags)), left(active)
            free = n - 2 * lag - 1
            f = (r0 - r1) / lag / (r1 / free)
            yield pd.DataFrame({key: pdf[key], "lag": lag, "n": n, "f": f, "p": f_tail(np.maximum(f, 0), lag.astype(float), free.astype(float))})

    return sums.mapInPandas(run, f"`{key}` {x.schema[key].dataType.simpleString()}, lag int, n long, f double, p double")
