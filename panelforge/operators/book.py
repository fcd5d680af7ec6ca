"""Weights, trades, costs and returns of portfolios, for all strategies and dates at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(scores: DataFrame, holdings: DataFrame, keys: list[str], enter: int, leave: int) -> DataFrame:
    """Names held that rank inside leave, and others inside enter; the best enter of them."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "code")
    q = scores.join(holdings.select(*keys, "code", F.lit(True).alias("was_held")), [*keys, "code"], "left").withColumn("was_held", F.coalesce("was_held", F.lit(False)))
    q = q.withColumn("_rank", F.row_number().over(w)).where(F.when(F.col("was_held"), F.col("_rank") <= leave).otherwise(F.col("_rank") <= enter))
    return q.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= enter).drop("_rank")


def trades(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, code, dw, w, label): weights and their change from the strategy's date before, names that leave included."""
    by_date = Window.partitionBy(*keys).orderBy("date")
    dates = weights.select(*keys, "date").distinct().withColumn("_next", F.lead("date").over(by_date))
    before = weights.join(dates, [*keys, "date"]).where("_next is not null").select(*keys, F.col("_next").alias("date"), "code", F.col("w").alias("_pw"))
    both = weights.join(before, [*keys, "date", "code"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(*keys, "date", "code", (zero("w") - zero("_pw")).alias("dw"), zero("w").alias("w"), zero("label").alias("label"))


def daily_returns(weights: DataFrame, keys: list[str], cost: float) -> DataFrame:
    g = trades(weights, keys).groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("label")).alias("gross"), (F.sum(F.abs("dw")) / 2).alias("turnover"))
    return g.withColumn("net", F.col("gross") - cost * F.col("turnover"))


def limited_step(trade: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Weights after a step towards the target that keeps the turnover within limit."""
    turnover = F.sum(F.abs("dw")).over(Window.partitionBy(*keys)) / 2
    alpha = F.when(F.col("turnover") > limit, limit / F.col("turnover")).otherwise(1.0)
    return trade.withColumn("turnover", turnover).withColumn("step", F.col("w") - F.col("dw") + F.col("dw") * alpha)


def cost_aware_targets(scores: DataFrame, holdings: DataFrame, keys: list[str], k: int, multiplier: int, penalty: float, limit: float, least_alpha: float) -> DataFrame:
    """Equal weights of the k best of a candidate pool after a penalty for names not held, and the share of the way that the turnover limit allows."""
    w = Window.partitionBy(*keys)
    pool = scores.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "code"))).where(F.col("_r") <= k * multiplier)
    pool = pool.withColumn("_s", F.col("score") - F.when(F.col("was_held"), 0.0).otherwise(penalty))
    chosen = pool.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("_s"), "code")), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_r") <= k)
    target = chosen.select(*keys, "code", (1.0 / F.least(F.lit(k), F.col("_n"))).alias("w"))
    both = target.join(holdings, [*keys, "code"], "full").fillna(0.0, ["w", "hw"])
    turnover = F.sum(F.abs(F.col("w") - F.col("hw"))).over(w) / 2
    both = both.withColumn("turnover", turnover)
    alpha = F.greatest(F.lit(least_alpha), F.least(F.lit(1.0), F.when(F.col("turnover") > 0, limit / F.col("turnover")).otherwise(1.0)))
    return both.withColumn("alpha", alpha).withColumn("target", F.col("hw") + F.col("alpha") * (F.col("w") - F.col("hw")))


def commission(amount: Column) -> Column:
    """Tiers of the fee rate, with a least and a largest fee."""
    rate = F.when(amount < 10000, 0.0010).when(amount < 50000, 0.0008).otherwise(0.0005)
    return F.greatest(F.lit(100.0), F.least(F.lit(5000.0), amount * rate))


def costs(df: DataFrame, amount: Column, adv: Column) -> DataFrame:
    """Slippage of 5 to 20 basis points by participation, plus commission."""
    bps = F.least(F.lit(20.0), 5.0 + 100.0 * F.try_divide(amount, adv) / 20)
    c = df.withColumn("bps", bps).withColumn("total", amount * F.col("bps") / 10000 + commission(amount))
    return c.withColumn("round_trip", 2 * F.col("total"))


def performance(cost: float = 0.0010) -> list[Column]:
    """Aggregates over r (return), dd (log drawdown) and turnover."""
    n = F.count(F.lit(1))
    down = F.least(F.col("r"), F.lit(0.0))
    year = F.sqrt(F.lit(252.0))
    return [
        n.alias("days"),
        (F.exp(F.sum(F.log(1 + F.col("r"))) * 252 / n) - 1).alias("annual"),
        (F.try_divide(F.avg("r"), F.stddev_pop("r")) * year).alias("sharpe"),
        (F.try_divide(F.avg("r"), F.sqrt(F.avg(down * down))) * year).alias("sortino"),
        (1 - F.exp(F.min("dd"))).alias("max_drawdown"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("turnover").alias("mean_turnover"),
        (F.exp(F.sum(F.log(1 + F.col("r")))) - 1).alias("total"),
        F.try_divide(F.exp(F.sum(F.log(1 + F.col("r"))) * 252 / n) - 1, 1 - F.exp(F.min("dd"))).alias("calmar"),
        (cost * F.sum("turnover")).alias("cost"),
    ]


def risk_neutral(df: DataFrame, keys: list[str], score: str, factors: list[str], group: str, levels: list[Column], alpha: float, gamma: float, cap: float) -> DataFrame:
    """df with neutral: scores less the share gamma of what a ridge regression on factors explains, by keys; and whether it was used.

    Factors are the numeric ones and a column for each level of group (those that
    the lowest group of the keys' rows is not), all standardised, missing values at the
    mean; scores are standardised, too. The normal equations come from one aggregate
    by keys and are solved in batches of keys, so no task holds the rows of a date.
    Dates keep their scores if less than 5 % is explained or no t value reaches 2. What
    is left is centred and scaled to the deviation of the scores, and no score
    moves by more than cap deviations.
    """
    w = Window.partitionBy(*keys)
    columns = [F.col(c).cast("double") for c in factors] + [((F.col(group) == v) & (F.col(group) > F.min(group).over(w))).cast("double") for v in levels]
    n = len(columns)
    raw = df.withColumns({f"_f{i}": c for i, c in enumerate(columns)})

    def standard(c: str) -> Column:
        spread = F.stddev_samp(c).over(w)
        return F.coalesce((F.col(c) - F.avg(c).over(w)) / F.when(spread > 1e-12, spread).otherwise(1.0), F.lit(0.0))

    z = raw.withColumns({f"_x{i}": standard(f"_f{i}") for i in range(n)} | {"_my": F.avg(score).over(w), "_sy": F.stddev_pop(score).over(w)})
    z = z.withColumn("_y", F.when(F.col("_sy") > 1e-6, (F.col(score) - F.col("_my")) / F.col("_sy"))).drop(*[f"_f{i}" for i in range(n)])
    x, y = [F.col(f"_x{i}") for i in range(n)], F.col("_y")
    upper = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)]
    sums = z.where("_y is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.count_distinct(group) - 1 + len(factors)).alias("_p"), F.array(*upper).alias("_xx"), F.array(*[F.sum(c * y) for c in x]).alias("_xy"), F.sum(y * y).alias("_yy"))
    solved = ridge(sums, keys, n, alpha)
    fit = sum((F.get("_beta", i) * x[i] for i in range(n)), F.lit(0.0))
    joined = z.join(solved, keys, "left").withColumn("_h", y - gamma * fit)
    spread = F.stddev_pop("_h").over(w)
    moved = (F.col("_h") - F.avg("_h").over(w)) * F.when(spread > 1e-6, F.col("_sy") / spread).otherwise(1.0) + F.col("_my") - F.col(score)
    bound = cap * F.col("_sy")
    shift = F.when(F.col("_used"), F.greatest(-bound, F.least(bound, moved))).otherwise(0.0)
    return joined.withColumn("neutral", F.col(score) + shift).withColumn("used", F.coalesce("_used", F.lit(False))).select(*df.columns, "neutral", "used")


def ridge(sums: DataFrame, keys: list[str], n: int, alpha: float) -> DataFrame:
    """(keys, _beta, _used): the ridge solutions of sums(keys, _n, _p, _xx (upper triangle), _xy, _yy), a batch of keys at a time."""
    kept = sums.select(*keys).schema
    at = np.triu_indices(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            upper, b = np.stack(pdf["_xx"].to_list()), np.stack(pdf["_xy"].to_list())
            a = np.zeros((len(pdf), n, n))
            a[:, at[0], at[1]] = upper
            a[:, at[1], at[0]] = upper
            beta = np.linalg.solve(a + alpha * np.eye(n), b[..., None])[..., 0]
            rss = pdf["_yy"].to_numpy() - 2 * (beta * b).sum(1) + np.einsum("ki,kij,kj->k", beta, a, beta)
            rows, p = pdf["_n"].to_numpy(), pdf["_p"].to_numpy()
            free = rows - p - 1
            error = np.sqrt((rss / np.maximum(free, 1))[:, None] / (np.einsum("kii->ki", a) + 1e-10))
            t = np.abs(beta / (error + 1e-10)).max(1)
            used = (np.round(1 - rss / pdf["_yy"].to_numpy(), 9) >= 0.05) & ((free <= 0) | (np.round(t, 9) >= 2))
            yield pdf[keys].assign(_beta=list(beta), _used=used)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return sums.mapInPandas(run, f"{types}, _beta array<double>, _used boolean")
