"""Selections of a date: top k, percentiles, sides; rows by key; correlations of many columns."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import correlation
from ..sources.files import stored


def ranked(df: DataFrame, score: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """rank (1 for the best; ties by code) and the number n of rows within by."""
    return df.withColumns({"rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "code")), "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})


def top_k(df: DataFrame, score: str, k: int | None = None, ratio: float = 0.1, by: Sequence[str] = ("date",)) -> DataFrame:
    """The k best within by, or a share of them, at least one."""
    size = F.lit(k) if k else F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("n")))
    return ranked(df, score, by).where(F.col("rank") <= size)


def above_percentile(df: DataFrame, score: str, ratio: float, least: int, by: Sequence[str] = ("date",)) -> DataFrame:
    """Rows at or above the (1 - ratio) quantile within by; the best ones where those are too few."""
    cuts = df.groupBy(*by).agg(F.percentile(score, 1 - ratio).alias("cut"))
    r = ranked(df, score, by).join(cuts, list(by)).withColumn("above", F.col(score) >= F.col("cut"))
    return r.withColumn("m", F.count_if("above").over(Window.partitionBy(*by))).where(F.when(F.col("m") >= least, F.col("above")).otherwise(F.col("rank") <= least))


def long_short(df: DataFrame, score: str, ratio: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """The best share within by long, the worst short, equally weighted on each side."""
    r = ranked(df, score, by).withColumn("low", F.row_number().over(Window.partitionBy(*by).orderBy(score, "code")))
    k = F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("n")))
    r = r.withColumn("side", F.when(F.col("rank") <= k, "long").when(F.col("low") <= k, "short")).where("side is not null")
    return r.withColumn("weight", F.when(F.col("side") == "long", 1.0).otherwise(-1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by, "side")))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: a hash aggregate over structs instead of a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, "_row.*")


def global_rank(df: DataFrame, column: str, name: str, slices: int = 256, cuts: list[float] | None = None) -> DataFrame:
    """df with the average rank of column over all rows, without a sort in one task.

    Distinct values are counted, cut into slices by approximate quantiles,
    ranked within their slice and shifted by what lies in the slices below. cuts
    are such quantiles, where they are known.
    """
    cuts = sorted(set(cuts if cuts is not None else df.approxQuantile(column, [i / slices for i in range(1, slices)], 0.2 / slices)))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    slice_ = F.size(F.filter(bounds, lambda c: c <= F.col("_v")))
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", slice_)
    below = values.groupBy("_slice").agg(F.sum("_n").alias("_m"))  # one row for each slice
    below = below.select("_slice", F.coalesce(F.sum("_m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = F.sum("_n").over(Window.partitionBy("_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.join(F.broadcast(below), "_slice").select("_v", (F.col("_below") + inside - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None, slices: int = 64) -> DataFrame:
    """(by, q): the exact quantiles of value at shares, with linear interpolation, by group or of all rows.

    No task holds the values of a group: distinct values are counted, cut into
    slices at the marks of a mergeable sketch, and slices are counted; only those in
    which a quantile lies are put in order. Groups without values have no row.
    """
    key = F.lit(0) if by is None else F.col(by)
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(key.alias("_by"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    marks = F.percentile_approx("_v", [i / slices for i in range(1, slices)], F.lit(20 * slices))
    cuts = counts.groupBy(F.col("_by").alias("_of")).agg(F.array_distinct(marks).alias("_cuts"), F.sum("_n").alias("_all"))
    sliced = counts.join(cuts, F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "_v", "_n", "_all", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slice"))
    sums = sliced.groupBy("_by", "_slice").agg(F.sum("_n").alias("_m"), F.max("_all").alias("_all"))
    upto = F.sum("_m").over(Window.partitionBy("_by").orderBy("_slice"))
    at = [F.lit(q) * (F.col("_all") - 1) for q in shares]
    # the two values around each quantile, counted from 0, and their weights
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.floor(p) + up).alias("k"), (p - F.floor(p) if up else 1 - (p - F.floor(p))).alias("w")) for i, p in enumerate(at) for up in (0, 1)])
    inside = sums.withColumn("_below", upto - F.col("_m"))
    inside = inside.select("_by", "_slice", "_below", F.filter(wanted, lambda t: (t["w"] > 0) & (t["k"] >= F.col("_below")) & (t["k"] < F.col("_below") + F.col("_m"))).alias("_wanted")).where(F.size("_wanted") > 0)
    chosen = sliced.alias("s").join(inside.alias("t"), F.col("s._by").eqNullSafe(F.col("t._by")) & (F.col("s._slice") == F.col("t._slice"))).select("s._by", "s._slice", "_v", "_n", "_below", "_wanted")
    running = chosen.withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy("_by", "_slice").orderBy("_v")))
    hits = running.select("_by", "_v", F.explode(F.filter("_wanted", lambda t: (t["k"] < F.col("_upto")) & (t["k"] >= F.col("_upto") - F.col("_n")))).alias("t"))
    each = hits.groupBy("_by", "t.i").agg(F.sum(F.col("t.w") * F.col("_v")).alias("_x"))
    out = each.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("i", "_x"))).alias("_q")).select("_by", F.col("_q._x").alias("q"))
    return out.select("q") if by is None else out.withColumnRenamed("_by", by)


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman correlation of every pair of columns, in one aggregate over the ranks."""
    ranks = stored(df.select(*columns))
    slices = 256
    cuts = ranks.approxQuantile(columns, [i / slices for i in range(1, slices)], 0.2 / slices)  # of all columns in one pass
    for c, own in zip(columns, cuts, strict=True):
        ranks = global_rank(ranks, c, f"rank_{c}", slices, own)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = ranks.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(f"rank_{a}", f"rank_{b}").alias("rho")).alias(f"{a}_{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")


def slopes(bars: DataFrame) -> DataFrame:
    """Slope of the close over days for each code, as a grouped function."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["day"].to_numpy(float), pdf["close"].to_numpy(float)
        x = x - x.mean()
        total = (x * x).sum()
        return pd.DataFrame({"code": [pdf["code"].iloc[0]], "n": [len(pdf)], "slope": [(x * y).sum() / total if total else np.nan]})

    days = bars.select("code", F.datediff("date", F.lit("1995-01-01")).alias("day"), "close")
    return days.groupBy("code").applyInPandas(fit, "code long, n long, slope double").withColumn("slope", F.nanvl("slope", F.lit(None).cast("double")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
