"""Anomaly scores and ranges of observations (id, eid, ts, x)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored


#: Least share of what two ranges cover that they have in common.
IOU = 0.25


def by_id():
    return Window.partitionBy("id").orderBy("ts", "eid")


def sigmoid(x):
    return 1 / (1 + F.exp(-x))


def mean_shift(o: DataFrame, n: int) -> DataFrame:
    """How much the mean of the n rows after a row differs from that of the n before, in pooled deviations."""
    left, right = by_id().rowsBetween(-n, -1), by_id().rowsBetween(1, n)
    pooled = F.sqrt((F.var_pop("x").over(left) + F.var_pop("x").over(right)) / 2)
    shift = F.abs(F.avg("x").over(right) - F.avg("x").over(left)) / (pooled + 1e-9)
    full = (F.count(F.lit(1)).over(left) == n) & (F.count(F.lit(1)).over(right) == n)
    return o.select("id", "eid", F.when(full, sigmoid(shift - 2)).alias("score"))


def residual_score(f: DataFrame, n: int, least: int) -> DataFrame:
    """Residuals r in deviations (by medians) from the median of the last n rows."""
    w = by_id().rowsBetween(-(n - 1), 0)
    m = f.select("id", "eid", "r", F.percentile("r", 0.5).over(w).alias("med"), F.sort_array(F.collect_list("r").over(w)).alias("a"))
    dev = F.sort_array(F.transform("a", lambda x: F.abs(x - F.col("med"))))
    m = m.withColumn("d", dev).withColumn("k", F.size("d"))
    mad = (F.get("d", F.floor((F.col("k") - 1) / 2).cast("int")) + F.get("d", F.floor(F.col("k") / 2).cast("int"))) / 2
    return m.select("id", "eid", F.when(F.col("r").isNotNull() & (F.col("k") >= least), sigmoid(F.abs(F.col("r") - F.col("med")) / (1.4826 * mad + 1e-9) - 2)).alias("score"))


def spectral_residual(o: DataFrame) -> DataFrame:
    """Saliency of each point of a series: what its log spectrum has beyond a local mean. One pandas group for each id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "eid"])
        x = pdf["x"].to_numpy(float)
        spectrum = np.fft.fft(x)
        size = np.maximum(np.abs(spectrum), 1e-12)
        log = np.log(size)
        local = np.convolve(log, np.ones(3) / 3, mode="same")
        saliency = np.abs(np.fft.ifft(np.exp(log - local) * spectrum / size))
        mean = saliency.mean()
        return pd.DataFrame({"id": pdf["id"], "eid": pdf["eid"], "score": (saliency - mean) / (mean + 1e-12)})

    return o.groupBy("id").applyInPandas(run, "id long, eid long, score double")


def numbered(o: DataFrame) -> DataFrame:
    return o.withColumn("i", F.row_number().over(by_id()))


def runs_of(flagged: DataFrame, least: int) -> DataFrame:
    """(id, a, b, n, top): runs of consecutive numbers i among the rows that are left."""
    g = flagged.withColumn("_island", F.col("i") - F.row_number().over(by_id()))
    return g.groupBy("id", "_island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).where(F.col("n") >= least).drop("_island")


def ranges(o: DataFrame, quantile: float, least: int) -> DataFrame:
    cuts = o.groupBy("id").agg(F.percentile("x", quantile).alias("_cut"))
    return runs_of(numbered(o).join(cuts, "id").where(F.col("x") >= F.col("_cut")), least)


def evaluate(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Ranges of an id that overlap one of the other side; ranges of one side do not overlap, so the last one that begins before decides."""
    p, a = predicted.select("id", "a", "b", F.lit(0).alias("side")), actual.select("id", "a", "b", F.lit(1).alias("side"))
    every = p.unionByName(a)
    w = Window.partitionBy("id").orderBy("a", "side")
    upto, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    other = lambda over, f, c: f(F.when(F.col("side") == 0, F.col(c))).over(over), lambda over, f, c: f(F.when(F.col("side") == 1, F.col(c))).over(over)
    reach = F.when(F.col("side") == 1, other[0](upto, F.max, "b")).otherwise(other[1](upto, F.max, "b"))
    following = F.when(F.col("side") == 1, other[0](after, F.min, "a")).otherwise(other[1](after, F.min, "a"))
    hit = F.coalesce(reach >= F.col("a"), F.lit(False)) | F.coalesce(following <= F.col("b"), F.lit(False))
    h = every.withColumn("hit", hit)
    g = h.groupBy("id").agg(F.count_if(F.col("side") == 0).alias("predicted"), F.count_if(F.col("side") == 1).alias("actual"), F.count_if((F.col("side") == 0) & F.col("hit")).alias("hits"), F.count_if((F.col("side") == 1) & F.col("hit")).alias("_found"))
    return g.where("predicted > 0").withColumns({"precision": F.col("hits") / F.col("predicted"), "recall": F.try_divide("_found", "actual")})


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each predicted range, by falling score, takes the free label that it shares most with; ties go to the first label."""
    for pdf in batches:
        found = []
        for predicted, actual in zip(pdf["predicted"], pdf["actual"], strict=True):
            for kind in ("overlap", "iou"):
                free = [(r["a"], r["b"]) for r in actual]
                for r in predicted:
                    best, at = 0.0, None
                    for k, (a, b) in enumerate(free):
                        common = min(r["b"], b) - max(r["a"], a) + 1
                        value = common if kind == "overlap" else common / (r["b"] - r["a"] + b - a + 2 - common)
                        if common > 0 and value > best:
                            best, at = value, k
                    hit = at is not None and (kind == "overlap" or best >= IOU)
                    if hit:
                        free.pop(at)
                    found.append((kind, -r["down"], hit))
        yield pd.DataFrame(found, columns=["kind", "score", "hit"])


def sweep(predicted: DataFrame, actual: DataFrame, steps: int) -> DataFrame:
    """(kind, step, threshold, selected, matched, labels, precision, recall, area) for thresholds on the score of predicted(id, a, b, score).

    Ranges are matched one to one with those of actual(id, a, b), within an id and by
    falling score: by common length (overlap), or by the share of what both cover
    (iou, IOU at least). A threshold selects a prefix of that order, so one matching
    holds for all of them. Only ranges of one chain of overlaps can meet: chains, not
    ids, are matched in tasks. area is that under precision over recall, by trapezia.
    """
    every = predicted.select("id", "a", "b", (-F.col("score")).alias("down")).unionByName(actual.select("id", "a", "b", F.lit(None).cast("double").alias("down")))
    w = Window.partitionBy("id").orderBy("a", "b")
    begins = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    chains = every.withColumn("_begins", begins).withColumn("chain", F.sum("_begins").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    of = chains.groupBy("id", "chain").agg(
        F.array_sort(F.collect_list(F.when(F.col("down").isNotNull(), F.struct("down", "a", "b")))).alias("predicted"), F.array_sort(F.collect_list(F.when(F.col("down").isNull(), F.struct("a", "b")))).alias("actual")
    )
    matches = of.select("predicted", "actual").mapInPandas(_matched, "kind string, score double, hit boolean")
    labels = actual.agg(F.count(F.lit(1)).alias("labels"))
    at = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(i.alias("step"), (F.lit(0.95) - (i - 1) * (0.9 / (steps - 1))).alias("threshold")))
    tried = matches.withColumn("t", F.explode(at)).select("kind", "t.step", "t.threshold", "hit", (F.round(F.col("score") - F.col("t.threshold"), 9) >= 0).alias("in"))
    counts = tried.groupBy("kind", "step", "threshold").agg(F.count_if("in").alias("selected"), F.count_if(F.col("in") & F.col("hit")).alias("matched"))
    rows = counts.join(F.broadcast(labels)).withColumns({"precision": F.when(F.col("selected") > 0, F.col("matched") / F.col("selected")).otherwise(1.0), "recall": F.when(F.col("labels") > 0, F.col("matched") / F.col("labels")).otherwise(0.0)})  # labels is one row
    # recall rises as the threshold falls; the curve begins at recall 0
    curve = Window.partitionBy("kind").orderBy("step")
    before = lambda c, first: F.coalesce(F.lag(c).over(curve), first)
    piece = (F.col("recall") - before("recall", F.lit(0.0))) * (F.col("precision") + before("precision", F.col("precision"))) / 2
    return rows.withColumn("_piece", piece).withColumn("area", F.sum("_piece").over(Window.partitionBy("kind"))).drop("_piece")


def label_ranges(events: DataFrame, ids: DataFrame, before: int, after: int) -> DataFrame:
    """Ranges around the days of events; events without id hold for all ids: of those, the result has days x ids rows by definition."""
    own = events.where("id is not null")
    days = events.where("id is null").agg(F.collect_set("day").alias("days"))  # days of a calendar
    shared = ids.join(F.broadcast(days)).select("id", F.explode("days").alias("day"))
    return own.unionByName(shared).distinct().select("id", F.date_sub("day", before).alias("start"), F.date_add("day", after).alias("stop"))


def stacked(scores: list[DataFrame], key: str) -> DataFrame:
    """Mean score over all detectors, for keys that all of them have."""
    every = reduce(lambda a, b: a.unionByName(b), [s.groupBy(key).agg(F.avg("score").alias("score")) for s in scores])
    return every.groupBy(key).agg(F.avg("score").alias("stacked"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(scores)).drop("_n")


def platt(df: DataFrame, steps: int) -> DataFrame:
    """Slope and intercept of a logistic calibration of score on y: each Newton step is one aggregate of five sums, at most steps of them, over a stored table."""
    df = stored(df.select("score", "y"))
    slope, intercept, n = 0.0, 0.0, 0
    for _ in range(steps):
        p = sigmoid(slope * F.col("score") + intercept)
        w = p * (1 - p)
        row = df.agg(F.sum((p - F.col("y")) * F.col("score")), F.sum(p - F.col("y")), F.sum(w * F.col("score") * F.col("score")), F.sum(w * F.col("score")), F.sum(w), F.count(F.lit(1))).first()
        n = row[5]
        if not n:
            break
        hessian = np.array([[row[2], row[3]], [row[3], row[4]]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([row[0], row[1]]))
        slope, intercept = slope - float(step[0]), intercept - float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return df.sparkSession.createDataFrame([(n, slope, intercept)], "n long, slope double, intercept double")


def model_errors(long: DataFrame) -> DataFrame:
    e = F.abs(F.col("y") - F.col("p"))
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e / (F.abs("y") + 1e-9)).alias("mape"))
