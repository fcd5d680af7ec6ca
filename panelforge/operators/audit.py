"""Audits of a dataset: each is one aggregate over the rows, whatever the number of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def _long(row: DataFrame) -> DataFrame:
    return row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in row.columns])).alias("s")).select("s.*")


def null_counts(df: DataFrame) -> DataFrame:
    """(name, nulls, rows) of every column."""
    n = F.count(F.lit(1))
    return _long(df.agg(*[F.struct(F.lit(c).alias("name"), (n - F.count(c)).alias("nulls"), n.alias("rows")).alias(c) for c in df.columns]))


def counts(df: DataFrame, rules: dict[str, Column], name: str) -> DataFrame:
    """(name, n): how many rows meet each rule."""
    return _long(df.agg(*[F.struct(F.lit(k).alias(name), F.count_if(c).alias("n")).alias(k) for k, c in rules.items()]))


def coverage(df: DataFrame, blocks: dict[str, tuple[str, str]]) -> DataFrame:
    """(block, coverage, bad) for blocks of (column, SQL condition of a bad value)."""
    n = F.count(F.lit(1))
    return _long(df.agg(*[F.struct(F.lit(k).alias("block"), (F.count(c) / n).alias("coverage"), F.count_if(F.expr(bad)).alias("bad")).alias(k) for k, (c, bad) in blocks.items()]))


def parity(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(name, matched, only_left, only_right, max_diff, mean_diff) of the shared columns, from one full join."""
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    j = a.join(b, keys, "full")
    there, here = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    diff = lambda c: F.abs(F.col(f"_l_{c}") - F.col(f"_r_{c}"))
    row = j.agg(*[F.struct(F.lit(c).alias("name"), F.count_if(there & here).alias("matched"), F.count_if(~here).alias("only_left"), F.count_if(~there).alias("only_right"), F.max(diff(c)).alias("max_diff"), F.avg(diff(c)).alias("mean_diff")).alias(c) for c in columns])
    return _long(row)


def identity(df: DataFrame, whole: str, parts: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(rows, bad, worst) of whole against the product of parts; rows without whole are left out, those without a part are bad."""
    product = F.lit(1.0)
    for p in parts:
        product = product * F.col(p)
    gap = F.abs(F.col(whole) - product)
    wrong = gap.isNull() | (gap > tolerance)
    return df.where(F.col(whole).isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("bad"), F.max(gap).alias("worst"))


def label_mismatches(df: DataFrame, label: str, horizon: int, key: str = "code", tolerance: float = 1e-9) -> DataFrame:
    """(key, mismatches, tail_nulls): labels of a key that differ from the return over the next horizon rows, and those missing in its last rows.

    The return is the product of those rows' own returns, so that a label with another horizon or start is found. A
    label where the rows are too few counts as a mismatch.
    """
    w = Window.partitionBy(key).orderBy("date")
    ahead = w.rowsBetween(1, horizon)
    r = df.withColumns({"_r": F.log(F.col("close") / F.lag("close").over(w)), "_left": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))})
    r = r.withColumn("_true", F.when(F.count("_r").over(ahead) == horizon, F.exp(F.sum("_r").over(ahead)) - 1))
    wrong = F.when(F.col("_true").isNull(), F.col(label).isNotNull()).otherwise(F.col(label).isNull() | (F.abs(F.col(label) - F.col("_true")) > tolerance))
    return r.groupBy(key).agg(F.count_if(wrong).alias("mismatches"), F.count_if(F.col(label).isNull() & (F.col("_left") <= horizon)).alias("tail_nulls"))
