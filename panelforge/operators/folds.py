"""Folds over the dates of a panel. Fold tables are a few rows for each fold; rows meet them by date, never by pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward(calendar: DataFrame, train: int, test: int, step: int, gap: int, expanding: bool = False, least_test: int | None = None) -> DataFrame:
    """(fold, part, from, to) in date numbers; least_test lets the last test part be shorter."""
    n = calendar.agg(F.max("idx").alias("n"))
    least = test if least_test is None else least_test
    folds = n.select("n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))).alias("fold"))
    start = F.col("fold") * step
    stop = F.least(start + train + gap + test, F.col("n"))
    folds = folds.withColumns({"_a": F.lit(1) if expanding else start + 1, "_b": start + train, "_c": start + train + gap + 1, "_e": stop}).where(F.col("_e") - F.col("_c") + 1 >= least)
    return _parts(folds)


def backward(calendar: DataFrame, count: int, test: int, train: int, embargo: int) -> DataFrame:
    """Folds built from the last date backwards."""
    n = calendar.agg(F.max("idx").alias("n"))
    folds = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("fold"))
    first = F.col("n") - F.col("fold") * test - (test - 1)
    return _parts(folds.withColumns({"_a": F.greatest(F.lit(1), first - embargo - train), "_b": first - embargo - 1, "_c": first, "_e": F.col("n") - F.col("fold") * test}))


def _parts(folds: DataFrame) -> DataFrame:
    parts = F.explode(F.array(F.struct(F.lit("train").alias("part"), F.col("_a").alias("from"), F.col("_b").alias("to")), F.struct(F.lit("test").alias("part"), F.col("_c").alias("from"), F.col("_e").alias("to"))))
    return folds.select("fold", parts.alias("p")).select("fold", "p.*")


def placed(df: DataFrame, calendar: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the folds and parts of their date."""
    dates = folds.where("from <= to").select("fold", "part", F.explode(F.sequence("from", "to")).alias("idx"))
    return df.join(dates.join(calendar.select("date", "idx"), "idx"), "date")


def assigned(df: DataFrame, calendar: DataFrame, **how) -> DataFrame:
    return placed(df, calendar, forward(calendar, **how))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


def blocks_of(calendar: DataFrame, blocks: int) -> DataFrame:
    """Dates with the number of their contiguous block."""
    n = calendar.agg(F.max("idx").alias("n"))
    return calendar.join(F.broadcast(n)).select("date", "idx", F.floor((F.col("idx") - 1) * blocks / F.col("n")).alias("block"))


def _outside(calendar: DataFrame, blocks: int, before: int, after: int) -> DataFrame:
    """(fold, date): the dates that a fold may train on."""
    b = blocks_of(calendar, blocks)
    ranges = b.groupBy("block").agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))  # one row for each block
    return b.join(F.broadcast(ranges.withColumnRenamed("block", "fold"))).where((F.col("idx") < F.col("_a") - before) | (F.col("idx") > F.col("_b") + after)).select("fold", "date")


def purged(df: DataFrame, calendar: DataFrame, blocks: int, purge: int, least_train: int) -> DataFrame:
    train = df.join(_outside(calendar, blocks, purge, purge), "date").groupBy("fold").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least_train)
    valid = df.join(blocks_of(calendar, blocks), "date").groupBy(F.col("block").alias("fold")).agg(F.count(F.lit(1)).alias("rows"))
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


def purged_groups(df: DataFrame, calendar: DataFrame, blocks: int, purge: int, embargo: int) -> DataFrame:
    """Also without the groups (quarters) that the validation block touches."""
    x = df.join(blocks_of(calendar, blocks), "date").withColumn("grp", F.year("date") * 4 + F.quarter("date"))
    seen = x.select(F.col("block").alias("fold"), "grp").distinct()
    train = x.join(_outside(calendar, blocks, purge, embargo), "date").join(seen, ["fold", "grp"], "left_anti")
    train = train.groupBy("fold").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("train"))
    return train.unionByName(x.groupBy(F.col("block").alias("fold")).agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("valid")))


def by_ratio(df: DataFrame, train: float, valid: float) -> DataFrame:
    """Sizes of a split of the rows by date at shares of their number."""
    by_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("c"))  # one row for each date
    upto, n = F.sum("c").over(Window.orderBy("date")), F.sum("c").over(Window.partitionBy())
    part = F.when(F.col("upto") <= train * F.col("n"), "train").when(F.col("upto") <= (train + valid) * F.col("n"), "valid").otherwise("test")
    p = by_date.withColumns({"upto": upto, "n": n}).withColumn("part", part)
    return p.groupBy("part").agg(F.sum("c").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
