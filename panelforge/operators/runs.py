"""Runs of equal values (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """df with island: a number that rises whenever value differs from the previous row's (or that is null)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumn("_new", F.when(value == before, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
