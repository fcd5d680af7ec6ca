"""Business-day arithmetic on a calendar of (date, idx, next_date), one row for each business date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join


def next_business_day(df: DataFrame, column: str, calendar: DataFrame, name: str) -> DataFrame:
    """df with the first business date after column (null after the end of the calendar).

    Done on the distinct dates of the column, which are few, then joined back.
    """
    days = df.select(F.col(column).alias("date")).distinct()
    known = asof_join(days, calendar.select("date", F.col("date").alias(name)), [], "date", [name], forward=True, strict=True)
    return df.join(known.withColumnRenamed("date", column), column, "left")


def shifted(df: DataFrame, column: str, calendar: DataFrame, k: int, name: str) -> DataFrame:
    """df with the business date k after (k < 0: before) column, which must be one itself."""
    here = calendar.select(F.col("date").alias(column), "idx")
    there = calendar.select((F.col("idx") - k).alias("idx"), F.col("date").alias(name))
    return df.join(here.join(there, "idx", "left").drop("idx"), column, "left")
