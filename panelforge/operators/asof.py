"""As-of joins without a range join: union both sides, order by time, carry the last (or next) snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], forward: bool = False, strict: bool = False, suffix: str = "") -> DataFrame:
    """Every row of left with columns of the last right row of its keys whose time is not later.

    forward takes the first one that is not earlier; strict leaves out equal
    times. Right rows must be unique by keys and time, or any of the tied ones
    is taken. One shuffle by keys; without keys, left must be small (one row
    for each date).
    """
    renamed = {c: c + suffix for c in columns}
    value = F.struct(F.col(time).alias("_time"), *[F.col(c) for c in columns])
    r = right.select(*keys, F.col(time).alias("_at"), value.alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    l = left.select(*keys, F.col(time).alias("_at"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))  # noqa: E741
    # among equal times snapshots come first, unless they must be earlier
    side = F.when(F.col("_left").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    order = [F.col("_at").desc(), side] if forward else [F.col("_at"), side]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionByName(r).withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return found.select("_left.*", *[F.col(f"_hit.{c}").alias(n) for c, n in renamed.items()])
