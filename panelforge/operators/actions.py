"""Panel upkeep: missing columns, calendar padding, corporate actions, null rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensure_columns(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """df with every wanted column (type, default) that it lacks, in one projection."""
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (t, v) in wanted.items() if c not in df.columns])


def padded(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Every code on every calendar day of the range; days without a bar are pads."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    grid = bars.select("code").distinct().select("code", days.alias("date"))
    trading = bars.select("date").distinct().withColumn("is_trading_day", F.lit(True))
    return (
        grid.join(bars, ["code", "date"], "left")
        .join(trading, "date", "left")
        .withColumns({"is_calendar_pad": F.col("close").isNull(), "is_trading_day": F.coalesce("is_trading_day", F.lit(False))})
    )


def adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices divided and volumes multiplied by the product of the ratios of all later actions of the code."""
    later = Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    # bars and actions in one stream by code: the log ratios of later dates add up (an action on the date itself does not count)
    both = bars.select("code", "date", "close", "volume").join(actions.groupBy("code", "date").agg(F.sum(F.log("ratio")).alias("_log")), ["code", "date"], "full")
    both = both.withColumn("factor", F.exp(F.coalesce(F.sum("_log").over(later), F.lit(0.0)))).where("close is not null")
    return both.select("code", "date", (F.col("close") / F.col("factor")).alias("close"), (F.col("volume") * F.col("factor")).alias("volume"), "factor")


def null_rates(df: DataFrame) -> DataFrame:
    """(name, null_rate) of every column, in one aggregate."""
    row = df.agg(*[F.struct(F.lit(c).alias("name"), (1 - F.count(c) / F.count(F.lit(1))).alias("null_rate")).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")
