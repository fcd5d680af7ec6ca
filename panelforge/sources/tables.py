"""Tables of a data folder, and the panel that the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


PARTITIONS = "spark.sql.shuffle.partitions"
#: Records of a table for each shuffle partition at most, and those up to which Spark may join partitions.
RECORDS, SMALL = 250_000, 2_000_000
_COUNTED: dict[tuple[str, str, str], int] = {}


class Data:
    """The tables of one folder, and the frames derived from them (built on each use, all lazy)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A table. The shuffle partitions of the session rise with its records (and never fall), so that what a task holds does not grow with the tables."""
        wanted = -(-self.records(name) // RECORDS)
        if wanted > int(self.spark.conf.get(PARTITIONS)):
            self.spark.conf.set(PARTITIONS, str(wanted))
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def records(self, name: str) -> int:
        """The records of a table, counted once from the footers of its files."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _COUNTED:
            _COUNTED[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet").count()
        return _COUNTED[key]

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """df dealt by keys. Partitions of a given number stay as they are; those of small tables may be joined to larger ones."""
        return df.repartition(int(self.spark.conf.get(PARTITIONS)), *keys) if self.records("lineitem") > SMALL else df.repartition(*keys)

    @property
    def trades(self) -> DataFrame:
        """Raw records: code, part, date, price, quantity, amount and the order of the record."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("code"),
            F.col("l_partkey").alias("part"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("amount"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )

    @property
    def bars(self) -> DataFrame:
        """Daily bars (code, date, open, high, low, close, volume, turnover), dealt by code: most windows are those of a code."""
        return self.dealt(self.trades, "code").groupBy("code", "date").agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("quantity").alias("volume"),
            F.sum("amount").alias("turnover"),
        )

    @property
    def dim(self) -> DataFrame:
        """Attributes of the codes: sector and market."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("sector"), F.col("n_regionkey").alias("market"))
        return self.table("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("sector"), F.col("s_acctbal").alias("balance")).join(nation, "sector", "left")

    @property
    def panel(self) -> DataFrame:
        """Bars with the attributes of their code."""
        return self.bars.join(self.dim, "code", "left")

    @property
    def market(self) -> DataFrame:
        """One market series: the mean price of each date."""
        return self.trades.groupBy("date").agg(F.avg("price").alias("m_close"))

    @property
    def calendar(self) -> DataFrame:
        """Business dates with their number from 1 and the next date."""
        by_date = Window.orderBy("date")
        return self.trades.select("date").distinct().select("date", F.row_number().over(by_date).alias("idx"), F.lead("date").over(by_date).alias("next_date"))

    @property
    def dense(self) -> DataFrame:
        """(code, date, r): log returns of every business date from a code's second bar on, 0 where it has no bar (the last price stands)."""
        w = Window.partitionBy("code").orderBy("idx")
        calendar = self.calendar.select("date", F.col("idx").alias("_i"))
        last = calendar.agg(F.max("_i").alias("_last"))
        calendar = F.broadcast(calendar)  # one row for each date
        at = self.bars.join(calendar, "date").select("code", "close", F.col("_i").alias("idx"))
        steps = at.withColumns({"_r": F.log(F.col("close") / F.lag("close").over(w)), "_next": F.lead("idx").over(w)}).where("_r is not null")
        held = steps.join(F.broadcast(last)).select("code", "idx", "_r", F.explode(F.sequence("idx", F.coalesce(F.col("_next") - 1, "_last"))).alias("_i"))  # _last is one row
        return held.join(calendar, "_i").select("code", "date", F.when(F.col("_i") == F.col("idx"), F.col("_r")).otherwise(0.0).alias("r"))

    @property
    def snapshots(self) -> DataFrame:
        """Published records of codes (the code of a customer is mapped onto the codes of the bars)."""
        n = self.table("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.table("orders").join(F.broadcast(n)).select(
            ((F.col("o_custkey") - 1) % F.col("n") + 1).alias("code"),
            F.to_date("o_orderdate").alias("published"),
            F.col("o_orderkey").alias("rec"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )

    @property
    def ev(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("eid"), F.col("user_id").alias("id"), "ts", F.col("event_type").alias("type"), "value", "props")

    @property
    def pred(self) -> DataFrame:
        """Predictions of three sets, a deterministic expression of the bars, the next return as label, and that of the code's index as step.

        The index is the mean price of all that was traded in the last 60 bars, from the 60th bar on: bars mix parts of very different prices.
        """
        w = Window.partitionBy("code").orderBy("date")
        recent = w.rowsBetween(-59, 0)
        level = F.when(F.count(F.lit(1)).over(recent) == 60, F.sum("turnover").over(recent) / F.sum("volume").over(recent))
        base = self.panel.select(
            "code", "date", "sector", "market", "close", "volume", "turnover",
            (F.lead("close").over(w) / F.col("close") - 1).alias("label"), level.alias("level"),
            (F.col("close") / F.lag("close").over(w) - 1).alias("ret"),
        )
        base = base.withColumn("step", F.lead("level").over(w) / F.col("level") - 1)
        sets = base.where("label is not null").withColumn("set", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        score = (F.col("code") * 37 + F.datediff("date", F.lit("1995-01-01")) * 11 * F.col("set")) % 101 / 101.0 + F.lit(0.1) * F.coalesce(F.signum("label"), F.lit(0.0))
        return sets.withColumn("score", score)
