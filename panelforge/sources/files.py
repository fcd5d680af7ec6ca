"""Files of panels: scans, text quotes, shards by month, upserts and merges."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

#: Texts that stand for missing values.
MISSING = ("", "-", "--", "---")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir; where that is unset, below the warehouse of a local session (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "files")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, paths: list[str], where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Filter and column list reach the Parquet reader."""
    df = spark.read.parquet(*paths)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


#: Fields of quotes, and what their records name them; volume and turnover are counts.
FIELDS = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "turnover": "TurnoverValue"}


def parse_quotes(raw: DataFrame) -> DataFrame:
    """Typed quotes (lower-case names, fixed order) from records of texts: of each field the adjusted value, or the raw one where that is missing.

    Signs for missing values and texts that are no numbers become null; columns that the records lack are null, too.
    """

    def number(name: str, kind: str):
        if name not in raw.columns:
            return F.lit(None).cast(kind)
        text = F.trim(F.col(name))
        return F.when(~text.isin(*MISSING), text).try_cast(kind)

    fields = [F.coalesce(number(f"Adjustment{c}", "double"), number(c, "double")).alias(name) for name, c in FIELDS.items()]
    return raw.select(number("Code", "long").alias("code"), F.to_date(F.try_to_timestamp("Date", F.lit("yyyy-MM-dd"))).alias("date"), *fields, number("AdjustmentFactor", "double").alias("factor"))


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, CSV (with header) or JSON lines by suffix."""
    reader = spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.json(path) if path.endswith(".json") else reader.parquet(path)


def write_any(df: DataFrame, name: str) -> str:
    path = f"{shared_folder(df.sparkSession)}/{name}"
    if name.endswith(".csv"):
        df.write.option("header", True).csv(path)
    elif name.endswith(".json"):
        df.write.json(path)
    else:
        df.write.parquet(path)
    return path


def write_panel(df: DataFrame, name: str) -> str:
    """Parquet (zstd) by year."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.withColumn("year", F.year("date")).repartition("year").write.option("compression", "zstd").partitionBy("year").parquet(path)
    return path


def fingerprint(schema: StructType) -> str:
    """A hash of names and types in their order."""
    return hashlib.md5(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema).encode()).hexdigest()


def checksum(df: DataFrame) -> Column:
    """An aggregate over all columns that does not depend on the order of rows; decimal numbers count to six places."""

    def text(f: StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (FloatType, DoubleType)):
            c = c.cast("decimal(38,6)")
        return F.coalesce(c.cast("string"), F.lit("-"))

    row = F.substring(F.md5(F.concat_ws(":", *[text(f) for f in df.schema])), 1, 13)
    return F.sum(F.conv(row, 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")


def metadata(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.lit(len(df.columns)).alias("columns"), F.lit(fingerprint(df.schema)).alias("schema"))


def _index(shards: DataFrame) -> DataFrame:
    """(yyyymm, rows, first, last, checksum, schema) of every shard."""
    own = shards.drop("yyyymm")
    return shards.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), checksum(own).alias("checksum")).withColumn("schema", F.lit(fingerprint(own.schema)))


def append_months(df: DataFrame, path: str, keys: list[str]) -> None:
    """Add df to the shards by month below path, and their rows, dates, checksum and schema to the index beside them.

    Of equal keys the row of df stays. A month whose shard has another schema is
    written anew. Shards of other months are not touched.
    """
    spark = df.sparkSession
    new = df.withColumn("yyyymm", F.date_format("date", "yyyyMM").cast("int"))
    index = read_index(spark, path)
    if index is not None:
        months = new.select("yyyymm").distinct()
        alike = index.where(F.col("schema") == fingerprint(df.schema)).join(months, "yyyymm", "left_semi").select("yyyymm")
        kept = stored(alike)
        if not kept.isEmpty():
            old = spark.read.schema(new.schema).parquet(f"{path}/shards").join(kept, "yyyymm", "left_semi")
            new = upsert(old.select(new.columns), new, keys)
    whole = stored(new.select(*df.columns, "yyyymm"))
    dynamic = lambda x: x.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("yyyymm")
    dynamic(whole.repartition("yyyymm")).parquet(f"{path}/shards")
    dynamic(_index(whole)).parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("rows long, first date, last date, checksum decimal(38,0), schema string, yyyymm int").parquet(f"{path}/index")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def collect_months(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of a date window: shards of other months are never opened, and those read are checked against the index first."""
    months = F.col("yyyymm").between(int(start[:7].replace("-", "")), int(end[:7].replace("-", "")))
    shards = spark.read.parquet(f"{path}/shards").where(months)
    index = read_index(spark, path).where(months)
    names = ["yyyymm", "rows", "checksum", "schema"]
    wrong = index.select(*names).exceptAll(_index(shards).select(*names))
    if bad := [r["yyyymm"] for r in wrong.select("yyyymm").distinct().limit(12).collect()]:
        raise ValueError(f"shards differ from their index: {sorted(bad)}")
    return shards.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("yyyymm")


def extract_range(df: DataFrame, start: str, end: str, name: str) -> str:
    """Write the rows of a date range (bounds included); fails if there are none."""
    part = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    path = f"{shared_folder(df.sparkSession)}/{name}"
    part.write.parquet(path)
    if df.sparkSession.read.parquet(path).isEmpty():
        raise ValueError(f"no rows between {start} and {end}")
    return path


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, those of new before those of old: one hash aggregate, no sort."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_source").alias("_row")).select(*keys, "_row.*")


def merge_chunks(chunks: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Chunks clipped to their declared ranges, with the columns and types of the first: missing ones null, others dropped."""
    schema = chunks[0][0].schema
    parts = []
    for df, start, end in chunks:
        clipped = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        parts.append(clipped.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def merge_datasets(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Shared columns of all datasets; of equal keys the row of the earliest dataset."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    rest = [c for c in shared if c not in keys]
    every = frames[0].select(*shared, F.lit(0).alias("_source"))
    for i, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.select(*shared, F.lit(i).alias("_source")))
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_source").alias("_row")).select(*keys, "_row.*")
