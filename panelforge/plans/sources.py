"""Reading and writing panels (S rows). Files go below the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import lag
from ..operators import select
from ..sources import files
from ..sources.tables import Data
from .registry import query


def _cents(c: str):
    """Prices cut to cents."""
    return F.floor(F.col(c) * 100 + 1e-6) / 100


@query("s1_pruned_scan", "l_orderkey l_linenumber", "l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'", "")
def s1(d: Data):
    return files.scan(d.spark, [f"{d.folder}/lineitem.parquet"], "l_quantity > 45 and l_returnflag = 'R'", ["l_orderkey", "l_linenumber", "l_quantity"])


def _quote_sql(c: str) -> str:
    """Even codes are adjusted by one half; of codes with rest 1 of 6 there is no open price."""
    value = f"CASE WHEN code % 2 = 0 THEN floor({c} * 50 + 1e-6) / 100 ELSE floor({c} * 100 + 1e-6) / 100 END"
    return f"CASE WHEN code % 6 = 1 THEN NULL ELSE {value} END AS open" if c == "open" else f"{value} AS {c}"


@query("s2_parse_quotes", "code date", "open high low close volume turnover factor",
       f"SELECT code, date, {', '.join(map(_quote_sql, files.FIELDS))}, CASE WHEN code % 2 = 0 THEN 0.5 END AS factor FROM bars")
def s2(d: Data):
    # raw records: text in every column, with signs for missing values
    sign = F.element_at(F.array(F.lit("-"), F.lit(""), F.lit("---")), (F.dayofmonth("date") % 3 + 1).cast("int"))
    text = lambda c, share: F.format_string("%.2f", F.floor(F.col(c) * share + 1e-6) / 100)
    raw = [F.when(F.col("code") % 6 == 1, sign).otherwise(text(c, 100)) if c == "open" else text(c, 100) for c in files.FIELDS]
    adjusted = [F.when(F.col("code") % 2 == 0, text(c, 50)).otherwise(sign) for c in files.FIELDS]
    names = list(files.FIELDS.values())
    records = d.bars.select(
        F.col("code").cast("string").alias("Code"), F.date_format("date", "yyyy-MM-dd").alias("Date"), F.when(F.col("code") % 2 == 0, " 0.5").otherwise("n/a").alias("AdjustmentFactor"),
        *[c.alias(n) for c, n in zip(raw, names, strict=True)], *[c.alias(f"Adjustment{n}") for c, n in zip(adjusted, names, strict=True)],
    )
    return files.parse_quotes(records)


@query("s3_read_by_suffix", "code date", "close", "SELECT code, date, floor(close * 100 + 1e-6) / 100 AS close FROM bars")
def s3(d: Data):
    rows = d.bars.select("code", "date", _cents("close").alias("close"))
    parts = [files.read_any(d.spark, files.write_any(rows.where(F.dayofyear("date") % 3 == k), f"side.{suffix}"), "code long, date date, close double") for k, suffix in enumerate(("csv", "json", "parquet"))]
    return select.union_all(parts)


@query("s4_write_panel", "rows first last columns schema", "",
       "SELECT count(*) AS rows, min(date) AS first, max(date) AS last, 8 AS columns, md5('code:bigint,date:date,open:double,high:double,low:double,close:double,volume:double,turnover:double') AS schema FROM bars")
def s4(d: Data):
    path = files.write_panel(d.bars, "panel")
    return files.metadata(d.spark.read.parquet(path).drop("year"))


def _shards(d: Data) -> str:
    """All months, then new prices for the codes with rest 0 of 3."""
    path = files.shared_folder(d.spark)
    rows = d.bars.select("code", "date", _cents("close").alias("close"))
    files.append_months(rows, path, ["code", "date"])
    files.append_months(rows.where("code % 3 = 0 and year(date) >= 1997").withColumn("close", F.col("close") + 1), path, ["code", "date"])
    return path


SHARDS = "sh AS (SELECT code, date, floor(close * 100 + 1e-6) / 100 + CASE WHEN code % 3 = 0 AND year(date) >= 1997 THEN 1 ELSE 0 END AS close FROM bars)"


@query("s5_month_shards", "code date", "close", SHARDS + " ;; SELECT * FROM sh WHERE date BETWEEN DATE '1997-03-10' AND DATE '1999-06-20'")
def s5(d: Data):
    return files.collect_months(d.spark, _shards(d), "1997-03-10", "1999-06-20")


@query("s5_shard_index", "yyyymm rows first last checksum", "",
       SHARDS + " ;; SELECT year(date) * 100 + month(date) AS yyyymm, count(*) AS rows, min(date) AS first, max(date) AS last, CAST(sum(CAST('0x' || substr(md5(code || ':' || date || ':' || CAST(close AS DECIMAL(38, 6))), 1, 13) AS BIGINT)) AS BIGINT) AS checksum FROM sh GROUP BY ALL")
def s5_index(d: Data):
    # the sums of large shards exceed 64 bits, whose last 64 are returned; smaller ones stay as they are
    half, whole = (F.lit(str(2**n)).cast("decimal(38,0)") for n in (63, 64))
    return files.read_index(d.spark, _shards(d)).withColumn("checksum", (F.pmod(F.col("checksum") + half, whole) - half).cast("long"))


@query("s6_date_range", "code date", "close", "SELECT code, date, close FROM bars WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'")
def s6(d: Data):
    return d.spark.read.parquet(files.extract_range(d.bars, "1996-02-01", "1996-12-31", "range"))


@query("s7_upsert", "code date origin", "close",
       "SELECT code, date, CASE WHEN year(date) >= 2000 THEN close * 1.1 ELSE close END AS close, CASE WHEN year(date) >= 2000 THEN 'new' ELSE 'old' END AS origin FROM bars WHERE date < DATE '2000-07-01' OR year(date) >= 2000")
def s7(d: Data):
    cols = ["code", "date", "close"]
    old = d.bars.where(F.col("date") < F.lit("2000-07-01").cast("date")).select(*cols, F.lit("old").alias("origin"))
    new = d.bars.where(F.year("date") >= 2000).select("code", "date", (F.col("close") * 1.1).alias("close"), F.lit("new").alias("origin"))
    return files.upsert(old, new, ["code", "date"])


@query("s8_merge_chunks", "code date extra", "close volume",
       "SELECT code, date, close, CASE WHEN year(date) < 1998 THEN volume END AS volume, NULL::INT AS extra FROM bars WHERE year(date) < 2000")
def s8(d: Data):
    first = d.bars.select("code", "date", "close", "volume", F.lit(None).cast("int").alias("extra")).where(F.year("date") <= 1998)
    second = d.bars.select("date", "code", "close", F.lit("x").alias("unknown")).where(F.year("date") >= 1997)
    return files.merge_chunks([(first, "1990-01-01", "1997-12-31"), (second, "1998-01-01", "1999-12-31")])


@query("s9_merge_datasets", "code date", "close", "SELECT code, date, CASE WHEN year(date) <= 1997 THEN close ELSE close + 1 END AS close FROM bars")
def s9(d: Data):
    a = d.bars.where(F.year("date") <= 1997).select("code", "date", "close", "volume")
    b = d.bars.where(F.year("date") >= 1997).select("date", "code", (F.col("close") + 1).alias("close"), "turnover")
    return files.merge_datasets([a, b], ["code", "date"])
