"""Mixing sources to target weights: whole epochs, then Efraimidis-Spirakis sampling of the rest.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share
150 % of all words. A target stops at twice the size of its source; what is cut
off is shared again by weight. A source takes every document as often as the
target holds its whole size, and for the rest of the target documents by rising
exponential key -ln(u) / quality weight until the running sum of their sizes is
as near the rest as it comes (the document on the border is taken if at least
half of it fits). u is a hash of the document id, so reruns agree.

The running sum never meets in one task: keys are cut into slices of a source,
slice totals are summed first, and documents only within their slice.

Edge cases: a null or empty text has size 0 and takes 0; rows with equal ids
have equal u and are ordered by size; a null id hashes like an empty one; null
source is a source of its own; without any word all targets are 0; an empty
table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
#: Efraimidis-Spirakis weights of documents labelled good and bad, and of the others.
GOOD, BAD, PLAIN = 2.0, 0.5, 1.0
ROWS_PER_SLICE = 2000
#: Above so many sources their table is joined by shuffle instead of being broadcast.
BROADCAST_SOURCES = 20_000


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, target): one row for each source of sized(source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    weighed = sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * LIMIT)
    # Caps are met in the order of cap by weight; before a source stand those that are met earlier.
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    weights = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    levels = weighed.withColumn("_left", left).withColumn("_weights", weights)
    levels = levels.withColumn("_capped", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_weight"))
    first = Window.partitionBy()
    free = F.min(F.when(~F.col("_capped"), F.struct(-F.col("_weights"), "_left"))).over(first)
    levels = levels.withColumn("_free", free)
    share = F.col("_weight") * F.col("_free._left") / -F.col("_free.col1")
    return levels.select("source", "source_size", "n_rows", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mixed(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) of every row of docs."""
    ids = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    quality = F.lit(PLAIN)
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        ids = ids.join(known, "doc_id", "left")
        quality = F.when(F.col("_quality") == 1, GOOD).when(F.col("_quality") == 0, BAD).otherwise(PLAIN)
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 13), 16, 10)
    u = (digits.cast("long").cast("double") + 0.5) / float(2**52)
    sized = stored(ids.select("doc_id", "source", "text_hash", "size", (-F.log(u) / quality).alias("_key")))

    sources = stored(targets(sized))
    small = sources.count() <= BROADCAST_SOURCES
    side = sources.select(F.col("source").alias("_source"), "source_size", "n_rows", "target")
    joined = sized.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    slices = F.greatest(F.lit(1), F.floor(F.col("n_rows") / ROWS_PER_SLICE))
    joined = (
        joined.withColumn("_epochs", epochs)
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_slice", F.floor((1 - F.exp(-F.col("_key"))) * slices))
    )
    totals = joined.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("_of"), F.col("_slice").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = joined.join(totals, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", "text_hash")
    earlier = F.col("_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = (earlier + F.col("size") / 2 <= F.col("_rest")).cast("long")
    return placed.withColumn("taken", F.col("size") * (F.col("_epochs") + chosen)).select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH known AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / (CASE WHEN k.q = 1 THEN 2.0::DOUBLE WHEN k.q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents d LEFT JOIN known k ON d.doc_id = k.doc_id),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 2 AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest_words,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_weight
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * rest_weight <= rest_words * w AS is_capped FROM levels),
free AS (SELECT rest_words AS fw, rest_weight AS fr FROM capped WHERE NOT is_capped ORDER BY rest_weight DESC LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE w * fw / fr END AS target
  FROM capped LEFT JOIN free ON true),
placed AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
