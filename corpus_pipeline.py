"""Five stages over the documents table: quality, repeated lines, near copies, benchmark leaks, source mix.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs being
all that its predecessor kept, and returns a DataFrame: documents without those
that the stage rejects, with the columns of documents. The last one adds size,
source_size, target, taken and copies. run() writes the result of each stage as
Parquet to the shared folder and reads it back as the next one's documents.

Every stage keeps clean documents as they are. ORACLE_SQL is None, as SQL has no
zstandard dictionaries; tests compare the operators behind the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import stored, table
from panelforge.llm.decontam import decontaminate
from panelforge.llm.jaccard import without_near_copies
from panelforge.llm.linededup import dedup_passages
from panelforge.llm.mixing import mixed
from panelforge.llm.quality import THRESHOLD, fit_quality, quality_score

#: Near copies: shingles of five words, similarity of 4/5 or more.
SHINGLE_WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; null and empty texts have a score, too."""
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality_score(model) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines and repeated runs of over 50 words; those of which nothing remains go, null and empty texts stay."""
    return dedup_passages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id; texts without words, and different texts with null or equal ids, stay."""
    return without_near_copies(docs, SHINGLE_WORDS, NUMERATOR, DENOMINATOR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once (and those without words), with how often they are taken.

    Equal rows share what the mix takes of them, one each. Columns of the
    documents that are named like those of the mix give way to them.
    """
    taken = mixed(docs, table(spark, sf_dir, "labels"))
    key = ["doc_id", "source", "text_hash"]
    numbered = taken.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"))))
    own = ["size", "source_size", "target", "taken"]
    mix = numbered.select(F.struct(*key, "number").alias("at"), F.struct(*own).alias("mix"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    match = F.lit(True)
    for name in (*key, "number"):
        match = match & F.col(name).eqNullSafe(F.col("at")[name])
    copies = F.when(F.col("mix.size") > 0, (F.col("mix.taken") / F.col("mix.size")).cast("long")).otherwise(1)
    joined = rows.join(mix, match).withColumn("copies", copies).where("copies > 0")
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (*own, "copies")], *[F.col("mix")[c].alias(c) for c in own], "copies")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
