"""Bounded samples of labelled texts for fitting the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_docs: int) -> DataFrame:
    """(_h, _t, _y) of at most max_docs labelled rows with their whole texts, chosen by a hash of the id, so that reruns agree.

    keep filters the label rows (held-out rows go before anything is learned).
    Rows without id, label or text are left out; of several labels of one id the
    largest counts; equal rows stay one.
    """
    picked = (
        labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
        .withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(11)))
        .orderBy("_h", "doc_id")
        .limit(max_docs)
    )
    texts = docs.select("doc_id", F.col("text").alias("_t")).where("_t is not null")
    return texts.join(F.broadcast(picked), "doc_id").select("_h", "_t", "_y").distinct()  # max_docs rows of three numbers


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_docs: int) -> list[tuple[int, str, int]]:
    """The rows of labelled() on the driver: at most max_docs texts."""
    return sorted(tuple(r) for r in labelled(docs, labels, label, keep, max_docs).collect())
