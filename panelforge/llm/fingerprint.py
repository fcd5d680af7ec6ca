"""Quartile bucket digests of documents, and their likeness.

All byte triplets of a text are hashed to 256 buckets and counted. A bucket's
code is the quarter (0 to 3) that its count falls in among the counts of all
buckets, so that a digest is 256 two-bit codes and one code for the length on a
logarithmic scale. The difference of two digests adds up the distances of the
codes (the largest, 3, counts twice) and of the length codes (capped); the
likeness is 1 minus the difference over its largest possible value.

Edge cases: null and empty texts have the digest of no triplets; equal texts
have equal digests; repeated rows and equal ids are ordered by text; null ids
come first; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

BUCKETS = 256
LENGTH_CAP = 12
#: Largest difference: every bucket 3 apart, which counts as 6, and the length cap.
LARGEST = BUCKETS * 6 + LENGTH_CAP
WEIGHT = np.array([0, 1, 2, 6])


def codes(text: str) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(raw) < 3:
        return np.zeros(BUCKETS, dtype=np.int8), len(raw)
    b = raw.astype(np.uint32)
    hashed = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(24)
    counts = np.bincount(hashed, minlength=BUCKETS)
    quarters = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.searchsorted(quarters, counts, side="left").astype(np.int8), 2 + int(4 * np.log2(len(raw)))


def digest(text: str) -> str:
    """Two hex digits of length code, then 128 of bucket codes."""
    quarters, length = codes(text)
    q = quarters.reshape(-1, 4).astype(np.uint8)
    return bytes([min(length, 255)]).hex() + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes().hex()


def unpacked(fingerprint: str) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return np.stack([raw[1:] >> 6, raw[1:] >> 4 & 3, raw[1:] >> 2 & 3, raw[1:] & 3], axis=1).ravel().astype(np.int8), int(raw[0])


def likeness(a: str, b: str) -> float:
    """0 (as different as can be) to 1 (equal digests)."""
    (x, m), (y, n) = unpacked(a), unpacked(b)
    return 1.0 - float(WEIGHT[np.abs(x - y)].sum() + min(LENGTH_CAP, abs(m - n))) / LARGEST


def edited(text: str, following: str) -> str:
    """text, with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each text and the one that follows by ascending doc_id (the last is followed by the first).

    The ids are cut into blocks of about equal numbers of rows by quantiles.
    Every block gets, after its own rows, a copy of the first row of the next
    block, so texts are shuffled once and the order never meets in one task.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * partitions(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    bounds = np.array(cuts)
    # ids as non-null numbers: null ids come first
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"), dtype="int32")

    first = {r["_block"]: r["_first"] for r in rows.select(number.alias("_n")).withColumn("_block", block_of("_n")).groupBy("_block").agg(F.min("_n").alias("_first")).collect()}
    order = sorted(first)
    opens = {first[b]: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def sent_to(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(), side="right").tolist()
        return pd.Series([[b, opens[i]] if i in opens else [b] for i, b in zip(ids.tolist(), own, strict=True)])

    sent = rows.select("doc_id", "text", F.posexplode(sent_to(number)).alias("_pos", "block")).withColumn("copy", F.col("_pos") > 0)
    dealt = sent.select("doc_id", "text", "block", "copy").repartition(partitions(spark), "block").sortWithinPartitions("block", "copy", "doc_id", "text")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("next_text", pa.string())])
        held = None
        for batch in batches:
            ids, texts, after = [], [], []
            for i, text, block, copy in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is not None:
                    ids.append(held[0])
                    texts.append(held[1])
                    after.append(text)
                held = None if copy else (i, text, block)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(after, pa.string())], schema=schema)

    return dealt.mapInArrow(pair, "doc_id long, text string, next_text string")


def fingerprints(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            out = []
            for i, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                changed = edited(text, following)
                a, b, c = digest(text), digest(changed), digest(following)
                out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=list(names))

    return pairs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(with_next(table(spark, sf_dir, "documents")))
