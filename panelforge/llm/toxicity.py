"""Toxicity by compression distance: windows of a text under two dictionaries.

The ordinary dictionary holds the words of most ordinary texts, the toxic one the
same and, nearest to the window, the segments of toxic texts that are
over-represented there against ordinary texts. Every window of words of a text is
compressed with both. What the toxic dictionary saves is about zero bytes on
ordinary windows and several bytes where a window repeats toxic segments. The
savings of all windows of a text, counted above byte thresholds, enter a
calibration fitted on labelled texts that its dictionaries have not seen: the
sample, of whose near copies one stays, is cut into FOLDS parts, each measured
with dictionaries made of the others; the final ones come from all of it. (Why
they are not made by zstandard's own trainer: see the README.)

Every window starts with a fixed anchor that both dictionaries contain: without
it zstandard stores most such short windows raw and the lengths say nothing.

Edge cases: null and empty texts have no window and get the score of no saving;
equal texts get equal scores; very long texts are cut into windows like others;
an empty table gives an empty result; without labels of both classes every score
is the smoothed share of label 1. Only doc_id and text are read, so further
columns never matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .labelled import labelled, remainder
from .logistic import Logistic
from .shingles import shingle_set

WINDOW_WORDS = 12
BASE_WORDS = 3000
TOXIC_SEGMENTS = 400
PREFIXES = (4, 5, 6, 7, 8, 9)
ANCHOR = b"0123456789 zqjxkv anchor of every window 98765 "
PUNCTUATION = b".,;:!?|%*$&#\"'()"
LEVEL = 9
FOLDS = 3
#: Bytes saved by a window, from which on it counts.
STEPS = (2, 3, 4, 5, 7)
#: Bound of the fit: labelled rows.
MAX_DOCS = 12_000
THRESHOLD = 0.3


def words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def segments(text: str) -> dict[bytes, bool]:
    """Words without punctuation (True) and beginnings of words that are none of them (False): what can mark a word as toxic."""
    found = {}
    for word in set(words(text)):
        word = word.strip(PUNCTUATION)
        if len(word) >= 3:
            found[word] = True
            for k in PREFIXES:
                if len(word) > k:
                    found.setdefault(word[:k], False)
    return found


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    calibration: Logistic

    def _sizers(self):
        made = self.__dict__.get("_made")
        if made is None:
            made = []
            for raw in (self.ordinary, self.toxic):
                parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=parameters)
                made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)
            self.__dict__["_made"] = made
        return made

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves, for every window of the whole text."""
        plain, toxic = self._sizers()
        found = words(text or "")
        windows = (ANCHOR + b" ".join(found[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(found), WINDOW_WORDS))
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows] or [0], dtype=float)

    def features(self, texts) -> np.ndarray:
        rows = np.empty((len(texts), 6 + 2 * len(STEPS)))
        for i, text in enumerate(texts):
            s = np.sort(self.savings(text))[::-1]
            over = [(s >= t).sum() for t in STEPS]
            rows[i] = [s[0], s[:3].mean(), s[:8].mean(), s.mean(), np.log1p(max(0.0, s.sum())), np.log(len(s)), *np.log1p(over), *(np.array(over) / len(s))]
        return rows

    def score(self, texts) -> np.ndarray:
        return self.calibration.predict(self.features(texts)) if len(texts) else np.zeros(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def segment_counts(rows: DataFrame) -> DataFrame:
    """(segment, whole, toxic, ordinary) of rows(_fold, _t, _y): arrays of the numbers of texts in each fold that have the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for fold, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts.update((s, whole, fold, y) for s, whole in segments(text).items())
            if len(counts) > 500_000:
                yield listed(counts)
                counts = Counter()
        yield listed(counts)

    def listed(counts: Counter) -> pa.RecordBatch:
        columns = [[k[i] for k in counts] for i in range(4)]
        types = (pa.binary(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(list(counts.values()), pa.int64())], names=["segment", "whole", "fold", "y", "n"])

    found = rows.select("_fold", "_t", "_y").mapInArrow(run, "segment binary, whole boolean, fold int, y int, n long")
    of = lambda y: F.array(*[F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)) for k in range(FOLDS)])
    counted = found.groupBy("segment", "whole").agg(of(1).alias("toxic"), of(0).alias("ordinary"))
    # segments of toxic texts, and words that may be among the frequent ones
    return counted.where("aggregate(toxic, 0L, (a, x) -> a + x) >= 3 or (whole and aggregate(ordinary, 0L, (a, x) -> a + x) >= 3)")


def dictionaries(counts: DataFrame, n_toxic: list[int], n_ordinary: list[int], without: int | None) -> tuple[bytes, bytes]:
    """(toxic, ordinary) of the texts of all folds but one: segments by rising significance of their larger share in toxic texts, behind the frequent words."""
    folds = [k for k in range(FOLDS) if k != without]
    total = lambda name: sum((F.col(name)[k] for k in folds), F.lit(0))
    n, m = (float(max(1, sum(c[k] for k in folds))) for c in (n_toxic, n_ordinary))
    rows = counts.select("segment", "whole", total("toxic").alias("a"), total("ordinary").alias("b"))
    frequent = [bytes(r[0]) for r in rows.where("whole and b > 0").orderBy(F.desc("b"), "segment").limit(BASE_WORDS).select("segment").collect()]
    p = (F.col("a") + F.col("b")) / (n + m)
    z = (F.col("a") / n - F.col("b") / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    # words and equal beginnings are one segment; a text has it as one of the two
    merged = rows.groupBy("segment").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3").withColumn("z", z).where("z >= 4")
    best = [(bytes(r["segment"]), r["z"]) for r in merged.orderBy(F.desc("z"), "segment").limit(TOXIC_SEGMENTS).collect()]
    least = best[0][1] / 5 if best else 0.0
    best = sorted(((s, v) for s, v in best if v >= least), key=lambda x: (x[1], x[0]))
    marks = [s for s, v in best if not any(t != s and t.startswith(s) and w >= 0.9 * v for t, w in best)]
    base = b" ".join(frequent[::-1]) + b" "
    return base + b" ".join(marks) + b" " + ANCHOR, base + ANCHOR


def _without_copies(rows: DataFrame) -> DataFrame:
    """One of the labelled texts with one smallest shingle hash: (near) copies would make their words look toxic or ordinary."""

    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(t, 3) for t in texts)
        return pd.Series([int(s[0].astype(np.int64)) if len(s) else 0 for s in sets], dtype="int64")

    first = rows.groupBy(smallest("_t").alias("_m")).agg(F.min(F.struct("_h", "_t", "_y")).alias("_r"))
    return first.select("_r.*")


def fit(rows: DataFrame) -> ToxicityModel:
    """The model of labelled rows(_h, _t, _y): texts stay in the tasks, the driver gets segments and features."""
    sample = stored(_without_copies(rows).withColumn("_fold", F.pmod(F.xxhash64("_h", F.lit(3)), F.lit(FOLDS)).cast("int")))
    sizes = {(r["_fold"], r["_y"]): r["count"] for r in sample.groupBy("_fold", "_y").count().collect()}
    n_toxic, n_ordinary = ([sizes.get((k, y), 0) for k in range(FOLDS)] for y in (1, 0))
    counts = stored(segment_counts(sample))
    of_fold = [ToxicityModel(*dictionaries(counts, n_toxic, n_ordinary, k), Logistic()) for k in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [of_fold[k].features([t])[0].tolist() for k, t in zip(folds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(made, pa.list_(pa.float64()))], names=["h", "y", "x"])

    measured = sample.select("_fold", "_t", "_h", "_y").mapInArrow(measure, "h long, y int, x array<double>").collect()  # a row of numbers for each text of the sample
    measured.sort()
    model = ToxicityModel(*dictionaries(counts, n_toxic, n_ordinary, None), Logistic())
    model.calibration.fit(np.array([r["x"] for r in measured]).reshape(len(measured), 6 + 2 * len(STEPS)), np.array([float(r["y"]) for r in measured]))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_docs: int = MAX_DOCS) -> ToxicityModel:
    keep = remainder("doc_id", 4) != 2 if keep is None else keep
    return fit(labelled(docs, labels, "toxic", keep, max_docs))


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch.tolist()), dtype="float64")

    return score(F.col(text))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        toxicity_score(model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
