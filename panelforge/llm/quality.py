"""Quality classifier: zstandard dictionaries of good and bad text, calibrated.

A text is compressed twice, with a dictionary trained on good and one trained
on bad labelled text. The difference of the two sizes, normalised by the length
of the text, is the signal; it and the two normalised sizes enter a logistic
calibration fitted on labelled texts that the dictionaries have not seen.

Edge cases: a null or empty text is scored like the text of no bytes; equal
texts get equal scores; an empty table gives an empty result; without labels
of both classes every score is the smoothed share of label 1 (0.5 without any).
Only doc_id and text are read, so further columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import labelled_sample, remainder
from .logistic import Logistic, quadratic

LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
SAMPLE_BYTES = 512
#: Bound of the fit: labelled rows.
MAX_DOCS = 8000
THRESHOLD = 0.3


def train_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the raw tail of the texts where there are too few to train on."""
    samples = [b[i : i + SAMPLE_BYTES] for b in (t.encode() for t in texts) for i in range(0, len(b), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(samples) or b"\n" * 16)[-DICTIONARY_BYTES:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Logistic

    def _sizers(self):
        made = self.__dict__.get("_made")
        if made is None:
            made = []
            for raw in (self.good, self.bad):
                dictionary = zstandard.ZstdCompressionDict(raw)
                dictionary.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False).compress)
            self.__dict__["_made"] = made
        return made

    def features(self, texts) -> np.ndarray:
        by_good, by_bad = self._sizers()
        rows = np.empty((len(texts), 4))
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            n, g, b = len(raw) + 16, len(by_good(raw)), len(by_bad(raw))
            rows[i] = (g - b) / n, g / n, b / n, np.log(n)
        return quadratic(rows)

    def score(self, texts) -> np.ndarray:
        return self.calibration.predict(self.features(texts)) if len(texts) else np.zeros(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def fit(sample: list[tuple[int, str, int]]) -> QualityModel:
    """sample: (hash, text, label). Half of it trains the dictionaries, the other half the calibration."""
    half = [(t, y) for i, (_, t, y) in enumerate(sample) if i % 2 == 0]
    rest = [(t, y) for i, (_, t, y) in enumerate(sample) if i % 2 == 1]
    model = QualityModel(train_dictionary([t for t, y in half if y == 1]), train_dictionary([t for t, y in half if y == 0]), Logistic())
    x = model.features([t for t, _ in rest]) if rest else np.zeros((0, 14))
    model.calibration.fit(x, np.array([float(y) for _, y in rest]))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_docs: int = MAX_DOCS) -> QualityModel:
    keep = remainder("doc_id", 5) != 0 if keep is None else keep
    return fit(labelled_sample(docs, labels, "quality", keep, max_docs))


def quality_score(model: QualityModel, text: str = "text") -> Column:
    """The score as a column; the model (two dictionaries of 64 KB) travels with the tasks."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch.tolist()), dtype="float64")

    return score(F.col(text))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        quality_score(model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
