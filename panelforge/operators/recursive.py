"""Recursions over the rows of one code: its dates as one row of arrays, so that rows stay where they are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_code(df: DataFrame, inputs: list[str], outputs: list[str], f) -> DataFrame:
    """df with the columns that f(pandas frame of the inputs of one code, by date) returns as a dict of arrays.

    Only the inputs go to Python, and neither they nor df are shuffled where df lies by code already.
    """

    @F.arrow_udf("struct<" + ", ".join(f"`{o}`: array<double>" for o in outputs) + ">")
    def run(*columns: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False))
        flat = pd.DataFrame({c: v.flatten().to_numpy(zero_copy_only=False) for c, v in zip(inputs, columns, strict=True)})
        parts = [f(flat.iloc[i:j].reset_index(drop=True)) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        offsets = pa.array([0, *ends], pa.int32())
        values = [np.concatenate([np.asarray(p[o], dtype=float) for p in parts]) if parts else np.zeros(0) for o in outputs]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v, from_pandas=True)) for v in values], outputs)

    rest = [c for c in df.columns if c not in ("code", "date")]
    rows = df.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", *rest))).alias("_rows"))
    found = rows.withColumn("_found", run(*[F.col("_rows").getField(c).cast("array<double>") for c in inputs]))
    found = found.select("code", "_rows", *[F.col("_found").getField(o).alias(f"_out{i}") for i, o in enumerate(outputs)])
    own = F.inline(F.arrays_zip("_rows", *[f"_out{i}" for i in range(len(outputs))]))
    return found.select("code", own).select(*["code" if c == "code" else F.col("_rows").getField(c).alias(c) for c in df.columns], *[F.col(f"_out{i}").alias(o) for i, o in enumerate(outputs)])


def smooth(df: DataFrame, specs: dict[str, tuple[str | Callable[[pd.DataFrame], pd.Series], float]], adjust: bool = False) -> DataFrame:
    """Exponential means out = (column, alpha), starting at the first value; nulls keep the last mean.

    A function in place of a column gets the columns and means before it, so that means of means take one pass.
    adjust weighs the values so far by (1 - alpha) ** age instead of starting from the first one.
    """

    def f(pdf: pd.DataFrame) -> dict:
        found = {}
        for o, (x, a) in specs.items():
            values = x(pdf.assign(**found)) if callable(x) else pdf[x]
            found[o] = values.astype(float).ewm(alpha=a, adjust=adjust, ignore_na=True).mean()
        return found

    return _per_code(df, sorted({x for x, _ in specs.values() if isinstance(x, str)}), list(specs), f)


def rolling_quantiles(df: DataFrame, specs: dict[str, tuple[str | Callable[[pd.DataFrame], pd.Series], int, int, float, str]]) -> DataFrame:
    """Quantiles out = (column, n, least, q, interpolation) of the last n rows, null with fewer than least values.

    A row enters and leaves an ordered frame; no row counts or sorts its frame anew. A function in place of a column
    gets the columns and quantiles before it.
    """

    def f(pdf: pd.DataFrame) -> dict:
        found = {}
        for o, (x, n, least, q, interpolation) in specs.items():
            values = x(pdf.assign(**found)) if callable(x) else pdf[x]
            found[o] = values.astype(float).rolling(n, min_periods=least).quantile(q, interpolation=interpolation)
        return found

    return _per_code(df, sorted({x for x, *_ in specs.values() if isinstance(x, str)}), list(specs), f)


def rolling_scores(df: DataFrame, specs: dict[str, tuple[str, int, int, float]]) -> DataFrame:
    """Deviations out = (column, n, least, eps) of a row from the mean of the last n rows, by their standard deviation and eps, null with fewer than least values.

    As with quantiles, a row enters and leaves a frame, which is not summed anew.
    """

    def f(pdf: pd.DataFrame) -> dict:
        found = {}
        for o, (x, n, least, eps) in specs.items():
            values = pdf[x].astype(float)
            frames = values.rolling(n, min_periods=least)
            found[o] = (values - frames.mean()) / (frames.std() + eps)
        return found

    return _per_code(df, sorted({x for x, *_ in specs.values()}), list(specs), f)


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def kama(df: DataFrame, column: str = "close", n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Adaptive mean: the smoothing constant follows the efficiency of the last n steps."""

    def f(pdf: pd.DataFrame) -> dict:
        x = pdf[column].to_numpy(float)
        step = np.abs(np.diff(x, prepend=np.nan))
        out = np.full(len(x), np.nan)
        for i in range(n, len(x)):
            path = step[i - n + 1 : i + 1].sum()
            efficiency = abs(x[i] - x[i - n]) / path if path else 0.0
            c = (efficiency * (span(fast) - span(slow)) + span(slow)) ** 2
            before = x[i - 1] if i == n else out[i - 1]
            out[i] = before + c * (x[i] - before)
        return {"kama": out}

    return _per_code(df, [column], ["kama"], f)


def vidya(df: DataFrame, column: str = "close", n: int = 14) -> DataFrame:
    """Mean whose constant is that of n rows times the size of the Chande momentum."""

    def f(pdf: pd.DataFrame) -> dict:
        x = pdf[column].to_numpy(float)
        step = np.diff(x, prepend=np.nan)
        out = np.full(len(x), np.nan)
        for i in range(n, len(x)):
            s = step[i - n + 1 : i + 1]
            total = np.abs(s).sum()
            c = span(n) * (abs(s.sum()) / total if total else 0.0)
            before = x[i - 1] if i == n else out[i - 1]
            out[i] = c * x[i] + (1 - c) * before
        return {"vidya": out}

    return _per_code(df, [column], ["vidya"], f)
