"""Every query of the panel engine by the id of its operator, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Data
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MODULES = ("aggregates", "windows", "indicators", "crosssection", "joins", "keys", "metrics", "portfolio", "splits", "audits", "domain", "sources", "series", "graph", "macro", "blocks")


def finished(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys as they are, numbers rounded to six places (a little shifted: engines treat decimal ties differently)."""
    return df.select(*keys, *[(F.round(F.col(v).cast("double") + sql.SHIFT, 6) + F.lit(0.0)).alias(v) for v in values])


def query(name: str, keys: str, values: str = "", oracle: str | None = None, uses: str = "bars"):
    """Register a function of Data. oracle is the SQL body, uses names the frames that it reads."""

    def add(f: Callable[[Data], DataFrame]):
        ks, vs = keys.split(), values.split()
        _QUERIES[name] = lambda spark, folder: finished(f(Data(spark, folder)), ks, vs)
        if oracle is not None:
            _ORACLES[name] = sql.whole(oracle, ks, vs, uses.split())
        return f

    return add


def _load() -> None:
    for module in MODULES:
        try:
            importlib.import_module(f"{__package__}.{module}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{module}":
                raise


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["m2_rank_ic"](spark, folder)
