"""Query registry and the context that hands base frames to registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("sources", "cleaning", "joins", "aggregates", "windows", "indicators", "selection",
            "models", "book", "sets", "scalars", "streams", "quality")


class Context:
    """Lazily built base frames for one (session, data folder) pair."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.root, name)

    def __getattr__(self, name: str) -> DataFrame:
        maker = getattr(tables, name, None)
        if maker is None or name.startswith("_"):
            raise AttributeError(name)
        return maker(self.spark, self.root)


def query(name: str, oracle: str | None = None, stage: str = ""):
    """Register a query; doubles in its result are rounded to six places.

    ``stage`` names the base frames it uses more than once.
    """

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, root: str) -> DataFrame:
            with tables.staging(stage.split()):
                return tidy(fn(Context(spark, root)))

        run.__name__, run.__doc__ = name, fn.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return wrap


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    if df.isStreaming:
        return df
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c, places)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)
