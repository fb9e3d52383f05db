"""Registry of named queries, each with its DataFrame form and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.plans.fixtures import spark_view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Input:
    """What a query reads: the session, the data folder and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return spark_view(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(Input) -> DataFrame`` under ``name``; ``views`` lists the views its SQL twin uses."""

    def add(fn: Callable[[Input], DataFrame]) -> Callable[[Input], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Input(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views.split())
        return fn

    return add


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for output, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) < 0.5 * 10.0 ** -digits, F.lit(0.0)).otherwise(F.round(c, digits))


def rs(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"case when abs({expr}) < {0.5 * 10.0 ** -digits:e} then 0e0 else round({expr}, {digits}) end"
