"""Registry of runnable queries and their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, using: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``using`` names the SQL views of the twin."""

    def wrap(fn: Callable[[views.Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Tables(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = views.with_views(using, sql)
        return fn

    return wrap


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded, non-negative-zero double for comparison with the twin."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(name)
