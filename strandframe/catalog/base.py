"""Registration of queries with their plain SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from strandframe.catalog import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: Sequence[str] = ()):
    """Register ``fn(Inputs) -> DataFrame`` under ``name``.

    ``using`` names the derived views the SQL reads; they become leading CTEs.
    """

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(views.Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.with_views(using, sql)
        return fn

    return register
