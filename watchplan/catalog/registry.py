"""The registry that the modules of the catalogue fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir); sql may use the views of VIEWS as tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql is not None:
            from watchplan.plans.views import with_views

            ORACLES[name] = with_views(sql)
        return f

    return put
