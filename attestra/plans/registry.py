"""The registered queries: a function of (spark, sf_dir) each, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(names: str, sql: str | None = None):
    """Registers a function of DataFrames, which gets the named views in order. sql: over the same views, if there is any."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, n) for n in names.split()])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = with_views(names, sql)
        return f

    return register
