"""Registry of queries and of the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.sources.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, *views: str):
    """Registers f(view names as DataFrames ...) -> DataFrame under a name; the oracle reads the same views."""

    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views])

        QUERIES[name] = query
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
