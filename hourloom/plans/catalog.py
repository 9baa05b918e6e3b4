"""All registered queries with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourloom.plans import queries_forecast, queries_models, queries_series

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED = {**queries_series.QUERIES, **queries_forecast.QUERIES, **queries_models.QUERIES}


def query_functions() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTERED.items()}


def query_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql is not None}
