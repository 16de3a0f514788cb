"""The registered queries over whole tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction_queries, keyed_queries, projection_queries, routing_queries, storage_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (routing_queries, projection_queries, extraction_queries, keyed_queries, storage_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in an envelope, JSON extracted, one type accepted, every tenth row of each user with sums."""
    return keyed_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
