"""How query modules register what they define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a key that a query joins into one text.
BLOB = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registrar(into: dict) -> Callable:
    """A decorator ``@query(sql)`` that registers a function ``(spark, sf_dir)`` under its name."""

    def query(sql: str | None = None) -> Callable:
        def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            into[run.__name__] = (run, sql)
            return run

        return add

    return query
