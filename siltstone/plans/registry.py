"""The engine's registered queries: each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    """Register a query by its name, with its SQL if there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by their keys over all cores: for tables whose few bytes make few tasks although each row is much work."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
