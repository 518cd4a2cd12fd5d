"""The registered queries, their SQL, and where they read and write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import scratch as paths
from ..operators.layout import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs more than reading it."""
    return spread(table(spark, sf_dir, name))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    return paths.path(spark)
