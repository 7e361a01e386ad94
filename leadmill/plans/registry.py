"""Registry of the query catalogue: a Spark query and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arriving(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The table as a stream. It may be one file or a folder of files: the braces make its name a pattern, which may match either."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")
