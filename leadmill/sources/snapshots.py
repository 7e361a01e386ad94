"""Lead tables as Parquet snapshots: a new version is written whole, then named current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> str:
    """Write a version and record it; readers keep seeing the version before until then."""
    version = uuid.uuid4().hex
    path = f"{root}/{name}/{version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    log = spark.range(1).select(
        F.lit(name).alias("table"), F.lit(version).alias("version"), F.current_timestamp().alias("at")
    )
    log.write.mode("append").parquet(f"{root}/_versions")
    return path


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version recorded last."""
    log = spark.read.parquet(f"{root}/_versions").filter(F.col("table") == name)
    last = log.agg(F.max_by("version", F.struct("at", "version")).alias("v")).first()
    if last.v is None:
        raise ValueError(f"no snapshot of {name} under {root}")
    return spark.read.parquet(f"{root}/{name}/{last.v}")
