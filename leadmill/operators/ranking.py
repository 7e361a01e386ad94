"""Positions inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.session import checkpoint


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos") -> DataFrame:
    """1-based position of every row in its group; ``order`` must be total.

    Rows are range-split on keys and order, so that a group of any size spreads over many
    tasks; each range numbers its own rows and adds the count of the group's
    rows in earlier ranges. The range ids are checkpointed: a lost task must not draw
    other borders.
    """
    parts = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    parts = checkpoint(parts.withColumn("_range", F.spark_partition_id()))
    local = parts.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    )
    before = (
        parts.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys).orderBy("_range")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    k = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_range"]]
    joined = local.alias("l").join(before.alias("b"), k)
    return joined.select(
        "l.*", (F.col("b._before") + F.col("l._local")).cast("int").alias(out)
    ).drop("_range", "_local")


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
            out: str = "pos") -> DataFrame:
    """The first k rows of each group. Spark limits each map task to k rows per group
    before the shuffle (WindowGroupLimit), so a huge group arrives as k rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= k)
