"""Continuous intake, progress counters, freshness and a throttled dashboard."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadmill import lexicons as lx
from leadmill.operators.crawl import stale
from leadmill.operators.stats import job_counters
from leadmill.session import checkpoint
from leadmill.sources import records as rc
from leadmill.sources.delimited import skip_nameless, staged_leads


def _existing(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table at ``path``, empty if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


MARKS = "file string, run string"


def intake(arrivals: DataFrame, make: Callable[[DataFrame], DataFrame], state: str, table: str) -> StreamingQuery:
    """Imports arriving rows (with their ``file``), each file once, whatever becomes of the state.

    ``make`` turns the rows of new files into results. Results are written first, under the name
    of their run; then one small table marks the run's files as done. Results of a run without
    marks are not read, and its files are imported again. Lines of files (see ``file_arrivals``) are staged
    in file order before anything is joined to them.
    """
    spark = arrivals.sparkSession
    lines = {"block", "value"} <= set(arrivals.columns)

    def once(batch: DataFrame, batch_id: int) -> None:
        batch = rc.staged(batch) if lines else batch
        done = _existing(spark, MARKS, f"{table}/marks")
        files = checkpoint(batch.select("file").distinct().join(done, "file", "left_anti"))
        if files.isEmpty():
            return
        run = uuid.uuid4().hex
        make(batch.join(files, "file", "left_semi")).write.parquet(f"{table}/results/run={run}")
        files.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{table}/marks")

    return (
        arrivals.writeStream.foreachBatch(once)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def imported(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """The results of all finished runs, with their ``run``; ``schema`` is for a table into which nothing has come."""
    marks = _existing(spark, MARKS, f"{table}/marks").select("run").distinct()
    if schema and marks.isEmpty():
        return spark.createDataFrame([], f"{schema}, run string")
    return spark.read.option("basePath", f"{table}/results").parquet(f"{table}/results/run=*").join(marks, "run", "left_semi")


def file_arrivals(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The lines of arriving files, at most ``files_per_batch`` files in a batch."""
    return rc.as_lines(
        spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", str(files_per_batch))
        .option("recursiveFileLookup", "true").load(path)
    )


def read_arrived(batch: DataFrame) -> DataFrame:
    """Lead rows of the arrived files, each file one import; file names stay in the tables."""
    return skip_nameless(staged_leads(batch)[0])[0]


def progress(outcomes: DataFrame, timeout_ms: int = lx.LEAD_TIMEOUT_MS) -> DataFrame:
    """Running counters per job over a stream of outcomes (update or complete mode)."""
    return job_counters(outcomes, timeout_ms)


def throttled(df: DataFrame, write: Callable[[DataFrame, int], None], state: str,
              seconds: int = lx.TTL_SECONDS["stats"]) -> StreamingQuery:
    """A dashboard that is refreshed at most every ``seconds``."""
    return (
        df.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").start()
    )


def due_domains(batch: DataFrame, stored: DataFrame, now: str, forced: DataFrame | None = None) -> DataFrame:
    """Domains of a batch that need enrichment: none stored within the freshness limit."""
    wanted = batch.select("domain").filter("domain IS NOT NULL").distinct()
    return stale(wanted, stored, "domain", now, lx.TTL_SECONDS["enrichment"], forced)
