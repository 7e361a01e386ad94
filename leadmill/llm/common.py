"""What the operators share: cut tables in the shared folder, streaming over Arrow batches, A-Z folding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.session import cut_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Cuts:
    """Tables an operator writes to the shared folder to end lineage; ``drop`` deletes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{cut_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            place = jvm.org.apache.hadoop.fs.Path(self.path(label))
            place.getFileSystem(conf).delete(place, True)


def fold(text: Column) -> Column:
    """Lower-cases A-Z only. Texts without other characters take the faster ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by place, so that no name can clash, and the new names of ``names``."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in names]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, before: Callable | None = None) -> DataFrame:
    """Row batch to row batch; ``fn`` gets an Arrow batch and returns columns by name.

    ``before`` makes per-task state that is passed to ``fn`` as a second argument.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (before(),) if before else ()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, *state)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == t.type else pa.array(c, t.type) for c, t in ((out[n], target.field(n)) for n in names)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string, for plain column types."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "smallint": pa.int16(),
    }
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
