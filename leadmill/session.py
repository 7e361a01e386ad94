"""Session helpers: durable cut points and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle: int = 8, app: str = "leadmill") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; all executors share it.

    Only where that setting is absent (tests) a local one is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):  # a folder of one machine is no shared folder
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leadmill-"))
        named = sc.getCheckpointDir()
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Executor loss cannot lose the result, the lineage before it is gone, and later plans see
    its true size. (Dataset.checkpoint keeps the filter constraints of the old plan, which
    grow from round to round in a loop.)
    """
    spark = df.sparkSession
    path = f"{cut_folder(spark).rstrip('/')}/leadmill-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the tables that a checkpointed ``df`` reads; nobody may read it after that."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Marks ``df`` so that a join with it shuffles both sides.

    Files and shuffles are compressed: millions of rows can look small enough to be sent to all executors,
    and the driver would hold them, unpacked, while it does.
    """
    return df.hint("merge")


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows
