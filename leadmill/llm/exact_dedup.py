"""Exact deduplication by a stateful stream, in DataFrame functions only.

The rows' digests, stable identifiers and content locators are written as a table and read as a stream. The
stream's keyed state (digest -> group size, largest identifier and that row's locator) is a table on disk in the
shared folder: it has no expiry, and each micro-batch looks its digests up and writes the entries it changed as
its own part, over which a repeated batch writes again; parts are folded now and then. So neither the state nor the
stream's progress is lost with an executor. (State in RocksDB was tried first: it preallocates 4 MB of local disk per shuffle partition.)

A hit, a digest that holds more than one row, is checked on the full bytes: the members' texts are compared with
the text at the state's locator. Should a digest stand for different texts, its rows are grouped by the texts.

A-Z are lower-cased before comparing. Null and empty texts are equal. Of equal texts the row with the largest
identifier stays (null is the smallest); of equal identifiers the one with the largest locator, so of repeated
rows one stays. An empty table gives an empty result; other columns are ignored, whatever their names. Very long texts
are hashed whole and only those that share a digest are read a second time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, numbered
from leadmill.llm.common import fold as lower

#: Micro-batches that a table's digests are read in, and batches after which the state's parts are folded into one.
BATCHES = 8
FOLD = 8


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, cuts: Cuts) -> tuple[DataFrame, Column]:
    """The rows and where each one's content is: file and row. Rows that come from no file are written first."""
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
    try:
        docs.select(place).schema  # noqa: B018
        return docs, place
    except AnalysisException:
        return cuts.write(docs, "rows"), place


STATE = "digest binary, group_size bigint, last struct<doc_id: bigint, locator: string>"


class State:
    """digest -> group size and last row, as parts on disk: one per batch, and from time to time a fold of all before.

    Parts are written under their number and written over when a batch is repeated; a batch reads only parts of
    the batches before it. The parts that a fold holds are deleted one batch later, when nobody can need them again.
    """

    def __init__(self, cuts: Cuts, fold: int):
        self.cuts, self.spark, self.every = cuts, cuts.spark, fold

    def _part(self, label: str) -> str:
        return f"states/{label}"

    def _labels(self, number: int) -> list[str]:
        """The parts that hold all batches before ``number``."""
        base = max(0, number - 1) // self.every * self.every
        return [f"fold={base}"] * (base > 0) + [f"batch={i}" for i in range(base, number)]

    def entries(self, number: int, asked: DataFrame | None = None) -> DataFrame:
        """The newest entry of each digest (of those in ``asked``) before batch ``number``."""
        parts = [self.spark.read.schema(STATE).parquet(self.cuts.path(self._part(x))) for x in self._labels(number)]
        held = self.spark.createDataFrame([], STATE) if not parts else reduce(DataFrame.unionAll, parts)
        held = held if asked is None else held.join(asked, "digest", "left_semi")
        return held.groupBy("digest").agg(*(F.max_by(c, "batch").alias(c) for c in ("batch", "group_size", "last")))

    def put(self, rows: DataFrame, label: str) -> None:
        rows.select("batch", "digest", "group_size", "last").write.mode("overwrite").parquet(self.cuts.path(self._part(label)))

    def add(self, came: DataFrame, number: int) -> None:
        """Adds a batch's ``n`` rows and ``new`` last row per digest to what is held."""
        if number and number % self.every == 0:
            self.put(self.entries(number), f"fold={number}")
        if number > self.every and number % self.every == 1:
            self.cuts.drop(*map(self._part, self._labels(number - 1)))
        held = self.entries(number, came.select("digest")).drop("batch")
        self.put(
            came.join(held, "digest", "left").select(
                F.lit(number).cast("bigint").alias("batch"), "digest",
                (F.col("n") + F.coalesce("group_size", F.lit(0))).alias("group_size"), F.greatest("new", "last").alias("last"),
            ),
            f"batch={number}",
        )


STATE = "batch bigint, digest binary, group_size bigint, last struct<doc_id: bigint, locator: string>"


def groups(keys: DataFrame, cuts: Cuts, files: int | None = None, fold: int = FOLD) -> DataFrame:
    """digest, group_size and last (doc_id, locator) from a stream over the table ``keys`` in the cut "keys".

    A micro-batch takes ``files`` files, or else an even share of the table, ``BATCHES`` in all.
    """
    state, done = State(cuts, fold), []
    files = files or max(1, -(-len(keys.inputFiles()) // BATCHES))

    def update(batch: DataFrame, number: int) -> None:
        state.add(batch.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("new")), number)
        done[:] = [number + 1]

    stream = keys.sparkSession.readStream.schema(keys.schema).option("maxFilesPerTrigger", files).parquet(cuts.path("keys"))
    stream.writeStream.foreachBatch(update).option("checkpointLocation", cuts.path("progress")).trigger(availableNow=True).start().awaitTermination()
    return state.entries(done[0] if done else 0).drop("batch")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    files: int | None = None, fold: int = FOLD,
) -> DataFrame:
    """One row per input row: doc_id, locator, keep_id, group_size, kept and the digest of the folded text."""
    cuts = Cuts(docs.sparkSession, "exact-dedup")
    docs, (doc_id, text) = numbered(docs, doc_id, text)
    rows, place = located(docs, cuts)
    folded = lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    base = rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), place.alias("locator"), folded.alias("folded"))
    base = base.withColumn("digest", digest(F.col("folded")))
    keys = cuts.write(base.select("doc_id", "locator", "digest"), "keys")
    states = cuts.write(groups(keys, cuts, files, fold), "groups")
    cuts.drop("states", "progress")

    many = states.where("group_size > 1").select("digest", F.col("last.locator").alias("first"))
    hits = cuts.write(base.join(many, "digest"), "hits")
    held = hits.where("locator = first").select("digest", F.col("folded").alias("known"))
    # no aggregation on top: so a digest with very many hits can be split between tasks
    unlike = cuts.write(hits.join(held, "digest").where("folded <> known").select("digest"), "unlike")
    split = hits.join(unlike, "digest", "left_semi").select("doc_id", "locator", "digest", "folded")
    exact = split.groupBy("digest", "folded").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("last"))
    parted = cuts.write(
        split.join(exact, ["digest", "folded"]).select("doc_id", "locator", "digest", "group_size", "last"), "parted"
    )
    cuts.drop("hits")

    whole = keys.join(states, "digest").select("doc_id", "locator", "digest", "group_size", "last")
    if not parted.isEmpty():
        whole = whole.join(unlike, "digest", "left_anti").unionByName(parted)
    return whole.select(
        "doc_id", "locator", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("last.locator")).alias("kept"), "digest",
    )


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that repeat another one."""
    cuts = Cuts(docs.sparkSession, "exact-dedup-rows")
    plain, (own, body) = numbered(docs, doc_id, text)
    rows, place = located(plain, cuts)
    gone = cuts.write(deduplicate(rows, own, body, **options).where(~F.col("kept")).select("locator"), "dropped")
    return rows.withColumn("locator", place).join(gone, "locator", "left_anti").select(*plain.columns).toDF(*docs.columns)
