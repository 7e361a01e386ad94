"""Conflict-constrained best-fit packing of documents into sequences of equal capacity.

A document longer than the capacity is cut into full pieces, each a bin of its own, and a rest. Rests and
shorter documents are packed in falling length: of the open bins, ordered by what is left in them, the search
starts at the first that is large enough and goes on to its successors until a bin is compatible. A bin carries
bitmaps of the sources and duplicate clusters in it; compatible means that neither holds the document's own. The
first compatible bin is the tightest one, and where none is, a bin is opened.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their place in a written table, so one source or
one group of copies is spread evenly, and a shard is packed by one task. Sources that hold at least
1 / ``FREQUENT`` of all rows (so at most ``FREQUENT`` of them) get an order of their own, of the bins without
them: a search for them does not walk over bins that they have filled.

Documents without words take no bin: one row with piece 0 and a null bin. Null sources count as one source, null
clusters as no cluster, and so are clusters with one member; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, arrow_schema, fold

CAPACITY = 2048
SHARD_ROWS = 20_000
FREQUENT = 16
SPACE = "[\\x20\\x09-\\x0D]+"


class Packer:
    """Bins of one shard. Sources and clusters become bit positions as they are met."""

    def __init__(self, capacity: int, frequent: list[str] = ()):
        self.capacity = capacity
        self.left: list[int] = []  # per bin
        self.sources: list[int] = []  # bitmap per bin
        self.clusters: list[int] = []  # bitmap per bin
        self.source_bits: dict[str, int] = {}
        self.cluster_bits: dict[int, int] = {}
        #: Open bins by (left, bin): all of them under 0, those without a frequent source under its bit.
        self.orders: dict[int, list[tuple[int, int]]] = {0: []} | {self._source(s): [] for s in frequent}
        self.last: tuple = (None, None)

    def _source(self, source: str) -> int:
        return self.source_bits.setdefault(source, 1 << len(self.source_bits))

    def place(self, length: int, source: str, cluster: int | None) -> tuple[int, int]:
        """(bin, offset in it) of the tightest compatible bin."""
        bit = self._source(source)
        mark = 0 if cluster is None else self.cluster_bits.setdefault(cluster, 1 << len(self.cluster_bits))
        order = self.orders.get(bit, self.orders[0])
        kind = (length, source, cluster) if mark else None
        # the bins before the one that took the copy before this one hold the cluster or the source
        start = self.last[1] if kind and self.last[0] == kind else (length, -1)
        for at in range(bisect_left(order, start), len(order)):
            left, b = order[at]
            if not (self.sources[b] & bit or self.clusters[b] & mark):
                self._each_order(b, lambda o, e: o.pop(bisect_left(o, e)))
                self.last = (kind, (left, b))
                break
        else:
            left, b = self.capacity, len(self.left)
            self.left.append(left)
            self.sources.append(0)
            self.clusters.append(0)
            self.last = (kind, (self.capacity + 1, -1))
        self.left[b] -= length
        self.sources[b] |= bit
        self.clusters[b] |= mark
        if self.left[b]:
            self._each_order(b, insort)
        return b, self.capacity - left

    def _each_order(self, b: int, do) -> None:
        entry = (self.left[b], b)
        for bit, order in self.orders.items():
            if not self.sources[b] & bit:
                do(order, entry)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != ""))


def same_words(text: Column) -> Column:
    """Default duplicate cluster: 64 bits of the text without case and anything but letters and digits."""
    return F.xxhash64(F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    length: Column | None = None, cluster: Column | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start (in the document), length, bin_id, offset (in the bin).

    ``length`` defaults to the number of words, ``cluster`` (64-bit) to ``same_words``.
    """
    cuts = Cuts(docs.sparkSession, "packing")
    body = F.col(text).cast("string")
    rows = cuts.write(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
            (words(body) if length is None else length).cast("bigint").alias("length"),
            (same_words(body) if cluster is None else cluster).cast("bigint").alias("cluster"),
        ),
        "rows",
    )
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    # a share of 1 / FREQUENT at least: no more than FREQUENT rows
    frequent = [r.source for r in rows.groupBy("source").count().where(F.col("count") * FREQUENT >= n).collect()] if n else []
    repeated = rows.where("cluster is not null").groupBy("cluster").count().where("count > 1").select("cluster", F.lit(True).alias("repeated"))
    dealt = (
        rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
        .join(cuts.write(repeated, "repeated"), "cluster", "left")
        .select("shard", "doc_id", "source", "length", F.when(F.col("repeated"), F.col("cluster")).alias("cluster"))
        .withColumn("rest", F.when(F.col("length") <= capacity, F.col("length")).otherwise(F.col("length") % capacity))
    )
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", F.desc("rest"), "cluster", "source", "doc_id")
    schema = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, offset bigint"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        shard, packer, bins = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, bins = r["shard"], 0
                    packer, of = Packer(capacity, frequent), {}
                full, rest = divmod(r["length"], capacity)
                for piece in range(full):
                    out.append((r["doc_id"], piece, piece * capacity, capacity, shard << 32 | bins, 0))
                    bins += 1
                if rest:
                    b, offset = packer.place(rest, r["source"], r["cluster"])
                    if b not in of:
                        of[b] = bins
                        bins += 1
                    out.append((r["doc_id"], full, full * capacity, rest, shard << 32 | of[b], offset))
                elif not full:
                    out.append((r["doc_id"], 0, 0, 0, None, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target)

    return ordered.mapInArrow(run, schema)
