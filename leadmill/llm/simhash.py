"""Near duplicates by SimHash, found through a segment-popcount embedding.

Fingerprint: A-Z lower-cased, 3-word shingles, XXH64 of each, one bit per position that is set in over half.

Search: a fingerprint is mapped to the bit counts (0, 1, 2) of its 32 two-bit segments. The Manhattan distance of
two count vectors is at most the Hamming distance of the fingerprints, so pairs within ``REACH`` bits have
vectors within Manhattan distance ``REACH``. The 32 coordinates form 6 groups; a distance of 3 can touch 3 of
them at most, so such a pair shares the grid cell of at least one choice of 3 groups (20 choices). Within a cell
the Manhattan bound is tested first, then the exact distance. Counts are kept in unary (00, 01, 11), where the
Manhattan distance is the number of differing bits.

Equal fingerprints are one node, so copies cost one row. A cell's links leave the task as a spanning forest,
never as all pairs; cells with more than ``TILE`` nodes are dealt out in tiles, every tile meeting every other.
Components are settled by alternating large and small stars over tables in the shared folder.

Null and empty texts have fingerprint 0 and are linked like any other; a null doc_id gets the component of its
fingerprint and never names one; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, arrow_schema, map_batches, numbered

REACH = 3
WORDS = 3
SEED = 42
#: Nodes of a cell that one task compares with each other.
TILE = 4096
#: Low bit of each two-bit segment.
LOW = 0x5555555555555555
#: Segments in each of the 6 groups.
GROUPS = (6, 6, 5, 5, 5, 5)
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(w), SEED) for w in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64).astype("<u8")
    for at in range(0, len(every), SHINGLES_AT_ONCE):
        part = every[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batch):
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps)}

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, fp bigint")


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each count in unary."""
    high = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(LOW)), 1).bitwiseOR(fp.bitwiseOR(high).bitwiseAND(F.lit(LOW)))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW), np.uint64(1)
    return ((fp & (fp >> one) & low) << one) | ((fp | (fp >> one)) & low)


def cell_masks() -> list[int]:
    """Per choice of 3 of the 6 groups, the bits of their segments, as signed integers."""
    masks, at = [], 0
    for n in GROUPS:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    every = [sum(c) for c in combinations(masks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def _forest(group: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is linked to within its cell) for rows sorted by cell."""
    u, left, right = _embed(fp), [], []
    index = np.arange(len(fp) - 1)
    step = 1
    while len(index):
        index = index[index + step < len(fp)]
        index = index[group[index] == group[index + step]]
        other = index + step
        near = np.bitwise_count(u[index] ^ u[other]) <= REACH
        a, b = index[near], other[near]
        exact = np.bitwise_count(fp[a] ^ fp[b]) <= REACH
        left.append(a[exact])
        right.append(b[exact])
        step += 1
    if not left:
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    best = node.copy()
    while len(a):
        low = np.minimum(best[a], best[b])
        open_ = (best[a] != low) | (best[b] != low)
        if not open_.any():
            break
        np.minimum.at(best, a, low)
        np.minimum.at(best, b, low)
    moved = best != node
    return node[moved], best[moved]


def _links(rows: DataFrame, defer: bool) -> DataFrame:
    """Compares the rows of each cell. ``rows`` is dealt by cell and sorted by it.

    Returns edges (a, b); with ``defer``, also the rows of cells over ``TILE`` (cell set, a = fp, b = node).
    """
    keys = [c for c in rows.columns if c not in ("fp", "node")]
    schema = "choice int, cell bigint, a bigint, b bigint"
    target = arrow_schema(rows.sparkSession, schema)

    def emit(a, b, choice=None, cell=None):
        none = pa.nulls(len(a))
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int32()) if choice is None else pa.array(choice, pa.int32()), none.cast(pa.int64()) if cell is None else pa.array(cell, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            schema=target,
        )

    def run(batches):
        held, crowded = None, None
        for batch in batches:
            now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if not len(now["fp"]):
                continue
            if crowded is not None:  # the cell at hand is dealt out later
                n = int(np.argmin(np.append(np.logical_and.reduce([now[k] == crowded[k] for k in keys]), False)))
                if n:
                    yield emit(now["fp"][:n], now["node"][:n], now["choice"][:n], now["cell"][:n])
                    now = {c: x[n:] for c, x in now.items()}
                if not len(now["fp"]):
                    continue
                crowded = None
            if held is not None:
                now = {c: np.concatenate([held[c], x]) for c, x in now.items()}
            new = np.logical_or.reduce([np.diff(now[k]) != 0 for k in keys])
            group = np.concatenate([[0], np.cumsum(new)])
            last = int(np.searchsorted(group, group[-1]))
            yield from whole({c: x[:last] for c, x in now.items()}, group[:last])
            held = {c: x[last:] for c, x in now.items()}
            if defer and len(held["fp"]) > TILE:
                crowded = {k: held[k][0] for k in keys}
                yield emit(held["fp"], held["node"], held["choice"], held["cell"])
                held = None
        if held is not None:
            yield from whole(held, np.zeros(len(held["fp"]), np.int64))

    def whole(now, group):
        if not len(group):
            return
        if defer:
            size = np.bincount(group)[group]
            over = size > TILE
            if over.any():
                yield emit(*(now[c][over] for c in ("fp", "node", "choice", "cell")))
                now, group = {c: x[~over] for c, x in now.items()}, group[~over]
        a, b = _forest(group, now["fp"].view(np.uint64), now["node"])
        if len(a):
            yield emit(a, b)

    return rows.mapInArrow(run, schema)


def edges(nodes: DataFrame, cuts: Cuts) -> DataFrame:
    """Distinct edges (a, b), a > b, that connect all nodes (fp, node) within ``REACH`` bits of each other."""
    u = embed(F.col("fp"))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), u.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks()))))
    rows = nodes.where("node is not null").select("fp", "node", cells.alias("c")).select("c.choice", "c.cell", "fp", "node")
    first = cuts.write(_links(rows.repartition("choice", "cell").sortWithinPartitions("choice", "cell"), True), "links")
    crowded = first.where("cell is not null").select("choice", "cell", F.col("a").alias("fp"), F.col("b").alias("node"))
    tiles = crowded.groupBy("choice", "cell").agg(F.ceil(F.count("*") / F.lit(TILE // 2)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        crowded.join(cuts.write(tiles, "tiles"), ["choice", "cell"])
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("choice", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "node")
    )
    keys = ["choice", "cell", "low", "high"]
    second = _links(dealt.repartition(*keys).sortWithinPartitions(*keys), False)
    return first.where("cell is null").select("a", "b").unionByName(second.select("a", "b")).distinct()


def components(pairs: DataFrame, cuts: Cuts) -> DataFrame:
    """node and root (smallest node of its component) for every node of the edges that is not the root itself."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(table: DataFrame, name: str, large: bool) -> DataFrame:
        """Links the larger (large) or smaller (small) neighbours of each node to its smallest one."""
        both = table.select("a", "b")
        if large:
            both = both.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cuts.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        made = cuts.write(out.where("a <> b").distinct(), name)
        cuts.drop(f"{name}-low")
        return made

    table = cuts.write(pairs, "edges-0")
    seen, turn, label = state(table), 0, "edges-0"
    while seen[0]:
        turn += 1
        wide = star(table, f"large-{turn}", True)
        table = star(wide, f"edges-{turn}", False)
        cuts.drop(f"large-{turn}", label)
        label, now = f"edges-{turn}", state(table)
        if now == seen:
            break
        seen = now
    return table.select(F.col("a").alias("node"), F.col("b").alias("root"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id, the smallest doc_id reachable through links."""
    cuts = Cuts(docs.sparkSession, "simhash")
    fps = cuts.write(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = cuts.write(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(edges(nodes, cuts), cuts)
    named = cuts.write(
        nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "named"
    )
    cuts.drop("links", "tiles", "nodes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose component another one names. Rows without an id stay."""
    cuts = Cuts(docs.sparkSession, "simhash-rows")
    gone = link(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = cuts.write(gone, "dropped")
    rows, (own,) = numbered(docs, doc_id)
    return rows.join(gone, F.col(own).cast("bigint") == F.col("gone"), "left_anti").toDF(*docs.columns)
