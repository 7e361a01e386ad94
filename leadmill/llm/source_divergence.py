"""Source divergence audit by single-pass in-memory indexing.

1. *Blocks.* A task reads its documents once and keeps postings (lang, term) -> source -> (occurrences, documents) in
   memory. When ``BLOCK_ENTRIES`` are held the block is spilled: sorted by term and cut by a hash of (lang, term) into
   one piece per shard. A run is the sorted pieces of one block; Spark's shuffle carries them to their shards.
2. *Merge.* A shard's pieces arrive in order of their first term. A heap holds the pieces that are open; the entries of
   terms that no later piece can hold are taken from it and summed. So only pieces that overlap are in memory. Terms in ``MIN_DOCS`` documents of their language are kept.
3. *Shares.* Totals per (lang, source) and per lang are sums over the kept postings; shares are whole numbers
   (decimal division where 64 bits could overflow), so every figure is exact.
4. *Pairs.* With c0 a group's share of a term that it lacks, a pair's sum over all V terms is
   V f(a0, b0) + sum over A's terms of [f(a, b0) - f(a0, b0)] + sum over B's terms of [f(a0, b) - f(a0, b0)]
   + sum over the terms that both hold of [f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)].
   The one-sided sums come from a histogram of each group's shares. The last sums are streamed: tasks go over the
   frequencies term by term, add each pair's correction to a square in memory, and spill it when it has ``PAIRS`` fields.

Null text, lang and source are ''. Repeated rows count as often as they stand; there is no doc_id. Ties in rank
go to the smaller item by UTF-8 bytes. Long texts are read in pieces of ``PIECE`` characters, cut between terms. A
language without kept terms still has its pairs (value 0). An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import UPPER, Cuts

#: Fixed values of the audit.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Postings held by a task before a block is spilled, and pairs of sources before partial sums are.
BLOCK_ENTRIES = 400_000
PAIRS = 1_000_000
#: Shards of the term space that a merging task gets, so that tasks are even.
SHARDS_PER_TASK = 8
#: Entries of one row of a run, and entries that a merging task holds open before it gives out whole terms.
PIECE_ENTRIES = 2000
OPEN_ENTRIES = 300_000
#: Characters of a text that are cut into terms at once.
PIECE = 1 << 20
#: Sources of one term that are paired at once (a square of that side is held).
TILE = 512

_terms = re.compile(TERM).findall
_break = re.compile("[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]").search
_FOLD = str.maketrans(UPPER, UPPER.lower())


def terms_of(text: str) -> Iterator[list[str]]:
    """The terms of a text, A-Z lower-cased, piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _break(text, end)
            end = gap.start() if gap else len(text)
        part = text[at:end]
        yield _terms(part.lower() if part.isascii() else part.translate(_FOLD))
        at = end


def shards_of(terms: np.ndarray, shards: int) -> np.ndarray:
    """A hash of each term, the same in every process."""
    return (pd.util.hash_array(terms, categorize=False) % np.uint64(shards)).astype(np.int32)


ENTRIES = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PIECES = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("head", pa.string()), ("terms", pa.list_(pa.string())),
    ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])
PIECES_DDL = "shard int, lang string, head string, terms array<string>, sources array<string>, counts array<bigint>, docs array<bigint>"


class Block:
    """Postings in memory: for each (lang, source), occurrences and documents by term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, rows: Iterable[tuple[str, str, str]]) -> None:
        """(lang, source, text) rows."""
        for lang, source, text in rows:
            if (lang, source) not in self.groups:
                self.groups[lang, source] = (Counter(), Counter())
            counts, documents = self.groups[lang, source]
            met: set[str] = set()
            for terms in terms_of(text):
                counts.update(terms)
                met.update(terms)
            documents.update(met)

    def __len__(self) -> int:
        return sum(len(c) for c, _ in self.groups.values())

    def run(self, shards: int) -> pa.RecordBatch:
        """The block's pieces: per shard and language its terms in order, at most ``PIECE_ENTRIES`` to a row."""
        parts = []
        for (lang, source), (counts, documents) in self.groups.items():
            if counts:
                terms = list(counts)
                parts.append(pa.table([
                    shards_of(np.array(terms, object), shards), pa.DictionaryArray.from_arrays(np.zeros(len(terms), np.int8), [lang]).cast(pa.string()), terms,
                    pa.DictionaryArray.from_arrays(np.zeros(len(terms), np.int8), [source]).cast(pa.string()), list(counts.values()), list(map(documents.__getitem__, terms)),
                ], schema=ENTRIES))
        if not parts:
            return pa.RecordBatch.from_pylist([], schema=PIECES)
        held = pa.concat_tables(parts)
        held = held.take(pc.sort_indices(held, [("shard", "ascending"), ("lang", "ascending"), ("term", "ascending")])).combine_chunks()
        shard, lang = held["shard"].to_numpy(), pc.rank(held["lang"], tiebreaker="dense").to_numpy()
        edge = np.flatnonzero((shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1])) + 1
        edge = np.union1d(np.concatenate(([0], edge)), np.arange(0, len(shard), PIECE_ENTRIES))
        offsets = pa.array(np.append(edge, len(shard)).astype(np.int32))
        first = held.select(["shard", "lang", "term"]).take(pa.array(edge)).combine_chunks()
        lists = [pa.ListArray.from_arrays(offsets, _one(held[c])) for c in ("term", "source", "n", "docs")]
        return pa.RecordBatch.from_arrays([_one(first[c]) for c in ("shard", "lang", "term")] + lists, schema=PIECES)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def runs(docs: DataFrame, shards: int, entries: int) -> DataFrame:
    """Pieces of term-sorted runs. ``docs`` has lang, source and text, none null."""

    def spill(block: Block) -> Iterator[pa.RecordBatch]:
        run = block.run(shards)
        for at in range(0, run.num_rows, 500):
            yield run.slice(at, 500)

    def index(batches):
        block = Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block.add(zip(*(batch.column(c).slice(at, 500).to_pylist() for c in ("lang", "source", "text")), strict=True))
                if len(block) >= entries:
                    yield from spill(block)
                    block = Block()
        yield from spill(block)

    return docs.mapInArrow(index, PIECES_DDL)


class _Piece:
    """What is left of a piece: its entries, in order of term."""

    def __init__(self, lang: str, columns: list[pa.Array]):
        self.lang, self.columns, self.at = lang, columns, 0

    def head(self) -> str:
        return self.columns[0][self.at].as_py()

    def __len__(self) -> int:
        return len(self.columns[0]) - self.at

    def before(self, term: str | None) -> list[pa.Array]:
        """Takes out the entries below ``term`` (all for None)."""
        low, high = self.at, len(self.columns[0])
        while term is not None and low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.columns[0][middle].as_py() < term else (low, middle)
        end = len(self.columns[0]) if term is None else low
        out, self.at = [c.slice(self.at, end - self.at) for c in self.columns], end
        return out


def merge(pieces: Iterator[tuple[str, list[pa.Array]]], open_entries: int) -> Iterator[tuple[str, list[pa.Array]]]:
    """Heap-merges the pieces of a shard, which come in order of (lang, first term).

    Gives (lang, terms, sources, counts, documents) parts; all entries of a term come before a part of that language
    with a later ``None`` mark, so a caller may sum up whenever it gets one. A part is taken from the open piece of the least term, up
    to the first term that a piece still to come may hold.
    """
    heap: list[tuple[str, int, _Piece]] = []
    number = held = 0
    lang = None

    def drain(term: str | None) -> Iterator[tuple]:
        nonlocal held
        while heap and (term is None or heap[0][0] < term):
            _, n, piece = heap[0]
            part = piece.before(term)
            held -= len(part[0])
            yield piece.lang, part
            if len(piece):
                heapq.heapreplace(heap, (piece.head(), n, piece))
            else:
                heapq.heappop(heap)
        yield lang, None

    for of, columns in pieces:
        if of != lang:
            yield from drain(None)
            lang = of
        elif held >= open_entries:
            yield from drain(columns[0][0].as_py())
        piece = _Piece(of, columns)
        held += len(piece)
        number += 1
        heapq.heappush(heap, (piece.head(), number, piece))
    yield from drain(None)


FREQUENCIES = "lang string, term string, source string, n bigint, lang_n bigint"
FREQUENCY_ROWS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])


def summed(parts: list[tuple[str, list[pa.Array]]], min_docs: int) -> pa.Table:
    """FREQUENCIES of whole terms: counts per source, and over all sources, of terms in ``min_docs`` documents."""
    table = pa.concat_tables(pa.table([pa.repeat(lang, len(c[0])), *c], names=["lang", "term", "source", "n", "docs"]) for lang, c in parts)
    table = table.group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
    whole = table.group_by(["lang", "term"]).aggregate([("n_sum", "sum"), ("docs_sum", "sum")])
    whole = whole.filter(pc.greater_equal(whole["docs_sum_sum"], min_docs))
    kept = table.join(whole, ["lang", "term"], join_type="inner")
    return pa.table([kept[c] for c in ("lang", "term", "source", "n_sum", "n_sum_sum")], schema=FREQUENCY_ROWS)


def frequencies(pieces: DataFrame, shards: int, min_docs: int, open_entries: int) -> DataFrame:
    """lang, term, source, n and lang_n (over all sources) of the kept terms, merged shard by shard."""

    def arriving(batches) -> Iterator[tuple[int, str, list[pa.Array]]]:
        for batch in batches:
            shard, lang = batch.column("shard").to_pylist(), batch.column("lang").to_pylist()
            for i in range(batch.num_rows):
                yield shard[i], lang[i], [batch.column(c)[i].values for c in ("terms", "sources", "counts", "docs")]

    def run(batches):
        held, size = [], 0
        for _, of_shard in groupby(arriving(batches), key=lambda p: p[0]):
            for lang, part in merge((p[1:] for p in of_shard), open_entries):
                if part is not None:
                    held.append((lang, part))
                    size += len(part[0])
                elif size >= open_entries:  # terms are whole here
                    yield from summed(held, min_docs).to_batches(max_chunksize=20_000)
                    held, size = [], 0
        if held:
            yield from summed(held, min_docs).to_batches(max_chunksize=20_000)

    tasks = max(1, shards // SHARDS_PER_TASK)
    return pieces.repartition(tasks, "shard").sortWithinPartitions("shard", "lang", "head").mapInArrow(run, FREQUENCIES)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly: in 64 bits where they hold it, else as a decimal."""
    small = n < 9_000_000_000
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    below = total + terms
    return 1 + F.when(small, F.call_function("div", SCALE * (n + 1), below)).otherwise(
        F.call_function("div", wide, below.cast("decimal(20,0)"))
    )


def gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Squares:
    """Sums per pair of sources, by codes that are given to (lang, source) as they come."""

    def __init__(self, tile: int):
        self.tile, self.codes, self.sums = tile, {}, np.zeros((0, 0), np.int64)

    def code(self, lang: str, sources: pa.Array) -> np.ndarray:
        named = sources.dictionary_encode()
        own = np.array([self.codes.setdefault((lang, s), len(self.codes)) for s in named.dictionary.to_pylist()], np.int64)
        if len(self.codes) > len(self.sums):
            wider = np.zeros((2 * len(self.codes),) * 2, np.int64)
            wider[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = wider
        return own[named.indices.to_numpy()]

    def add(self, code: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """Terms with as many sources each: arrays of (term, source)."""
        terms, k = code.shape
        step = max(1, self.tile * self.tile // (min(k, self.tile) ** 2))
        for t in range(0, terms, step):
            for i in range(0, k, self.tile):
                for j in range(0, k, self.tile):
                    a = (slice(t, t + step), slice(i, i + self.tile))
                    b = (slice(t, t + step), slice(j, j + self.tile))
                    pa_, a0, ca = (x[a][:, :, None] for x in (p, p0, code))
                    pb, b0, cb = (x[b][:, None, :] for x in (p, p0, code))
                    value = _gain(pa_, pb) - _gain(pa_, b0) - _gain(a0, pb) + _gain(a0, b0)
                    np.add.at(self.sums, (np.broadcast_to(ca, value.shape), np.broadcast_to(cb, value.shape)), value)

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.codes)
        left, right = np.nonzero(self.sums)
        other = left != right
        left, right = left[other], right[other]
        for at in range(0, len(left), 20_000):
            i, j = left[at : at + 20_000], right[at : at + 20_000]
            a, b = [names[x] for x in i], [names[x] for x in j]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(self.sums[i, j])], schema=CORRECTION_ROWS)


CORRECTION_ROWS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def corrections(weights: DataFrame, tasks: int, pairs: int, tile: int) -> DataFrame:
    """lang, a, b and value: the sums over the terms that both sources hold, streamed term by term."""

    def whole_terms(batches) -> Iterator[pa.Table]:
        """Rows of whole terms: the last term of a batch waits for the next."""
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            last = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1]))
            n = pc.sum(last).as_py()
            left = table.slice(len(table) - n)
            if n < len(table):
                yield table.slice(0, len(table) - n)
        if left is not None:
            yield left

    def run(batches):
        squares = Squares(tile)
        for table in whole_terms(batches):
            lang, term = (_one(table[c]).dictionary_encode() for c in ("lang", "term"))
            a, t = lang.indices.to_numpy(), term.indices.to_numpy()
            code = np.zeros(len(table), np.int64)
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(table)]
            for low, high in zip(edges, edges[1:]):
                code[low:high] = squares.code(lang.dictionary[int(a[low])].as_py(), _one(table["source"].slice(low, high - low)))
            p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
            begins = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (t[1:] != t[:-1])) + 1))
            sizes = np.diff(np.append(begins, len(table)))
            for k in np.unique(sizes[sizes > 1]):
                rows = begins[sizes == k][:, None] + np.arange(k)
                squares.add(code[rows], p[rows], p0[rows])
            if len(squares.codes) ** 2 > pairs:
                yield from squares.rows()
                squares = Squares(tile)
        yield from squares.rows()

    ordered = weights.select("lang", "term", "source", "p", "p0").repartition(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP, entries: int = BLOCK_ENTRIES, pairs: int = PAIRS, tile: int = TILE, open_entries: int = OPEN_ENTRIES,
) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    spark = docs.sparkSession
    cuts = Cuts(spark, "source-divergence")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = tasks * SHARDS_PER_TASK
    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    counted = cuts.write(frequencies(runs(rows, shards, entries), shards, min_docs, open_entries), "frequencies")

    groups = rows.select("lang", "source").distinct()
    kept = counted.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = cuts.write(
        groups.join(kept, "lang", "left").join(sums, ["lang", "source"], "left")
        .select("lang", "source", zero("terms"), zero("lang_total"), zero("total"), zero("held"))
        .withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))),
        "totals",
    )
    weights = cuts.write(
        counted.join(totals, ["lang", "source"]).select(
            "lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        ),
        "weights",
    )

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = (
        weights.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    )

    side = lambda name: totals.select("lang", "terms", F.col("source").alias(name), F.col("held").alias(f"{name}_held"), F.col("p0").alias(f"{name}0"))
    two = side("a").join(side("b").drop("terms"), "lang").where("a <> b")
    histogram = weights.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    one_sided = histogram.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(
        F.sum(F.col("times") * gain(F.col("p"), F.col("other0"))).alias("forth"), F.sum(F.col("times") * gain(F.col("other0"), F.col("p"))).alias("back")
    )
    one_sided = cuts.write(one_sided, "one-sided")
    forth = one_sided.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), "forth")
    back = one_sided.select("lang", F.col("other").alias("a"), F.col("source").alias("b"), "back")
    both = cuts.write(corrections(weights, tasks, pairs, tile), "both")
    none = (F.col("terms") - F.col("a_held") - F.col("b_held")) * gain(F.col("a0"), F.col("b0"))
    value = F.when(F.col("terms") > 0, none + zero_of("forth") + zero_of("back") + zero_of("both")).otherwise(F.lit(0)).cast("bigint")
    keys = ["lang", "a", "b"]
    by_pair = (
        two.join(forth, keys, "left").join(back, keys, "left").join(both, keys, "left")
        .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
        .withColumn("rank", F.row_number().over(best))
    )
    return by_pair.unionByName(by_term)


def zero_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))
