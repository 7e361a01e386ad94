"""Records of delimited files, read in byte ranges by as many tasks as the files have splits.

A line break ends a record only outside quotes, and whether a line starts inside quotes depends on all lines before it.
So the lines are scanned once, each range for itself, and for both cases: a line maps (outside, inside) at its start to
(outside, inside) at its end. Such maps combine associatively:

1. ``staged``: every line with its map, the state before and after it, and the records begun so far, for either state at
   the start of its range. The delimiter is not known yet, so this is done for each of the ``DELIMITERS``. Lines without
   quotes, nearly all, change nothing. Running values over a range are a pass over Arrow columns; the table is written once.
2. ``ranges``: one row per range. The maps of the ranges of a file, combined in order, give each range its true state at
   the start and the number of records before it. The encoding is a flag per line, joined per range and per file.
3. ``cells_of_lines``: ranges' states are joined to their lines. Lines that are a record by themselves are cut in place;
   only the lines of records with quoted breaks are brought together.

Cells follow the usual dialect: quotes count at the start of a cell, are doubled inside, and text behind a closing quote
is part of the cell; \\n, \\r and \\r\\n end a record; empty lines are none; an open quote at the end of a file ends there.
A record must fit into a task. Lines are cut at \\n; a file that has only \\r is one line to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.session import checkpoint

DELIMITERS = lx.DELIMITERS
#: Body of a quoted cell, behind the opening quote.
_BODY = '[^"]*+(?:""[^"]*+)*+'
_LATIN = "ISO-8859-1"


def _bar(delimiter: str) -> str:
    return re.escape(delimiter) if delimiter != "\t" else "\\t"


def _open(delimiter: str) -> str:
    """Pattern of lines that start outside quotes and end inside."""
    d = _bar(delimiter)
    return f'^(?:(?:"{_BODY}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+"{_BODY}\\z'


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of all files below ``path``."""
    return as_lines(spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path))


def as_lines(text: DataFrame) -> DataFrame:
    """(file, block, bytes, value) of a text source, batch or stream: ``block`` is where the line's range starts."""
    meta = F.col("_metadata")
    return text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("bytes"), "value")


# ---- one pass over the lines ----

STAGED = "file string, block bigint, bytes bigint, raw binary, valid boolean, ends boolean, at bigint, before int, after int, n bigint, held array<bigint>"


def _mapped(lines: DataFrame) -> DataFrame:
    """Lines, cut at single \\r too, with the bits of their maps per delimiter."""
    raw = F.col("value").cast("binary")
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(raw, _LATIN))
    turn = F.instr(text, "\r")
    parts = F.transform(F.split(F.decode(raw, _LATIN), "(?<=\r)(?!\\z)", -1), lambda x: F.encode(x, _LATIN))
    parts = F.when((turn > 0) & (turn < F.length(text)), parts).otherwise(F.array(raw))
    cut = lines.select("file", "block", "bytes", F.is_valid_utf8("value").alias("valid"), F.size(parts).alias("parts"), F.posexplode(parts).alias("part", "raw"))
    plain = F.regexp_replace(F.decode("raw", _LATIN), "^\xef\xbb\xbf", "")
    quoted = F.instr(F.decode("raw", _LATIN), '"') > 0

    def bits(start: Column) -> Column:
        out = F.lit(0)
        for i, d in enumerate(DELIMITERS):
            out = out + start.rlike(_open(d)).cast("int") * (1 << i)
        return out

    every = (1 << len(DELIMITERS)) - 1
    return cut.select(
        "file", "block", "bytes", "raw", "valid", (F.col("part") == F.col("parts") - 1).alias("ends"),
        F.when(quoted, bits(plain)).otherwise(F.lit(0)).alias("outside"),
        F.when(quoted, bits(F.concat(F.lit('"'), plain))).otherwise(F.lit(every)).alias("inside"),
        ((F.octet_length("raw") == 0) | ((F.octet_length("raw") == 1) & (F.col("raw") == F.lit("\r").cast("binary")))).alias("blank"),
    )


def running(outside: np.ndarray, inside: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each line, for one state at the start. A map is constant, keeps the state or swaps it."""
    swaps = np.cumsum(outside > inside) & 1
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    after = np.where(fixed >= 0, outside[fixed] ^ swaps[fixed] ^ swaps, start ^ swaps)
    return np.concatenate(([start], after[:-1])), after


class _Range:
    """What a range has come to: lines, lines with text, and per delimiter and start its state and records not begun."""

    def __init__(self):
        self.lines = self.full = 0
        self.state = [s for _ in DELIMITERS for s in (0, 1)]
        self.held = [0] * len(self.state)

    def add(self, outside: np.ndarray, inside: np.ndarray, blank: np.ndarray) -> tuple:
        n = self.full + np.cumsum(~blank)
        before, after = np.zeros(len(blank), np.int32), np.zeros(len(blank), np.int32)
        held = np.zeros((len(blank), len(self.state)), np.int64)
        for k in range(len(self.state)):
            was, now = running((outside >> k // 2) & 1, (inside >> k // 2) & 1, self.state[k])
            before |= (was << k).astype(np.int32)
            after |= (now << k).astype(np.int32)
            held[:, k] = self.held[k] + np.cumsum((was == 1) & ~blank)
            self.state[k], self.held[k] = int(now[-1]), int(held[-1, k])
        at = np.arange(self.lines, self.lines + len(blank))
        self.lines, self.full = self.lines + len(blank), int(n[-1])
        return at, before, after, n, held


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("file").dictionary_encode()
        codes, blocks = files.indices.to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            key = (files.dictionary[int(codes[low])].as_py(), int(blocks[low]))
            if key != now:
                now, state = key, _Range()
            part = batch.slice(low, high - low)
            bits = (part.column(c).to_numpy().astype(np.int64) for c in ("outside", "inside"))
            at, before, after, n, held = state.add(*bits, part.column("blank").to_numpy(zero_copy_only=False))
            some = held.any(axis=1)
            offsets = np.concatenate(([0], np.cumsum(np.where(some, held.shape[1], 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(held[some].ravel()), mask=pa.array(~some))
            columns = [part.column(c) for c in ("file", "block", "bytes", "raw", "valid", "ends")]
            columns += [pa.array(at), pa.array(before), pa.array(after), pa.array(n), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "bytes", "raw", "valid", "ends", "at", "before", "after", "n", "held"])


def staged(lines: DataFrame) -> DataFrame:
    """The lines with their states and counts for every delimiter and start of their range, written once."""
    return checkpoint(_mapped(lines).mapInArrow(_numbered, STAGED))


# ---- ranges and files ----


def ranges(stage: DataFrame) -> DataFrame:
    """One row per range: its map (bits of ``after``), counts, the file's first line if it is here, the encoding flag."""
    head = F.when((F.col("block") == 0) & (F.col("at") == 0), F.col("raw"))
    return stage.groupBy("file", "block").agg(
        F.max_by("after", "at").alias("after"), F.max("n").alias("n"), F.max_by(F.struct("held"), "at")["held"].alias("held"),
        F.max(head).alias("head"), F.bool_and("valid").alias("valid"), F.max("bytes").alias("bytes"),
    )


def first_lines(parts: DataFrame) -> DataFrame:
    """(file, bytes, encoding, header) of each file."""
    files = parts.groupBy("file").agg(F.max("bytes").alias("bytes"), F.max("head").alias("head"), F.bool_and("valid").alias("valid"))
    text = decoded(F.col("head"), F.col("valid"))
    return files.select(
        "file", "bytes", F.when(F.col("valid"), "UTF-8").otherwise(_LATIN).alias("encoding"),
        F.regexp_extract(F.coalesce(text, F.lit("")), "^﻿?([^\r\n]*)", 1).alias("header"),
    )


def decoded(raw: Column, valid: Column) -> Column:
    return F.when(valid, raw.cast("string")).otherwise(F.decode(raw, _LATIN))


def starts(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, block, way, base and the columns of ``files``): ``way`` picks delimiter and state, ``base`` counts records before."""
    which = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter")).cast("int") - 1
    order = Window.partitionBy("file").orderBy("block")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    bit = lambda shift: F.expr(f"(after >> (2 * which + {shift})) & 1")
    out = parts.select("file", "block", "after", "n", "held").join(files.withColumn("which", which), "file")
    out = out.withColumns({"outside": bit(0), "inside": bit(1)})
    out = out.withColumn("swaps", F.sum((F.col("outside") > F.col("inside")).cast("int")).over(so_far) % 2)
    fixed = F.last(F.when(F.col("outside") == F.col("inside"), (F.col("outside") + F.col("swaps")) % 2), ignorenulls=True).over(so_far)
    out = out.withColumn("ends", (F.coalesce(fixed, F.lit(0)) + F.col("swaps")) % 2)
    out = out.withColumn("way", (2 * F.col("which") + F.coalesce(F.lag("ends").over(order), F.lit(0))).cast("int"))
    begun = F.col("n") - F.coalesce(F.get("held", F.col("way")), F.lit(0))
    return out.withColumn("base", F.coalesce(F.sum(begun).over(earlier), F.lit(0))).select("file", "block", "way", "base", *[c for c in files.columns if c != "file"])


# ---- cells ----


def _by_delimiter(make) -> Column:
    """``make`` of the row's delimiter, as literals."""
    out = make(DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(F.col("delimiter") == d, make(d)).otherwise(out)
    return out


def cells(record: Column) -> Column:
    """The cells of a record whose quotes are closed, by the column ``delimiter``."""

    def quoted(d: str) -> Column:
        b = _bar(d)
        found = F.regexp_extract_all(F.concat(record, F.lit(d)), F.lit(f'(?s)(?:"{_BODY}"[^{b}]*+|[^{b}]*+){b}'), 0)
        whole = f'(?s)^"({_BODY})"(.*)\\z'

        def one(cell: Column) -> Column:
            c = F.substr(cell, F.lit(1), F.length(cell) - 1)
            inner = F.replace(F.regexp_extract(c, whole, 1), F.lit('""'), F.lit('"'))
            return F.when(c.startswith('"'), F.concat(inner, F.regexp_extract(c, whole, 2))).otherwise(c)

        return F.transform(found, one)

    return F.when(F.instr(record, '"') > 0, _by_delimiter(quoted)).otherwise(_by_delimiter(lambda d: F.split(record, _bar(d), -1)))


def cells_of_lines(stage: DataFrame, begin: DataFrame) -> DataFrame:
    """(file, row_number, cells and the columns of ``begin``) of all records but the first of each file.

    ``begin`` comes from ``starts`` and has ``delimiter`` and ``encoding``; files that it lacks are left out.
    """
    extra = [c for c in begin.columns if c not in ("file", "block", "way", "base")]
    state = lambda c: F.expr(f"({c} >> way) & 1")
    lines = stage.join(begin, ["file", "block"]).select(
        "file", "block", "at", "ends", *extra, state("before").alias("before"), state("after").alias("after"),
        decoded(F.col("raw"), F.col("encoding") == "UTF-8").alias("text"),
        (F.col("base") + F.col("n") - F.coalesce(F.get("held", F.col("way")), F.lit(0))).alias("row_number"),
    )
    lines = lines.where("row_number > 1 AND (before = 1 OR text NOT IN ('', '\r'))")
    alone = lines.where("before = 0 AND after = 0").select("file", "row_number", *extra, F.regexp_replace("text", "\r\\z", "").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", F.concat("text", F.when(F.col("ends"), "\n").otherwise("")).alias("text"), "after")))
    joined = lines.where("before = 1 OR after = 1").groupBy("file", "row_number").agg(pieces.alias("pieces"), *[F.first(c).alias(c) for c in extra])
    whole = F.array_join(F.col("pieces")["text"], "")
    # an open quote at the end of the file ends there
    closed = F.when(F.element_at("pieces", -1)["after"] == 1, F.concat(whole, F.lit('"'))).otherwise(F.regexp_replace(whole, "(?:\r\n|\n|\r)\\z", ""))
    records = alone.unionByName(joined.select("file", "row_number", *extra, closed.alias("record")))
    return records.select("file", "row_number", *extra, cells(F.col("record")).alias("cells"))
