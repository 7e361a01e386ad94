"""Delimited lead files of any encoding, delimiter and header, many files at a time.

Every file is one import. Encoding, delimiter and header mapping are found per file by column expressions; its records
are read in as many tasks as the file has splits (see ``records``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions.normalize import blank_to_null, canonical_domain, parse_number
from leadmill.session import checkpoint
from leadmill.sources import records as rc

FIELDS = list(lx.HEADER_SYNONYMS)


def header_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9/]+", " "))


def header_field(c: Column | str) -> Column:
    """The lead field a header stands for, NULL if none."""
    words = {}
    for field, names in lx.HEADER_SYNONYMS.items():
        for name in names:
            words.setdefault(field, []).append(" ".join("".join(
                ch if ch.isalnum() or ch == "/" else " " for ch in name).split()))
    out = F.lit(None).cast("string")
    key = header_key(c)
    for field, names in words.items():
        out = F.when(key.isin(names), field).otherwise(out)
    return out


def map_headers(headers: DataFrame) -> DataFrame:
    """(file, pos, header) -> adds field (NULL = unmapped); the first header of a field wins.

    One header line per file, so a file's group is as small as its line.
    """
    named = headers.withColumn("candidate", header_field("header")).filter(F.col("header") != "")
    turn = F.row_number().over(Window.partitionBy("file", "candidate").orderBy("pos"))
    return named.withColumn(
        "field", F.when(F.col("candidate").isNotNull() & (turn == 1), F.col("candidate"))
    ).drop("candidate")


def infer_delimiter(line: Column) -> Column:
    """The delimiter that occurs most in the header line; comma if none does."""
    counts = [
        F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
        for i, d in enumerate(lx.DELIMITERS)
    ]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def file_looks(parts: DataFrame) -> DataFrame:
    """(file, bytes, encoding, header, delimiter): one row per file, from its ranges."""
    return rc.first_lines(parts).withColumn("delimiter", infer_delimiter(F.col("header")))


def header_cells() -> Column:
    """Cells of the header line, quotes removed."""
    return rc.cells(F.col("header"))


def header_table(looks: DataFrame) -> DataFrame:
    """(file, pos, header)."""
    return looks.select("file", F.posexplode(header_cells()).alias("pos", "header"))


def file_report(looks: DataFrame, mapped: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per file: source tag, unmapped headers and, for unusable ones, the error code."""
    per_file = mapped.groupBy("file").agg(
        F.array_sort(F.collect_set("field")).alias("fields"),
        F.array_sort(F.collect_list(F.when(F.col("field").isNull(), F.struct("pos", "header")))).alias("u"),
    )
    out = looks.join(per_file, "file", "left")
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    too_large = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    error = (
        F.when(F.col("bytes") == 0, "IMPORT_EMPTY_FILE")
        .when(too_large, "IMPORT_TOO_LARGE")
        .when(~F.array_contains(fields, "domain") & ~F.array_contains(fields, "name"), "IMPORT_INVALID_CSV")
    )
    vendor = F.size(F.array_except(F.array(*[F.lit(f) for f in lx.VENDOR_FIELDS]), fields)) == 0
    return out.select(
        "file", "bytes", "encoding", "delimiter", "header",
        F.when(vendor, "vendor_csv").otherwise("csv").alias("source"),
        F.transform(F.coalesce("u", F.array().cast("array<struct<pos:int,header:string>>")), lambda x: x["header"]).alias("unmapped"),
        error.alias("error"),
    )


def typed_rows(raw: DataFrame) -> DataFrame:
    """Blank words to NULL in every field, numbers parsed; keeps file and row_number."""
    out = {}
    for f in FIELDS:
        v = blank_to_null(f) if f in raw.columns else F.lit(None).cast("string")
        out[f] = parse_number(v) if f in ("employees", "revenue") else v
    return raw.select("file", "row_number", *[v.alias(k) for k, v in out.items()]).withColumnRenamed("domain", "website")


def skip_nameless(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a name or website, skipped count per file with its warning text)."""
    lost = F.col("website").isNull() & F.col("name").isNull()
    counts = rows.groupBy("file").agg(
        F.count_if(lost).alias("skipped"), F.count_if(~lost).alias("kept")
    )
    text = F.concat(F.col("skipped").cast("string"), F.lit(" rows had no company name or website and were skipped."))
    return rows.filter(~lost), counts.withColumn("warning", F.when(F.col("skipped") > 0, text))


def read_leads(spark: SparkSession, path: str | list[str], max_bytes: int | None = None,
               max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lead rows, file report) of all files below ``path`` (one or more), rows numbered from 2.

    The size and row limits of an interactive upload are off unless given; a file over the row limit, counted in
    rows with a name or website, is rejected whole.
    """
    return staged_leads(rc.staged(rc.text_lines(spark, path)), max_bytes, max_rows)


def staged_leads(stage: DataFrame, max_bytes: int | None = None, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same from staged lines."""
    parts = checkpoint(rc.ranges(stage))
    looks = checkpoint(file_looks(parts))
    report = file_report(looks, map_headers(header_table(looks)), max_bytes)
    named = looks.withColumn("named", F.transform(header_cells(), header_field))
    fields = F.transform("named", lambda f, i: F.when(F.array_position(F.col("named"), f) == i + 1, f))
    usable = F.array_contains("named", "domain") | F.array_contains("named", "name")
    if max_bytes is not None:
        usable = usable & (F.col("bytes") <= max_bytes)
    files = named.filter(F.coalesce(usable, F.lit(False))).select("file", "encoding", "delimiter", fields.alias("fields"))
    found = rc.cells_of_lines(stage, rc.starts(parts, files))
    cell = lambda f: F.get("cells", F.array_position("fields", f).cast("int") - 1)
    rows = found.select("file", "row_number", *[cell(f).alias(f) for f in FIELDS])
    if max_rows is not None:
        counted = skip_nameless(typed_rows(rows))[0]
        over = counted.groupBy("file").count().filter(F.col("count") > max_rows).select("file")
        rows = rows.join(over, "file", "left_anti")
        report = report.join(over.withColumn("over", F.lit(True)), "file", "left").withColumn(
            "error", F.when(F.col("over"), "IMPORT_TOO_MANY_ROWS").otherwise(F.col("error"))
        ).drop("over")
    return typed_rows(rows), report


def with_order(rows: DataFrame) -> DataFrame:
    """Adds ``seq``, the order of rows over files: by file, then row number.

    Ids grow along the range-sorted partitions; they are written once so that no recomputed
    partition gets others.
    """
    ordered = rows.orderBy("file", "row_number").withColumn("seq", F.monotonically_increasing_id())
    return checkpoint(ordered)


# ---- domain lists ---------------------------------------------------------


def domain_list(lists: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line, numbered from 1 with blank lines counted."""
    lines = lists.select("file", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "line"))
    entry = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return lines.select("file", (F.col("pos") + 1).alias("row_number"), entry.alias("website")).filter("website <> ''")


def pasted_domains(texts: DataFrame, text: str = "text") -> DataFrame:
    """Tokens with a dot, lower-cased, distinct, in first-seen order (file, pos, token)."""
    tokens = texts.select("file", F.posexplode(F.split(text, r"[\s,;]+")).alias("pos", "token"))
    tokens = tokens.select("file", "pos", F.lower("token").alias("token")).filter(F.col("token").contains("."))
    return tokens.groupBy("file", "token").agg(F.min("pos").alias("pos"))


def usable_domains(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with a registrable domain, dropped count per file with its warning text)."""
    seen = entries.withColumn("domain", canonical_domain("website"))
    bad = F.col("domain").isNull()
    counts = seen.groupBy("file").agg(F.count_if(bad).alias("dropped"), F.count_if(~bad).alias("kept"))
    text = F.concat(F.lit("Skipped "), F.col("dropped").cast("string"), F.lit(" entries that aren't valid domains."))
    return seen.filter(~bad), counts.withColumn("warning", F.when(F.col("dropped") > 0, text))


def import_jobs(decided: DataFrame, report: DataFrame) -> DataFrame:
    """One import record per file: source, rows and duplicates removed from the decisions."""
    counts = decided.groupBy("file").agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("decision") != "keep").alias("duplicates_removed")
    )
    return report.filter("error IS NULL").select("file", "source").join(counts, "file", "left").select(
        F.xxhash64("file").alias("job_id"), "file", "source", F.lit("queued").alias("status"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("duplicates_removed", F.lit(0)).alias("duplicates_removed"),
    )
