"""The registered queries of the operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import (
    bpe_replay, chat_repair, exact_dedup, license_scan, packing, pii, quality_crf, quality_rules, simhash, source_divergence, token_counts, token_files, whitening,
)

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality_crf.score(docs, quality_crf.learn(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.link(table(spark, folder, "documents")).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write_and_read(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_bpe_replay(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_replay.digests(bpe_replay.encode(table(spark, folder, "documents"), path), path)


@query
def op7_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.format_chats(table(spark, folder, "conversations"))


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
of_lang AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM held GROUP BY lang, term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
shares AS (
  SELECT d.lang, d.source, d.term, d.n, 1 + (1000000000::HUGEINT * (d.n + 1)) // (d.total + s.v) AS p,
         1 + (1000000000::HUGEINT * (o.n + 1)) // (o.total + s.v) AS q
  FROM dense d JOIN sizes s USING (lang) JOIN of_lang o ON o.lang = d.lang AND o.term = d.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
ORACLES["op4_exact_dedup"] = """
WITH docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(folded) AS text_sha256
FROM docs WINDOW same AS (PARTITION BY folded)
"""
