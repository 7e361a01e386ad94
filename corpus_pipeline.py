"""Documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
``documents``, but for the last one, which returns the packing. ``run`` writes every stage's rows to the shared folder
and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadmill.llm import exact_dedup, packing, pii, quality_crf, simhash
from leadmill.llm.common import Cuts


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line field holds for good; it learns from the labelled ones among ``docs``."""
    return quality_crf.keep_good(docs, quality_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document that names its component."""
    return simhash.kept_rows(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", hide_personal_data),
    ("best-fit packing", pack),
]
#: SQL can express neither the classifier nor the packing; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = cuts.write(made, f"stage-{at}")
        if at:
            cuts.drop(f"stage-{at - 1}")
    return docs
