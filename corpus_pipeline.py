"""Training-corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame. Each stage works on all that its predecessor
kept; its result is written as Parquet and read again as the next stage's documents.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables, and read no column but doc_id,
text and source (n_chars is written anew where a text changes), so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlytics.llm import decontaminate, near_copies, packing, quality, secrets
from trajlytics.llm.common import staged, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half go on. Texts without words do not; repeated rows share their fate."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard similarity of 0.8 or more) goes on: the smallest doc_id,
    null last. Texts without words are copies of each other; repeated rows are one."""
    return near_copies.keep_one(docs)


def documents_without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item within the edit budget go; null and empty texts contain none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def documents_without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and n_chars follows its text (null for a null text)."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2048 tokens without copies, and with at most two pieces of a source (null is one source)."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", documents_without_leaks),
    ("secret_scans", documents_without_secrets),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither fingerprints, edit distances, forests nor sequential packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
