"""Registered queries: each runs one operator with production parameters over its whole table.

What null ids and texts, empty and long texts, ties, repeated rows and empty tables give is stated by the operator that a query
calls; a query adds no rule of its own, and reads no column but those that its operator names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlytics.llm import decontaminate, divergence, licenses, line_dedup, manifest, packing, passage_quality, pseudonyms, quality, secrets, sharding, simhash, url_rules
from trajlytics.llm.common import staged_path, table
from trajlytics.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: Words that a repeated run of lines and sentences must have.
DEDUP_MIN_WORDS = 16
#: For test data; a cluster names its own key in spark.trajlytics.pii.key.
PII_KEY = "not a secret: test tables only"


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_pos", "end_pos", F.round("probability", 6).alias("probability"))


def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_url_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those of pages whose document is labelled: blocked if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", bad)
    return url_rules.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op4_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_units(table(spark, sf_dir, "documents"), "passage", DEDUP_MIN_WORDS)
    return found.select("doc_id", "unit_no", "start_pos", "end_pos", "n_words", F.lower(F.hex("digest")).alias("digest"), "keep_doc_id", "keep_start_pos")


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), staged_path(spark, "shards"), n_shards=24)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shards.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.trajlytics.pii.key", PII_KEY).encode()
    return pseudonyms.find_private(table(spark, sf_dir, "documents"), key)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_bitmap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.audited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_consed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def callables() -> dict[str, Query]:
    return {
        "op1_secret_forest": op1_secret_forest,
        "op2_license_windows": op2_license_windows,
        "op3_url_associations": op3_url_associations,
        "op4_qgram_lemma": op4_qgram_lemma,
        "op5_weak_supervision": op5_weak_supervision,
        "op6_line_dedup": op6_line_dedup,
        "op7_external_shuffle": op7_external_shuffle,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
        "op10_simhash_pivots": op10_simhash_pivots,
        "op11_bitmap_manifest": op11_bitmap_manifest,
        "op12_attention_mil": op12_attention_mil,
        "op13_consed_trees": op13_consed_trees,
    }


def checks() -> dict[str, str]:
    return dict(ORACLES)
