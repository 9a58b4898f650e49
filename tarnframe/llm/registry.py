"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, byte_bpe, jaccard_join, license_scan, packing, quality_classifier, quality_rules, sharding, sql, token_counts, toxicity
from .session import documents_of


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(documents, quality_classifier.train(documents, labels))


def op2_ball_tree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ball_tree.top_inner_products(vectors, F.col("vec_id") % 100 == 0)


def op3_restored_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents, toxicity.train(documents, labels))


def op4_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents_of(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents_of(spark, sf_dir))


def op6_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(documents_of(spark, sf_dir))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(documents_of(spark, sf_dir))


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(documents_of(spark, sf_dir))


def op9_prefix_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents_of(spark, sf_dir))


def op10_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(documents_of(spark, sf_dir), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bradley_terry, op2_ball_tree_top10, op3_restored_toxicity, op4_whole_token_counts, op5_license_scan, op6_byte_prefix_shards, op7_length_buckets, op8_repetition_coverage, op9_prefix_jaccard_join, op10_distinct_word_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    limits = quality_rules.RepetitionLimits()
    return {
        "op2_ball_tree_top10": sql.TOP_INNER_PRODUCTS,
        "op5_license_scan": license_scan.licenses_sql(),
        "op8_repetition_coverage": sql.repetition_sql(limits.ngram_percent, limits.line_percent, quality_rules.BASE_NGRAM, quality_rules.BASE_REPEAT_PERCENT, quality_rules.MIN_WORDS),
        "op9_prefix_jaccard_join": sql.JACCARD_COMPONENTS,
    }
