"""The queries opN_*: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.llm import license_scan, merkle, mixing, ngram_join, nn_descent, packing, pii, quality, ranked_search, secret_scan, topk_search, url_filter, whitening
from folioworks.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("print")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90, passes=2)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("listed")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under three limits that differ: tokens, segments and the tokens of the assistant's turns, which bear loss."""
    return packing.pack_examples(packing.conversation_examples(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_topk, op3_vector_packing, op4_quality_classifier, op5_source_mixing, op6_ngram_jaccard, op7_url_filter, op8_personal_data, op9_secret_scan, op10_embedding_near_dedup, op11_merkle_fingerprint, op12_embedding_whitening, op13_ranked_search, conversation_packing)}
