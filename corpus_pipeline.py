"""From raw documents to packed sequences: five stages, each written and read again before the next.

quality classifier -> n-gram Jaccard join -> secret scans -> mixing sources to target weights -> packing

Each stage lets Spark hand texts to Python in small batches, also for the caller who writes its result, so the session keeps that setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.llm import mixing, ngram_join, packing, quality, secret_scan
from folioworks.llm.common import keep, small_batches, table

#: Trained classifiers and seeded choices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject. Each row is judged by its own text, whatever its id.

    Null, empty and blank texts are scored by their statistics as any others are, very long ones by the whole text;
    repeated rows are judged alike; no columns of the table clash, since each row passes through whole.
    """
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id stays, null last, ties by a hash of id and text. Rows with one id or none count one by one; of rows
    that are equal in id and text one stays. Null, empty and blank texts are near copies of nothing and all stay.
    """
    small_batches(spark)
    return ngram_join.keep_first(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by [SECRET]; n_chars follows. Null and empty texts stay as they are; repeated rows are treated alike."""
    small_batches(spark)
    return secret_scan.redact(docs).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's corpus: each document's text is what the mix takes of it; n_chars follows.

    Null, empty and blank texts hold no words and are left out; a null source is a source of its own; rows are planned
    one by one, repeated and null ids included, so the words out are the words planned.
    """
    small_batches(spark)
    return mixing.take(docs, mixing.mix(docs)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens. A null text is empty and has its end id alone; repeated rows are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
