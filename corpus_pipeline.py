"""A training corpus from raw documents: five stages, each written as Parquet and read again before the next.

Low quality goes, one document of each group of near copies stays, leaked benchmark questions go, sources are mixed to
their targets, and the result is written as token ids, of which the last stage returns the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pickflow.llm import decontaminate, mixing, parity_join, quality, token_files
from pickflow.llm.common import scratch, table
from pickflow.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 or more, the one with the smallest id."""
    return parity_join.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question, as it is or with other numbers, names and units."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat_rows(docs)


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the corpus as token ids, read from the files written."""
    return token_files.tokenized(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", mixed_sources),
    ("token files", token_index),
]

#: A learned classifier and hashed shingles are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
