"""From documents to training shards; each stage's rows are written and read again before the next.

A stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns the columns of ``documents`` (the last one the index of the
shards it wrote). Extra columns pass through the stages that keep rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm.common import read, saved
from clausemill.llm.decontaminate import drop_contaminated
from clausemill.llm.minhash import drop_similar
from clausemill.llm.mixing import mixed_documents
from clausemill.llm.token_shards import Vocabulary, write_shards
from clausemill.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, rejects go."""
    return drop_toxic(docs, train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of five-word shingles are alike by 0.8 or more."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: a row per slot and document in its block, as often as the mix takes it."""
    return mixed_documents(docs, block_words=256)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of all rows in training order; the rows are the index of their sequences."""
    return write_shards(docs, Vocabulary.public()).index


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: A trained classifier and a tokenizer cannot be said in SQL; tests/llm/test_pipeline.py checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
