"""From raw documents to a weighted mixture: language, near-copies, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one. All but the last
return the columns of `documents`, whatever they are, and only take rows away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import decontaminate, language, mixing, simhash
from tallyspan.llm.common import read, settle
from tallyspan.llm.queries import quality_weights


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language holds a third of the words, go."""
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or in other words, go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes, by source weights and labelled quality."""
    return mixing.mix(docs, quality_weights(spark, sf_dir))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: No SQL form: language models and latent retrieval are learned from the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
