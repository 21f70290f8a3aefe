"""A training-text pipeline: poor documents go, near copies go, benchmark text goes, personal data is hidden, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import byte_bpe, decontaminate, near_copies as copies, pseudonyms, quality_bayes
from tablewright.llm.queries import KEY, RANKS
from tablewright.session import keep, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bayes.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.drop_near_copies(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = pseudonyms.pseudonymise(docs, KEY)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark_text", benchmark_text), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        given, docs = docs, keep(stage(spark, docs, sf_dir))
        release(given)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the keyed permutation have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
