"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage takes the documents that the one before kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, ngram_jaccard, suffix_dedup, toxicity
from tidewatch.llm.common import staged, table

#: The toxicity model is no SQL, so neither are the documents that it leaves.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    training = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.clean_documents(docs, toxicity.train(staged(training, "toxicity-training")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group of similar documents."""
    return ngram_jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of 200 bytes; ``n_chars`` follows the text."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by the target weights of their sources, shuffled."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
