"""A corpus cleaned and packed in stages; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlake.llm import copies, decontaminate, language, lines, packing
from recordlake.llm.common import bounded_batches, documents, remainder, written


def named_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects, or that have no letter, go."""
    bounded_batches(spark)
    return language.accepted(docs, language.learn(docs, remainder("doc_id", 4) != 2))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them."""
    return lines.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays, the one with the smallest id."""
    bounded_batches(spark)
    return copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and packed into sequences."""
    bounded_batches(spark)
    return packing.packed_documents(docs)


STAGES = [("language", named_language), ("line_dedup", own_lines), ("near_dedup", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]
#: Fingerprints and token ids have no counterpart in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
