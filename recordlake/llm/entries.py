"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, importance, language, licenses, lines, packing, quality, repeats, simhash, tokens, vector_codes, winnow
from .common import bounded_batches, documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


SQL["op3_line_dedup"] = lines.SQL


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(documents(spark, sf_dir))


@query
def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(documents(spark, sf_dir))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_counts(documents(spark, sf_dir)))


@query
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(documents(spark, sf_dir)))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.learn(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = quality.learn(docs, labels, remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op13_chat"] = chat.SQL


@query
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_mark_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
