"""Scores of extraction and of text recognition against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELD_VERDICTS


def evaluate_documents(verdicts: DataFrame) -> DataFrame:
    """Verdict counts and accuracy per document out of (id, field_name, verdict)."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in FIELD_VERDICTS]
    return verdicts.groupBy("id").agg(
        *counts, F.count("*").alias("fields"),
        F.round(F.try_divide(F.count_if(F.col("verdict") == "CORRECT").cast("double"), F.count("*").cast("double")), 4)
        .alias("accuracy"),
    )


def accuracies(verdicts: DataFrame) -> DataFrame:
    """Verdict counts and accuracy by document and by field name, in one pass; ``by_document`` tells which of the two a row is."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in FIELD_VERDICTS]
    share = F.try_divide(F.count_if(F.col("verdict") == "CORRECT").cast("double"), F.count("*").cast("double"))
    return (verdicts.groupingSets([["id"], ["field_name"]], "id", "field_name")
            .agg((F.grouping("id") == 0).alias("by_document"), *counts, F.count("*").alias("fields"), F.round(share, 4).alias("accuracy")))


def evaluation_summary(documents: DataFrame) -> DataFrame:
    """Documents, failures, mean of the document accuracies and verdict totals.

    ``documents`` has one row per document with ``failed`` and, unless failed, the columns of ``evaluate_documents``.
    """
    totals = [F.coalesce(F.sum(v.lower()), F.lit(0)).alias(v.lower()) for v in FIELD_VERDICTS]
    return documents.agg(
        F.count("*").alias("documents"), F.count_if("failed").alias("failures"),
        F.avg("accuracy").alias("mean_accuracy"), *totals,
    )


def field_accuracy(verdicts: DataFrame) -> DataFrame:
    correct = F.count_if(F.col("verdict") == "CORRECT")
    return verdicts.groupBy("field_name").agg(
        correct.alias("correct"), F.count("*").alias("total"),
        F.round(F.try_divide(correct.cast("double"), F.count("*").cast("double")), 4).alias("accuracy"),
    )


def ocr_summary(df: DataFrame) -> DataFrame:
    """Documents, failures, mean error rates of those that did not fail, total seconds."""
    ok = ~F.coalesce(F.col("failed"), F.lit(False))
    return df.agg(
        F.count("*").alias("documents"), F.count_if(~ok).alias("failures"),
        F.avg(F.when(ok, F.col("cer"))).alias("mean_cer"), F.avg(F.when(ok, F.col("wer"))).alias("mean_wer"),
        F.sum("seconds").alias("total_seconds"),
    )


def phase_means(df: DataFrame) -> DataFrame:
    """Mean error rates per phase for all documents, and for English and other scripts apart."""
    group = F.when(F.col("family") == "english", "english").otherwise("other")
    staged = df.select("phase", group.alias("script_group"), "cer", "wer", "seconds")
    means = [F.avg(m).alias(f"mean_{m}") for m in ("cer", "wer", "seconds")]
    return (
        staged.groupingSets([["phase", "script_group"], ["phase"]], "phase", "script_group")
        .agg(*means, F.count("*").alias("documents"))
        .withColumn("script_group", F.coalesce("script_group", F.lit("all")))
    )
