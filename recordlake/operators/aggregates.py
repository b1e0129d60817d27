"""Counts, shares and means over records, issues, tasks, jobs and audit events.

Reports are long tables (metric, key, value) wherever the number of keys comes from the data, so nothing has to be
collected into one row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import has_evidence
from ..schemas import OPEN_TASK_STATUSES


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key; NULL and empty count as UNKNOWN."""
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("UNKNOWN"))
    return df.groupBy(name.alias(key)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """``count_by`` with the largest group first."""
    return count_by(df, key).orderBy(F.desc("n"), F.asc(key))


def sum_counts(counts: Column) -> Column:
    """Sum of a count map; NULL counts are 0."""
    return F.aggregate(
        F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v.cast("long"), F.lit(0).cast("long"))
    )


def _is_open(status: str = "status") -> Column:
    return F.col(status).isin(*OPEN_TASK_STATUSES)


def _metric(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def _labelled(counts: DataFrame, metric: str, key: str) -> DataFrame:
    return _metric(counts, metric, F.col(key), F.col("n"))


def dashboard_summary(documents: DataFrame, records: DataFrame, tasks: DataFrame, fields: DataFrame) -> DataFrame:
    """Totals, counts by status, open reviews and mean confidence, as (metric, key, value)."""
    none = F.lit(None).cast("string")
    return (
        _metric(documents.agg(F.count("*").alias("n")), "documents_total", none, F.col("n"))
        .unionByName(_labelled(count_by(documents, "processing_status"), "documents_by_status", "processing_status"))
        .unionByName(_labelled(count_by(records, "status"), "records_by_status", "status"))
        .unionByName(_metric(tasks.agg(F.count_if(_is_open()).alias("n")), "open_reviews", none, F.col("n")))
        .unionByName(_metric(fields.agg(F.avg("confidence").alias("n")), "average_confidence", none, F.col("n")))
    )


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def processing_panel(jobs: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Status counts over the ``n`` newest jobs only, and those jobs."""
    recent = recent_jobs(jobs, n)
    return count_by(recent, "status"), recent


def validation_panel(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """Issues by severity and by status, and the number of blocked documents, as (metric, key, value)."""
    blocked = documents.agg(F.count_if(F.col("processing_status") == "VALIDATION_FAILED").alias("n"))
    return (
        _labelled(count_by(issues, "severity"), "issues_by_severity", "severity")
        .unionByName(_labelled(count_by(issues, "status"), "issues_by_status", "status"))
        .unionByName(_metric(blocked, "blocked_documents", F.lit(None), F.col("n")))
    )


def severity_histogram(df: DataFrame) -> DataFrame:
    """Issues per severity out of an ``issues`` array column."""
    return count_by(df.select(F.explode("issues").alias("i")).select("i.severity"), "severity")


def pass_rate(issues: DataFrame) -> DataFrame:
    """Share of evaluated checks that passed; NOT_CHECKED does not count, NULL when nothing was evaluated."""
    evaluated = F.col("status").isin("PASS", "WARNING", "FAIL", "REVIEW_REQUIRED")
    return issues.agg(
        F.try_divide(
            F.count_if(F.col("status") == "PASS").cast("double"), F.count_if(evaluated).cast("double")
        ).alias("pass_rate")
    )


def review_share(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Open reviews per record, NULL without records."""
    return tasks.agg(F.count_if(_is_open()).alias("open_reviews")).crossJoin(
        records.agg(F.count("*").alias("records"))
    ).withColumn("review_share", F.try_divide(F.col("open_reviews").cast("double"), F.col("records").cast("double")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def mean_job_duration(jobs: DataFrame) -> DataFrame:
    """Mean seconds of jobs with both times in order, and how many there are."""
    span = seconds_between(F.col("started_at"), F.col("completed_at"))
    return jobs.select(F.when(span >= 0, span).alias("s")).agg(F.avg("s").alias("seconds"), F.count("s").alias("jobs"))


def mean_task_age_hours(tasks: DataFrame, now: datetime) -> DataFrame:
    """Mean age in hours at ``now``; tasks from the future do not count."""
    hours = seconds_between(F.col("created_at"), F.lit(now)) / 3600
    return tasks.select(F.when(hours >= 0, hours).alias("h")).agg(F.avg("h").alias("hours"), F.count("h").alias("tasks"))


def audit_counts(audit: DataFrame) -> DataFrame:
    officer = F.coalesce(F.col("user_id"), F.lit("")) != ""
    return audit.agg(
        F.count_if(F.col("action") == "FIELD_CORRECTED").alias("corrections"),
        F.count_if(officer).alias("officer_events"),
        F.count_if(~officer).alias("system_events"),
    )


def record_page_counts(issues: DataFrame, fields: DataFrame, audit: DataFrame) -> DataFrame:
    """Blocking findings, warnings, cited fields and corrections per record."""
    per_issue = issues.groupBy("record_id").agg(
        F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).alias("blocking"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )
    cited = has_evidence(F.col("bounding_box"), F.col("source_text"), F.col("source_page"))
    per_field = fields.groupBy("record_id").agg(F.count_if(cited).alias("cited_fields"))
    per_event = audit.groupBy(F.col("entity_id").alias("record_id")).agg(
        F.count_if(F.col("action") == "FIELD_CORRECTED").alias("corrections")
    )
    joined = per_issue.join(per_field, "record_id", "full").join(per_event, "record_id", "full")
    return joined.na.fill(0, ["blocking", "warnings", "cited_fields", "corrections"])


def queue_tiles(tasks: DataFrame) -> DataFrame:
    """Tiles over an open queue: pending, high or urgent, unassigned, in progress."""
    pending = F.count_if(F.col("status") == "PENDING")
    return tasks.agg(
        pending.alias("pending"),
        F.count_if(F.col("priority").isin("HIGH", "URGENT")).alias("high"),
        F.count_if(F.coalesce(F.col("assigned_to"), F.lit("")) == "").alias("unassigned"),
        (F.count("*") - pending).alias("in_progress"),
    )


def dashboard_tiles(documents: DataFrame, records: DataFrame, tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of tile numbers. ``non_warning_issues`` counts everything that is not a warning, INFO included."""
    warnings = F.count_if(F.col("severity") == "WARNING")
    return (
        records.agg(
            F.count("*").alias("records_total"),
            F.count_if(F.col("status") == "APPROVED").alias("approved"),
            F.count_if(F.col("status") == "READY_FOR_APPROVAL").alias("ready"),
        )
        .crossJoin(documents.agg(
            F.count("*").alias("documents_total"),
            F.count_if(F.col("processing_status") == "PROCESSING").alias("processing"),
            F.count_if(F.col("processing_status") == "UPLOADED").alias("uploaded"),
        ))
        .crossJoin(tasks.agg(F.count_if(_is_open()).alias("pending_review")))
        .crossJoin(issues.agg(
            F.count("*").alias("issues_total"), warnings.alias("warning_issues"),
            (F.count("*") - warnings).alias("non_warning_issues"),
        ))
    )


def stage_latency(jobs: DataFrame) -> DataFrame:
    """Seconds per document and stage, as a long table (stage, document_id, seconds)."""
    return jobs.select("stage", "document_id", F.col("seconds").cast("double").alias("seconds"))


def stage_latency_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage").agg(
        F.count("*").alias("documents"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds")
    )


def stage_failures(jobs: DataFrame) -> DataFrame:
    """Failed documents per stage, as a long table (stage, document_id)."""
    return jobs.filter(F.coalesce(F.col("failed"), F.lit(False))).select("stage", "document_id")


def verdict_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("verdict") == "READY_FOR_APPROVAL").alias("ready"),
        F.count_if(F.col("verdict") == "REVIEW_REQUIRED").alias("review"),
        F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"),
    )


def review_rate(df: DataFrame) -> DataFrame:
    """Share of documents whose verdict asks for a person; NULL without documents."""
    hit = F.coalesce(F.col("verdict").isin("REVIEW_REQUIRED", "BLOCKED"), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias("review_rate"))


def distinct_providers(df: DataFrame) -> DataFrame:
    """Provider and model pairs of successful outputs, sorted."""
    return df.filter(~F.coalesce(F.col("failed"), F.lit(False))).select("provider", "model").distinct().orderBy("provider", "model")


def flagged_fields(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("review_required").alias("flagged"), F.count("*").alias("total"))


# Measures the documents describe without code ---------------------------------------------------------------------

def rule_confusion(df: DataFrame) -> DataFrame:
    """TP, FP, TN, FN per rule from ``expected`` and ``flagged`` booleans."""
    def hit(expected: bool, flagged: bool) -> Column:
        return F.count_if((F.col("expected") == expected) & (F.col("flagged") == flagged))

    return df.groupBy("rule_id").agg(
        hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(False, False).alias("tn"), hit(True, False).alias("fn")
    )


def correction_rate_by_band(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Share of fields of each band that were corrected at least once."""
    changed = corrections.select(
        F.col("land_record_id").alias("record_id"), "field_name", F.lit(1).alias("_c")
    ).distinct()
    joined = fields.join(changed, ["record_id", "field_name"], "left")
    return joined.groupBy("band").agg(
        F.count("*").alias("fields"), F.count("_c").alias("corrected"),
        (F.count("_c") / F.count("*")).alias("correction_rate"),
    )


def review_effort(tasks: DataFrame, records: DataFrame, fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Share of records reviewed, mean hours to completion, share of fields corrected."""
    span = seconds_between(F.col("created_at"), F.col("completed_at")) / 3600
    reviewed = tasks.agg(F.countDistinct("land_record_id").alias("reviewed"), F.avg(F.when(span >= 0, span)).alias("mean_hours"))
    changed = corrections.select("land_record_id", "field_name").distinct().agg(F.count("*").alias("changed"))
    total = records.agg(F.count("*").alias("records")).crossJoin(fields.agg(F.count("*").alias("fields")))
    return reviewed.crossJoin(changed).crossJoin(total).select(
        F.try_divide(F.col("reviewed").cast("double"), F.col("records").cast("double")).alias("reviewed_share"),
        "mean_hours",
        F.try_divide(F.col("changed").cast("double"), F.col("fields").cast("double")).alias("corrected_share"),
    )


def field_precision_recall(verdicts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per field: MISSING is a miss, HALLUCINATED a false hit, INCORRECT both."""
    def n(*names: str) -> Column:
        return F.count_if(F.col("verdict").isin(*names)).cast("double")

    tp, fp, fn = n("CORRECT"), n("HALLUCINATED", "INCORRECT"), n("MISSING", "INCORRECT")
    return verdicts.groupBy("field_name").agg(
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def split_bucket(doc_id: Column, dev: int = 70, validation: int = 15) -> Column:
    """Stable dev, validation or test split out of the first 32 bits of the id's SHA-256."""
    number = F.conv(F.left(F.sha2(doc_id.cast("string"), 256), F.lit(8)), 16, 10).cast("long")
    bucket = F.pmod(number, F.lit(100))
    return F.when(bucket < dev, "dev").when(bucket < dev + validation, "validation").otherwise("test")
