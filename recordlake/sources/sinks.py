"""Writing tables, logs, exports and reports."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import record_detail
from ..operators.skew import running_position

EXPORT_FORMAT = "v1"


def replace_by_key(target: DataFrame, new_rows: DataFrame, key: str) -> DataFrame:
    """Drop the target rows of every key that occurs in ``new_rows``, then add the new rows."""
    keys = new_rows.select(key).distinct()
    return target.join(keys, key, "left_anti").unionByName(new_rows)


def upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Insert or update one row per ``key``; only ``columns`` change on rows that exist."""
    changes = updates.select(
        F.col(key).alias("_u_key"), *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c != key]
    )
    joined = target.join(changes, F.col(key) == F.col("_u_key"), "full")
    fresh = F.col(key).isNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("_u_key")).alias(c)
        if f"_u_{c}" not in changes.columns:
            return F.col(c)
        take = F.col("_u_key").isNotNull() if c in columns else fresh
        return F.when(take, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def append_log(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows to an append-only table."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_records(records: DataFrame, fields: DataFrame, issues: DataFrame, documents: DataFrame,
                   now: datetime, part_rows: int) -> DataFrame:
    """One nested export row per record, with all its fields and findings; more than ``part_rows`` of them continue in further rows."""
    detail = record_detail(records, fields, issues, documents, part_rows)
    return detail.select(
        F.struct(*[F.col(c) for c in records.columns]).alias("record"),
        "part", "extracted_fields", "validation", "document",
        F.lit(now).alias("exported_at"), F.lit(EXPORT_FORMAT).alias("format_version"),
    )


def export_audit(audit: DataFrame, now: datetime, part_rows: int, slices: int | None = None) -> DataFrame:
    """Audit events per record in order, as (record_id, part, exported_at, events).

    A record with up to ``part_rows`` events has one part. Longer histories continue in further parts, so no row and
    no task grows with the history of a single record.
    """
    placed = running_position(audit, "entity_id", "timestamp", "id", slices)
    part = F.floor((F.col("position") - 1) / F.lit(part_rows)).cast("int")
    events = [F.col(c) for c in audit.columns if c != "entity_id"]
    return (
        placed.groupBy(F.col("entity_id").alias("record_id"), part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("position", *events))).alias("events"))
        .select("record_id", "part", F.lit(now).alias("exported_at"), "events")
    )


def dispatch_approved(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved records, rejects): only approved records may leave."""
    approved = F.coalesce(F.col("status") == "APPROVED", F.lit(False))
    rejects = records.filter(~approved).select(
        "record_id", F.lit("MOCK_LRMS_NOT_APPROVED").alias("error_code"), F.col("status")
    )
    return records.filter(approved), rejects


def dispatch_audit(approved: DataFrame, user_id: str, now: datetime) -> DataFrame:
    """The audit rows of a dispatch."""
    return approved.select(
        F.lit(user_id).alias("user_id"), F.lit("land_record").alias("entity_type"),
        F.col("record_id").alias("entity_id"), F.lit("MOCK_LRMS_DISPATCHED").alias("action"),
        F.lit(json.dumps({"integration": "mock-lrms", "status": "accepted"})).alias("metadata"),
        F.lit(now).alias("timestamp"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Add a one-row report to the history. The row carries its own ``date``."""
    report.withColumn("day", F.to_date("date")).write.mode("append").partitionBy("day").json(path)


def latest_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest report of a history."""
    return spark.read.schema(schema).json(path).orderBy(F.desc("date")).limit(1)


def render_report(row) -> str:
    """Markdown of one report row: nested values as tables, everything else as a list."""
    def shown(value):
        return round(value, 4) if isinstance(value, float) else value

    lines = ["# Evaluation report", ""]
    values = row.asDict(recursive=True)
    lines += [f"- {k}: {shown(v)}" for k, v in values.items() if not isinstance(v, (dict, list))]
    for name, value in values.items():
        if isinstance(value, dict):
            lines += ["", f"## {name}", "", "| key | value |", "|---|---|"]
            lines += [f"| {k} | {shown(v)} |" for k, v in sorted(value.items())]
    return "\n".join(lines) + "\n"
