"""Table constraints as reports: which rows break a domain, a key, a row rule or a foreign key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as s
from ..functions.text import is_blank

# Allowed values per table and column; a NULL is only a violation where the column is required.
DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "documents": {"processing_status": s.DOCUMENT_STATUSES},
    "processing_jobs": {"status": s.JOB_STATUSES},
    "land_records": {"status": s.RECORD_STATUSES},
    "extracted_fields": {"extraction_status": s.EXTRACTION_STATUSES, "validation_status": s.VALIDATION_STATUSES},
    "validation_results": {"status": s.VALIDATION_STATUSES, "severity": s.SEVERITIES},
    "review_tasks": {"status": s.TASK_STATUSES, "priority": s.PRIORITIES},
    "reference_data": {"reference_type": s.REFERENCE_TYPES, "status": s.REFERENCE_STATUSES},
    "users": {"role": s.ROLE_NAMES, "status": s.USER_STATUSES},
}
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "land_records": [("document_id",)],
    "ocr_results": [("document_id", "page_number")],
    "extracted_fields": [("record_id", "field_name")],
    "reference_data": [("reference_type", "code", "version")],
}


def in_domain(values: Sequence[str]):
    return lambda c: c.isin(*values)


def in_range(low: float | None = None, high: float | None = None, nullable: bool = True):
    """A check that a number lies within bounds; NULL passes unless ``nullable`` is False."""
    def check(c: Column) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (c >= low)
        if high is not None:
            ok = ok & (c <= high)
        return F.when(c.isNull(), F.lit(nullable)).otherwise(ok)
    return check


def not_blank(c: Column) -> Column:
    return ~is_blank(c)


def check_domains(df: DataFrame, spec: Mapping[str, object], key: str) -> DataFrame:
    """Long violation table (key, column_name, value). ``spec`` maps a column to allowed values or a predicate."""
    def finding(name: str, rule: object) -> Column:
        check = rule if callable(rule) else in_domain(rule)
        ok = F.coalesce(check(F.col(name)), F.lit(False))
        return F.when(~ok, F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")))

    found = F.array_compact(F.array(*[finding(n, r) for n, r in spec.items()]))
    return df.select(F.col(key), F.inline(found))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def check_rows(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """Long violation table (key, rule); a rule that evaluates to NULL passes, as in a SQL CHECK."""
    found = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()
    ]))
    return df.select(F.col(key), F.explode(found).alias("rule"))


def job_time_order() -> dict[str, Column]:
    return {"job_time_order": F.col("completed_at") >= F.col("started_at")}


def approval_pair() -> dict[str, Column]:
    return {"approved_pair": F.col("approved_by").isNull() == F.col("approved_at").isNull()}


def orphans(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    left, right = on
    keys = parent.select(F.col(right).alias("_parent")).distinct()
    return child.filter(F.col(left).isNotNull()).join(keys, F.col(left) == F.col("_parent"), "left_anti")


def orphan_keys(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Missing parents with the number of child rows. Counting first keeps a frequent reference to one row."""
    left, right = on
    counted = child.filter(F.col(left).isNotNull()).groupBy(left).agg(F.count("*").alias("rows"))
    return orphans(counted, parent, (left, right))
