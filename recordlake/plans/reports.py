"""Dashboard and analytics panels over the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators import aggregates as agg


def dashboard(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The panels of the overview page."""
    by_status, recent = agg.processing_panel(tables["processing_jobs"])
    return {
        "summary": agg.dashboard_summary(
            tables["documents"], tables["land_records"], tables["review_tasks"], tables["extracted_fields"]),
        "jobs_by_status": by_status, "recent_jobs": recent,
        "validation": agg.validation_panel(tables["validation_results"], tables["documents"]),
        "tiles": agg.dashboard_tiles(
            tables["documents"], tables["land_records"], tables["review_tasks"], tables["validation_results"]),
    }


def analytics(tables: dict[str, DataFrame], now: datetime) -> DataFrame:
    """Pass rate, review share, mean job duration and mean age of open reviews, in one row."""
    from ..operators.search import open_tasks

    return (
        agg.pass_rate(tables["validation_results"])
        .crossJoin(agg.review_share(tables["review_tasks"], tables["land_records"]))
        .crossJoin(agg.mean_job_duration(tables["processing_jobs"]))
        .crossJoin(agg.mean_task_age_hours(open_tasks(tables["review_tasks"]), now))
    )
