"""Filters, ordering and paging of records, review tasks and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..schemas import OPEN_TASK_STATUSES, RECORD_STATUSES

# --- fixed values -----------------------------------------------------------
SEARCH_COLUMNS = {
    "owner": "owner_name",
    "survey_number": "survey_number",
    "khasra_number": "khasra_number",
    "village": "village",
    "tehsil": "tehsil",
    "district": "district",
}
# ----------------------------------------------------------------------------


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive literal containment; no character acts as a wildcard."""
    return F.contains(F.lower(c), F.lower(F.lit(text)))


def search_records(df: DataFrame, **filters: str | None) -> DataFrame:
    """Records that meet all given filters; blank filters are ignored, an unknown status is refused."""
    given = {k: v.strip() for k, v in filters.items() if v and v.strip()}
    unknown = set(given) - set(SEARCH_COLUMNS) - {"status"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    status = given.pop("status", None)
    if status is not None:
        if status not in RECORD_STATUSES:
            raise ValueError(f"unknown status: {status}")
        df = df.filter(F.col("status") == status)
    for name, text in given.items():
        df = df.filter(contains_text(F.col(SEARCH_COLUMNS[name]), text))
    return df


def open_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin(*OPEN_TASK_STATUSES))


def union_open(pending: DataFrame, in_review: DataFrame) -> DataFrame:
    return pending.unionByName(in_review)


def filter_queue(tasks: DataFrame, query: str = "", status: str = "", priority: str = "", assignee: str = "",
                 me: str = "") -> DataFrame:
    """Review queue filter; priority HIGH_PLUS means HIGH or URGENT, assignee is MINE or UNASSIGNED."""
    if status:
        tasks = tasks.filter(F.col("status") == status)
    if priority == "HIGH_PLUS":
        tasks = tasks.filter(F.col("priority").isin("HIGH", "URGENT"))
    elif priority:
        tasks = tasks.filter(F.col("priority") == priority)
    if assignee == "MINE":
        tasks = tasks.filter(F.col("assigned_to").eqNullSafe(me))
    elif assignee == "UNASSIGNED":
        tasks = tasks.filter(F.coalesce(F.col("assigned_to"), F.lit("")) == "")
    if query.strip():
        shown = F.concat(
            F.coalesce(F.col("reason"), F.lit("")), F.lit(" "),
            F.coalesce(F.col("land_record_id").cast("string"), F.lit("")),
        )
        tasks = tasks.filter(contains_text(shown, query.strip()))
    return tasks


def queue_order(mode: str = "PRIORITY") -> list[Column]:
    if mode == "OLDEST":
        return [F.asc("created_at"), F.asc("id")]
    if mode == "NEWEST":
        return [F.desc("created_at"), F.asc("id")]
    return [labels.priority_rank(F.col("priority")).asc(), F.asc("created_at"), F.asc("id")]


def sort_queue(tasks: DataFrame, mode: str = "PRIORITY") -> DataFrame:
    return tasks.orderBy(*queue_order(mode))


def describe_audit(audit: DataFrame) -> DataFrame:
    """Display form of audit events; ``old_value``, ``new_value`` and ``metadata`` are JSON text."""
    as_map = {c: F.from_json(c, "map<string,string>") for c in ("old_value", "new_value", "metadata")}
    reason = F.element_at(as_map["metadata"], "reason")
    user = F.col("user_id")
    return audit.select(
        "id", "entity_id", "timestamp", "action",
        labels.audit_title(F.col("action")).alias("title"),
        labels.audit_source(user).alias("source"),
        labels.audit_actor(user).alias("actor"),
        labels.audit_description(F.col("action"), reason).alias("description"),
        labels.audit_changes(as_map["old_value"], as_map["new_value"]).alias("changes"),
    )


def filter_audit(events: DataFrame, source: str = "", category: str = "ALL", query: str = "") -> DataFrame:
    """Filter described events by source, by OFFICER or SYSTEM, and by free text."""
    if source:
        events = events.filter(F.col("source") == source)
    if category != "ALL":
        kind = F.when(F.col("source") == "Officer", "OFFICER").otherwise("SYSTEM")
        events = events.filter(kind == category)
    if query.strip():
        parts = F.flatten(F.transform("changes", lambda c: F.array(c["label"], c["old"], c["new"])))
        shown = F.concat_ws(" ", "title", "source", "actor", "description", parts)
        events = events.filter(contains_text(shown, query.strip()))
    return events


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows; planned as a top-n, not as a full sort."""
    return df.orderBy(*order).limit(n)


def page_rows(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Rows of a 1-based page; a page past the end is empty.

    Reaching a page costs as much as all pages before it, so this is for the first few. Go on with :func:`page_after`, or reach any
    number in a :class:`~recordlake.sources.pages.PagedTable`.
    """
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: dict | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow the row with the values ``after``, however deep; the first ones for None.

    ``order`` names the columns and whether they ascend; together they must tell rows apart, and NULLs come last. The last row of a
    page is the ``after`` of the next one. Rows before it are filtered at the scan and never sorted.
    """
    if limit < 1:
        raise ValueError("limit starts at 1")
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, ascending in order:
            c, value = F.col(name), F.lit(after[name])
            later = F.lit(False) if after[name] is None else c.isNull() | ((c > value) if ascending else (c < value))
            beyond = beyond | (same & later)
            same = same & c.eqNullSafe(value)
        df = df.filter(beyond)
    return df.orderBy(*[F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in order]).limit(limit)


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> tuple[DataFrame, int]:
    """A page and the total number of rows."""
    return page_rows(df, order, number, limit), df.count()


def page_records(df: DataFrame, number: int, limit: int) -> tuple[DataFrame, int]:
    return page(df, [F.desc("updated_at"), F.asc("record_id")], number, limit)


def page_tasks(df: DataFrame, number: int, limit: int) -> tuple[DataFrame, int]:
    return page(df, [F.desc("created_at"), F.desc("id")], number, limit)


def page_audit(df: DataFrame, number: int, limit: int) -> tuple[DataFrame, int]:
    return page(df, [F.asc("timestamp"), F.asc("id")], number, limit)
