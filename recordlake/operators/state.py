"""Set-based table changes: tables and a command table in, new tables, outcomes and audit rows out.

Each function handles a whole batch of commands. Commands carry a unique ``seq``; where the reference point is a
single row (a document, a record, a task) the lowest ``seq`` wins and later ones get the code a second caller would
get. Decisions are made once per key and then attached to the commands, so many commands on one key stay cheap.
An outcome ``code`` of NULL means accepted.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import process_eligibility
from ..functions.text import is_blank, strip, text_key
from ..schemas import FIELD_NAMES, OPEN_TASK_STATUSES, TERMINAL_STATUSES
from . import rules, skew
from .reference import Reference
from .windows import newest

TERMINAL = list(TERMINAL_STATUSES)
OPEN = list(OPEN_TASK_STATUSES)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def new_id(*parts: Column) -> Column:
    """A repeatable id, so that running a batch again creates the same rows."""
    return F.left(F.sha2(text_key("|", *parts), 256), F.lit(32))


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def audit_row(action: str, entity_type: str, entity_id: Column, user_id: Column, at: Column, key: Column,
              old: Column | None = None, new: Column | None = None, metadata: Column | None = None) -> list[Column]:
    """The columns of one audit row."""
    return [
        new_id(F.lit(action), entity_id, key).alias("id"), user_id.cast("string").alias("user_id"),
        F.lit(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"),
        F.lit(action).alias("action"), (_null() if old is None else old).alias("old_value"),
        (_null() if new is None else new).alias("new_value"),
        (F.lit("{}") if metadata is None else metadata).alias("metadata"), at.cast("timestamp").alias("timestamp"),
    ]


def _first_per_key(commands: DataFrame, key: str) -> DataFrame:
    return commands.groupBy(key).agg(F.min("seq").alias("_first"), F.count("*").alias("_size"))


def _outcomes(commands: DataFrame, decisions: DataFrame, key: str, later_code: str) -> DataFrame:
    """Give every command its code: the decision for the first one of a key, ``later_code`` after an accepted one."""
    told = skew.attach(commands, decisions.select(key, "_first", "_size", "_code"), key, "_size", F.col("seq"))
    late = (F.col("seq") != F.col("_first")) & F.col("_code").isNull()
    return told.withColumn("code", F.when(late, F.lit(later_code)).otherwise(F.col("_code"))).drop("_first", "_size", "_code")


def open_task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin(OPEN)).groupBy(F.col("land_record_id").alias("record_id")).agg(
        F.count("*").alias("_open")
    )


# Documents and jobs -----------------------------------------------------------------------------------------------

def select_work(documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, outcomes, batch): eligible documents go to PROCESSING, one request per document."""
    states = documents.select(F.col("id").alias("document_id"), F.col("processing_status").alias("_status"), F.lit(True).alias("_found"))
    decided = _first_per_key(requests, "document_id").join(states, "document_id", "left").withColumn(
        "_code",
        F.when(F.col("_found").isNull(), F.lit("DOCUMENT_NOT_FOUND")).otherwise(process_eligibility(F.col("_status"))),
    )
    outcomes = _outcomes(requests, decided, "document_id", "PROCESSING_IN_PROGRESS")
    batch = decided.filter("_code is null").select("document_id", F.col("_first").alias("seq"))
    return set_status_if(documents, batch, None, "PROCESSING"), outcomes, batch


def set_status_if(documents: DataFrame, keys: DataFrame, expected: str | None, new: str) -> DataFrame:
    """Set ``processing_status`` of the listed documents, only where it is ``expected`` (any, when None)."""
    marks = keys.select(F.col("document_id").alias("id")).distinct().withColumn("_mark", F.lit(True))
    hit = F.coalesce(F.col("_mark"), F.lit(False))
    if expected is not None:
        hit = hit & (F.col("processing_status") == expected)
    status = F.when(hit, F.lit(new)).otherwise(F.col("processing_status"))
    return documents.join(marks, "id", "left").withColumn("processing_status", status).select(*documents.columns)


def reconcile_stale(jobs: DataFrame, documents: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, documents, one-row count): unfinished jobs fail, and so do their documents if still PROCESSING."""
    stale = F.col("status").isin("PENDING", "RUNNING")
    values = {
        "status": F.lit("FAILED"), "completed_at": F.lit(now), "error_code": F.lit("SERVER_RESTARTED"),
        "error_message": F.lit("The job had not ended when the service came up again."),
    }
    new_jobs = jobs.select(*[
        F.when(stale, values[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in jobs.columns
    ])
    hit = jobs.filter(stale)
    return (
        new_jobs, set_status_if(documents, hit.select("document_id"), "PROCESSING", "FAILED"),
        hit.agg(F.count("*").alias("reconciled")),
    )


def fail_jobs(jobs: DataFrame, documents: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, documents, audit) after failures of (job_id, document_id, user_id, error_code, error_message, at)."""
    marks = failures.select(
        F.col("job_id").alias("id"), F.col("error_code").alias("_code"), F.col("error_message").alias("_message"),
        F.col("at").alias("_at"), F.lit(True).alias("_mark"),
    )
    hit = F.coalesce(F.col("_mark"), F.lit(False))
    new = {"status": F.lit("FAILED"), "completed_at": F.col("_at"), "error_code": F.col("_code"), "error_message": F.col("_message")}
    new_jobs = jobs.join(marks, "id", "left").select(*[
        F.when(hit, new[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in jobs.columns
    ])
    audit = failures.select(*audit_row(
        "PROCESSING_FAILED", "document", F.col("document_id"), F.col("user_id"), F.col("at"), F.col("job_id"),
        metadata=_json(job_id=F.col("job_id"), error_code=F.col("error_code")),
    ))
    return new_jobs, set_status_if(documents, failures.select("document_id"), "PROCESSING", "FAILED"), audit


# Reviews ----------------------------------------------------------------------------------------------------------

def create_reviews(records: DataFrame, tasks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, outcomes, audit) for requests of (seq, record_id, reason, priority, user_id, at)."""
    states = records.select("record_id", F.col("status").alias("_status"), F.lit(True).alias("_found"))
    decided = (
        _first_per_key(requests, "record_id").join(states, "record_id", "left")
        .join(open_task_counts(tasks), "record_id", "left")
        .withColumn("_code", F.when(F.col("_found").isNull(), F.lit("RECORD_NOT_FOUND"))
                    .when(F.col("_status").isin(TERMINAL), F.lit("RECORD_FINALIZED"))
                    .when(F.col("_open") > 0, F.lit("REVIEW_ALREADY_OPEN")))
    )
    outcomes = _outcomes(requests, decided, "record_id", "REVIEW_ALREADY_OPEN")
    done = outcomes.filter("code is null")
    task_id = new_id(F.lit("review"), F.col("record_id"), F.col("seq"))
    opened = done.select(
        task_id.alias("id"), F.col("record_id").alias("land_record_id"), _null().alias("assigned_to"),
        F.lit("PENDING").alias("status"), F.col("priority"), strip(F.col("reason")).alias("reason"),
        F.col("at").cast("timestamp").alias("created_at"), _null("timestamp").alias("completed_at"),
    )
    audit = done.select(*audit_row(
        "REVIEW_CREATED", "land_record", F.col("record_id"), F.col("user_id"), F.col("at"), F.col("seq"),
        metadata=_json(review_id=task_id, priority=F.col("priority"), reason=strip(F.col("reason"))),
    ))
    return tasks.unionByName(opened.select(*tasks.columns)), outcomes, audit


def _close_tasks(tasks: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Set a final status on the tasks of ``ids`` (id, _at)."""
    marks = ids.select("id", F.col("_at"), F.lit(True).alias("_mark"))
    hit = F.coalesce(F.col("_mark"), F.lit(False))
    return tasks.join(marks, "id", "left").withColumns({
        "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
        "completed_at": F.when(hit, F.col("_at")).otherwise(F.col("completed_at")),
    }).select(*tasks.columns)


def complete_reviews(tasks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, outcomes, audit) for commands of (seq, task_id, user_id, at)."""
    states = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("_status"),
                          F.col("land_record_id").alias("_record"), F.lit(True).alias("_found"))
    decided = _first_per_key(commands, "task_id").join(states, "task_id", "left").withColumn(
        "_code", F.when(F.col("_found").isNull(), F.lit("REVIEW_NOT_FOUND"))
        .when(~F.col("_status").isin(OPEN), F.lit("REVIEW_CLOSED")))
    outcomes = _outcomes(commands, decided, "task_id", "REVIEW_CLOSED")
    done = outcomes.filter("code is null").join(states.select("task_id", "_record"), "task_id")
    audit = done.select(*audit_row(
        "REVIEW_COMPLETED", "land_record", F.col("_record"), F.col("user_id"), F.col("at"), F.col("task_id"),
        metadata=_json(review_id=F.col("task_id")),
    ))
    closed = done.select(F.col("task_id").alias("id"), F.col("at").cast("timestamp").alias("_at"))
    return _close_tasks(tasks, closed, "COMPLETED"), outcomes, audit


# Records ----------------------------------------------------------------------------------------------------------

def current_issues(records: DataFrame, reference: Reference | None) -> DataFrame:
    """(record_id, issues) of the values as they stand; duplicates are not part of this check."""
    from ..functions.normalize import normalize_record

    values = records.select("record_id", *[F.col(n).cast("string").alias(n) for n in FIELD_NAMES])
    return rules.validate(normalize_record(values), reference).select("record_id", "issues")


def apply_corrections(records: DataFrame, tasks: DataFrame, issues: DataFrame, commands: DataFrame,
                      reference: Reference | None = None) -> dict[str, DataFrame]:
    """Corrections of (seq, task_id, field_name, value, reason, user_id, at), applied in ``seq`` order.

    Returns records, tasks, issues (corrected records checked again, replacing their old findings), corrections,
    outcomes and audit. ``records`` keeps text columns; typed tables are cast back to their own types.
    """
    of_task = tasks.select(
        F.col("id").alias("task_id"), F.col("status").alias("_task_status"), F.col("land_record_id").alias("record_id")
    ).join(
        records.select("record_id", F.col("status").alias("_record_status"), F.lit(True).alias("_record_found")),
        "record_id", "left",
    )
    sizes = commands.groupBy("task_id").agg(F.count("*").alias("_size"))
    told = skew.attach(
        commands, sizes.join(of_task.withColumn("_task_found", F.lit(True)), "task_id", "left"), "task_id", "_size", F.col("seq")
    )
    code = (
        F.when(~F.coalesce(F.col("field_name").isin(*FIELD_NAMES), F.lit(False)), F.lit("FIELD_NOT_FOUND"))
        .when(is_blank(F.col("reason")), F.lit("CORRECTION_REASON_REQUIRED"))
        .when(F.col("_task_found").isNull(), F.lit("REVIEW_NOT_FOUND"))
        .when(~F.col("_task_status").isin(OPEN), F.lit("REVIEW_CLOSED"))
        .when(F.col("_record_found").isNull(), F.lit("RECORD_NOT_FOUND"))
        .when(F.col("_record_status").isin(TERMINAL), F.lit("RECORD_FINALIZED"))
    )
    judged = told.withColumn("code", code)
    outcomes = judged.select(*commands.columns, "code")
    good = judged.filter("code is null").withColumn("_cell", text_key("\x1f", F.col("record_id"), F.col("field_name")))

    # Final value per cell: the newest command; only one candidate per cell and partition is shuffled.
    final = newest(good, "_cell", [F.desc("seq")])
    wide = final.groupBy("record_id").agg(*[
        F.max(F.when(F.col("field_name") == n, F.struct(F.col("value").alias("v")))).alias(f"_c_{n}") for n in FIELD_NAMES
    ])
    joined = records.join(wide, "record_id", "left")

    def cell(n: str) -> Column:
        text = F.col(f"_c_{n}.v").try_cast(records.schema[n].dataType)
        return F.when(F.col(f"_c_{n}").isNotNull(), text).otherwise(F.col(n)).alias(n)

    new_records = joined.select(*[cell(c) if c in FIELD_NAMES else F.col(c) for c in records.columns])

    # Old value: the previous command on the cell, or the stored value before the batch.
    placed = skew.previous_struct(good, "_cell", "seq", F.col("value"), name="_previous")
    stored = records.select(
        "record_id", F.map_from_arrays(
            F.array(*[F.lit(n) for n in FIELD_NAMES]), F.array(*[F.col(n).cast("string") for n in FIELD_NAMES])
        ).alias("_stored"),
    )
    with_old = placed.join(stored, "record_id").withColumn(
        "old_value", F.when(F.col("_previous").isNotNull(), F.col("_previous.v"))
        .otherwise(F.element_at("_stored", F.col("field_name"))))
    log = with_old.select(
        F.col("record_id").alias("land_record_id"), "task_id", "field_name", "old_value",
        F.col("value").alias("new_value"), strip(F.col("reason")).alias("reason"),
        F.col("user_id").alias("changed_by"), F.col("at").cast("timestamp").alias("changed_at"),
    )
    def pair(name: str) -> Column:
        return F.to_json(F.create_map(F.col("field_name"), F.col(name)))

    audit = with_old.select(*audit_row(
        "FIELD_CORRECTED", "land_record", F.col("record_id"), F.col("user_id"), F.col("at"), F.col("seq"),
        old=pair("old_value"), new=pair("value"),
        metadata=_json(review_id=F.col("task_id"), field=F.col("field_name"), reason=strip(F.col("reason"))),
    ))

    touched_tasks = good.select(F.col("task_id").alias("id")).distinct().withColumn("_mark", F.lit(True))
    new_tasks = tasks.join(touched_tasks, "id", "left").withColumn(
        "status", F.when(F.col("_mark") & (F.col("status") == "PENDING"), F.lit("IN_REVIEW")).otherwise(F.col("status"))
    ).select(*tasks.columns)

    touched = wide.select("record_id")
    checked = current_issues(new_records.join(touched, "record_id", "left_semi"), reference)
    fresh = rules.explode_issues(checked, "record_id")
    new_issues = issues.join(touched, "record_id", "left_anti").unionByName(fresh.select(*issues.columns))
    return {"records": new_records, "tasks": new_tasks, "issues": new_issues, "corrections": log,
            "outcomes": outcomes, "audit": audit}


def approve(records: DataFrame, tasks: DataFrame, commands: DataFrame,
            reference: Reference | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, outcomes, audit) for commands of (seq, record_id, reason, user_id, at)."""
    firsts = _first_per_key(commands, "record_id")
    named = records.join(firsts.select("record_id"), "record_id", "left_semi")
    facts = (
        named.join(current_issues(named, reference), "record_id")
        .join(open_task_counts(tasks), "record_id", "left")
        .select("record_id", F.col("status").alias("_status"),
                rules.approval_blockers(F.col("issues"), F.coalesce("_open", F.lit(0))).alias("_blockers"))
    )
    decided = firsts.join(facts, "record_id", "left").withColumn(
        "_code", F.when(F.col("_status").isNull(), F.lit("RECORD_NOT_FOUND"))
        .when(F.col("_status").isin(TERMINAL), F.lit("RECORD_FINALIZED"))
        .when(F.size("_blockers") > 0, F.lit("APPROVAL_BLOCKED")))
    blocked = decided.select("record_id", "_first", "_size", "_code", F.col("_blockers").alias("blockers"), F.col("_status").alias("_old"))
    told = skew.attach(commands, blocked, "record_id", "_size", F.col("seq"))
    late = (F.col("seq") != F.col("_first")) & F.col("_code").isNull()
    told = told.withColumn("code", F.when(late, F.lit("RECORD_FINALIZED")).otherwise(F.col("_code")))
    done = told.filter("code is null").select(
        "record_id", "seq", "reason", "_old", F.col("user_id").cast("string").alias("_by"), F.col("at").cast("timestamp").alias("_at")
    )
    new_records = _finish(records, done, {
        "status": F.lit("APPROVED"), "approved_by": F.col("_by"), "approved_at": F.col("_at"), "updated_at": F.col("_at"),
    })
    audit = done.select(*audit_row(
        "RECORD_APPROVED", "land_record", F.col("record_id"), F.col("_by"), F.col("_at"), F.col("seq"),
        old=_json(status=F.col("_old")), new=_json(status=F.lit("APPROVED")),
        metadata=_json(reason=F.nullif(strip(F.col("reason")), F.lit(""))),
    ))
    outcomes = told.select(*commands.columns, "code", F.when(F.col("code") == "APPROVAL_BLOCKED", F.col("blockers")).alias("blockers"))
    return new_records, outcomes, audit


def _finish(records: DataFrame, done: DataFrame, values: dict[str, Column]) -> DataFrame:
    marks = done.select("record_id", *[c for c in ("_by", "_at") if c in done.columns], F.lit(True).alias("_mark"))
    hit = F.coalesce(F.col("_mark"), F.lit(False))
    return records.join(marks, "record_id", "left").select(*[
        F.when(hit, values[c].cast(records.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in records.columns
    ])


def reject(records: DataFrame, tasks: DataFrame, commands: DataFrame, part_rows: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, tasks, outcomes, audit): rejecting a record cancels its open reviews.

    The audit row lists the cancelled reviews; more than ``part_rows`` of them continue in further rows.
    """
    reasoned = commands.filter(~is_blank(F.col("reason")))
    silent = commands.filter(is_blank(F.col("reason"))).withColumn("code", F.lit("REJECTION_REASON_REQUIRED"))
    states = records.select("record_id", F.col("status").alias("_status"))
    decided = _first_per_key(reasoned, "record_id").join(states, "record_id", "left").withColumn(
        "_code", F.when(F.col("_status").isNull(), F.lit("RECORD_NOT_FOUND"))
        .when(F.col("_status").isin(TERMINAL), F.lit("RECORD_FINALIZED")))
    outcomes = _outcomes(reasoned, decided, "record_id", "RECORD_FINALIZED")
    done = outcomes.filter("code is null").join(states, "record_id").select(
        "record_id", "seq", "reason", "user_id", F.col("_status").alias("_old"), F.col("at").cast("timestamp").alias("_at")
    )
    new_records = _finish(records, done, {"status": F.lit("REJECTED"), "updated_at": F.col("_at")})
    open_rows = tasks.filter(F.col("status").isin(OPEN)).join(
        done.select(F.col("record_id").alias("land_record_id"), "_at"), "land_record_id"
    )
    new_tasks = _close_tasks(tasks, open_rows.select("id", "_at"), "CANCELLED")
    numbered = skew.in_parts(open_rows.select(F.col("land_record_id").alias("record_id"), "id").distinct(), ["record_id"], part_rows, "_part")
    cancelled = numbered.groupBy("record_id", "_part").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    command = F.when(F.coalesce("_part", F.lit(0)) == 0, F.col("seq").cast("string")).otherwise(F.concat_ws(":", "seq", "_part"))
    audit = done.join(cancelled, "record_id", "left").select(*audit_row(
        "RECORD_REJECTED", "land_record", F.col("record_id"), F.col("user_id"), F.col("_at"), command,
        old=_json(status=F.col("_old")), new=_json(status=F.lit("REJECTED")),
        metadata=_json(reason=strip(F.col("reason")), cancelled_reviews=F.coalesce("_ids", F.array().cast("array<string>"))),
    ))
    return new_records, new_tasks, outcomes.unionByName(silent.select(*outcomes.columns)), audit


# Results of a processing batch ------------------------------------------------------------------------------------

def persistence_codes(batch: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Add ``code``, ``replayed`` and the record on file to a batch of one row per document.

    ``batch`` has job_id, document_id, user_id, pages, verdict, outcome (see ``map_verdict``).
    """
    jobs = tables["processing_jobs"].select(
        F.col("id").alias("job_id"), F.col("status").alias("_job_status"), F.col("document_id").alias("_job_document"))
    docs = tables["documents"].select(F.col("id").alias("document_id"), F.col("processing_status").alias("_document_status"))
    recs = tables["land_records"].select("document_id", F.col("record_id").alias("_record_id"), F.col("status").alias("_record_status"))
    payload = rules.check_payload(
        F.col("verdict"), F.col("outcome.document_status"), F.size("pages"), F.col("outcome.priority"), F.col("outcome.reason"))
    replayed = F.col("_job_status") == "SUCCEEDED"
    staged = batch.join(jobs, "job_id", "left").join(docs, "document_id", "left").join(recs, "document_id", "left")
    actor_missing = F.lit(False)
    if "users" in tables:
        users = tables["users"].select(F.col("id").alias("user_id")).distinct().withColumn("_user", F.lit(True))
        staged = staged.join(users, "user_id", "left")
        actor_missing = F.col("_user").isNull()
    code = (
        F.when(F.col("job_id").isNull() | F.col("document_id").isNull() | F.col("user_id").isNull(), F.lit("22023"))
        .when(payload.isNotNull(), payload)
        .when(F.col("_job_status").isNull(), F.lit("23503"))
        .when(F.col("_job_document") != F.col("document_id"), F.lit("23514"))
        .when(replayed & F.col("_record_id").isNull(), F.lit("XX001"))
        .when(replayed, _null())
        .when(F.col("_job_status") != "RUNNING", F.lit("55000"))
        .when(F.col("_document_status").isNull(), F.lit("23503"))
        .when(F.col("_document_status") != "PROCESSING", F.lit("55000"))
        .when(F.col("_record_status").isin(TERMINAL), F.lit("55000"))
        .when(actor_missing, F.lit("23503"))
    )
    return staged.select(
        *batch.columns, code.alias("code"), F.coalesce(replayed & code.isNull(), F.lit(False)).alias("replayed"),
        F.coalesce("_record_id", new_id(F.lit("record"), F.col("document_id"))).alias("record_id"),
        F.col("_record_id").isNotNull().alias("_on_file"),
    )


def persist_results(batch: DataFrame, tables: dict[str, DataFrame], now: datetime, judged: DataFrame | None = None) -> dict[str, DataFrame]:
    """New versions of all tables after storing a batch, plus ``outcomes``.

    OCR pages, fields and findings of each stored document are replaced as a unit, the record is inserted or updated,
    a review is opened when the verdict asks for one and none is open, and document, job and audit log follow. A job
    that already succeeded changes nothing.

    ``batch`` has, besides the columns of :func:`persistence_codes`: ``fields`` map, ``issues`` array, the typed
    record columns and ``metadata`` map. Write the batch to a table before calling this: every result reads it. ``judged`` is the
    result of :func:`persistence_codes`, if it is stored already.
    """
    judged = persistence_codes(batch, tables) if judged is None else judged
    stored = judged.filter("code is null and not replayed")
    documents, records = stored.select("document_id"), stored.select("record_id")
    at = F.lit(now)
    out = dict(tables)

    def replaced(name: str, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        old = tables[name]
        return old.join(parents, key, "left_anti").unionByName(new.select(*old.columns))

    pages = stored.select("document_id", F.inline("pages")).select(
        "document_id", "page_number", "text", F.col("confidence").alias("ocr_confidence"),
        F.struct(F.size("lines").alias("lines"), "width", "height").alias("structured_output_reference"),
    )
    out["ocr_results"] = replaced("ocr_results", pages, documents, "document_id")

    old_records = tables["land_records"]
    changed = stored.select(
        "record_id", "document_id", F.col("outcome.record_status").alias("status"), *FIELD_NAMES,
        _null().alias("approved_by"), _null("timestamp").alias("approved_at"),
        at.alias("created_at"), at.alias("updated_at"),
    )
    kept = ("created_at", "approved_by", "approved_at")
    on_file = old_records.select("record_id", *[F.col(c).alias(f"_k_{c}") for c in kept if c in old_records.columns])
    merged = changed.join(on_file, "record_id", "left").select(*[
        F.coalesce(F.col(f"_k_{c}"), F.col(c)).alias(c) if f"_k_{c}" in on_file.columns else F.col(c)
        for c in old_records.columns
    ])
    out["land_records"] = old_records.join(records, "record_id", "left_anti").unionByName(merged)

    fields = stored.select("record_id", F.explode("fields").alias("field_name", "f")).select(
        "record_id", "field_name", "f.value", "f.confidence", _null("int").alias("source_page"),
        _null().alias("source_text"), _null("array<double>").alias("bounding_box"),
        F.col("f.status").alias("extraction_status"), F.lit("NOT_CHECKED").alias("validation_status"),
    )
    out["extracted_fields"] = replaced("extracted_fields", fields, records, "record_id")
    out["validation_results"] = replaced("validation_results", rules.explode_issues(stored, "record_id"), records, "record_id")

    old_documents = tables["documents"]
    marks = stored.select(F.col("document_id").alias("id"), F.col("outcome.document_status").alias("_new"))
    out["documents"] = old_documents.join(marks, "id", "left").withColumn(
        "processing_status", F.coalesce("_new", "processing_status")).select(*old_documents.columns)

    open_reviews = open_task_counts(tables["review_tasks"])
    wanting = stored.filter(F.col("verdict") != "READY_FOR_APPROVAL").join(open_reviews, "record_id", "left_anti")
    review_id = new_id(F.lit("review"), F.col("record_id"), F.col("job_id"))
    opened = wanting.select(
        review_id.alias("id"), F.col("record_id").alias("land_record_id"), _null().alias("assigned_to"),
        F.lit("PENDING").alias("status"), F.col("outcome.priority").alias("priority"), F.col("outcome.reason").alias("reason"),
        at.alias("created_at"), _null("timestamp").alias("completed_at"),
    )
    out["review_tasks"] = tables["review_tasks"].unionByName(opened.select(*tables["review_tasks"].columns))

    old_jobs = tables["processing_jobs"]
    finished = stored.select(F.col("job_id").alias("id"), F.lit(True).alias("_done"))
    new_values = {"status": F.lit("SUCCEEDED"), "completed_at": at, "error_code": _null(), "error_message": _null()}
    out["processing_jobs"] = old_jobs.join(finished, "id", "left").select(*[
        F.when(F.col("_done"), new_values[c].cast(old_jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in new_values else F.col(c) for c in old_jobs.columns
    ])

    review_audit = wanting.select(*audit_row(
        "REVIEW_CREATED", "land_record", F.col("record_id"), F.col("user_id"), at, F.col("job_id"),
        metadata=_json(review_id=review_id, priority=F.col("outcome.priority"), reason=F.col("outcome.reason")),
    ))
    created = wanting.select("record_id", review_id.alias("_review"))
    done_audit = stored.join(created, "record_id", "left").select(*audit_row(
        "PROCESSING_COMPLETED", "document", F.col("document_id"), F.col("user_id"), at, F.col("job_id"),
        metadata=F.to_json(F.map_concat("metadata", F.create_map(
            F.lit("record_id"), F.col("record_id"), F.lit("review_created"), F.col("_review")))),
    ))
    old_audit = tables["audit_logs"]
    out["audit_logs"] = old_audit.unionByName(review_audit.select(*old_audit.columns)).unionByName(
        done_audit.select(*old_audit.columns))
    out["outcomes"] = judged.select("job_id", "document_id", "record_id", "verdict", "code", "replayed")
    return out
