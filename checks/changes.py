"""Set-based table changes, batch processing and streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recordlake.functions.text import compare_key
from recordlake.operators import state
from recordlake.plans import evaluate, process
from recordlake.streaming import jobs as streams

from . import views as v
from .language import raw_responses
from .registry import check, scratch
from .tables import _SQL_DOCS, documents

NOW = datetime(2001, 1, 1, tzinfo=timezone.utc)


def _requests(spark, d, key: str):
    e = v.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias(key), F.lit("u1").alias("user_id"), F.col("ts").cast("timestamp").alias("at"))


_FIRST = "row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"
_ELIGIBLE = "CASE processing_status WHEN 'PROCESSING' THEN 'PROCESSING_IN_PROGRESS' WHEN 'APPROVED' THEN 'DOCUMENT_FINALIZED' WHEN 'EXTRACTION' THEN 'DOCUMENT_NOT_PROCESSABLE' END"


@check("l1_select_work", f"""
SELECT e.event_id AS seq, CASE WHEN d.id IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN {_ELIGIBLE} IS NULL AND NOT first THEN 'PROCESSING_IN_PROGRESS' ELSE {_ELIGIBLE} END AS code
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS doc, {_FIRST} AS first FROM events) e LEFT JOIN {_SQL_DOCS} d ON d.id = e.doc""", "v_records")
def _(spark, d):
    return state.select_work(documents(spark, d), _requests(spark, d, "document_id"))[1].select("seq", "code")


@check("l1_documents_after", f"""
SELECT id, CASE WHEN {_ELIGIBLE} IS NULL AND id IN (SELECT CAST(user_id AS VARCHAR) FROM events) THEN 'PROCESSING' ELSE processing_status END AS processing_status FROM {_SQL_DOCS}""", "v_records")
def _(spark, d):
    return state.select_work(documents(spark, d), _requests(spark, d, "document_id"))[0]


@check("l2_set_status_if", f"""
SELECT id, CASE WHEN processing_status = 'PROCESSING' AND k % 2 = 0 THEN 'FAILED' ELSE processing_status END AS processing_status FROM {_SQL_DOCS}""", "v_records")
def _(spark, d):
    docs = documents(spark, d)
    keys = docs.filter(F.col("id").cast("long") % 2 == 0).select(F.col("id").alias("document_id"))
    return state.set_status_if(docs, keys, "PROCESSING", "FAILED")


@check("l3_reconcile_jobs", """
SELECT id, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'SERVER_RESTARTED' ELSE error_code END AS error_code,
  CASE WHEN status IN ('PENDING', 'RUNNING') THEN epoch_us(TIMESTAMP '2001-01-01') ELSE completed_us END AS completed_us FROM v_jobs""", "v_jobs")
def _(spark, d):
    out = state.reconcile_stale(v.jobs(spark, d), documents(spark, d), NOW)[0]
    return out.select("id", "status", "error_code", F.unix_micros("completed_at").alias("completed_us"))


@check("l3_reconcile_documents", f"""
SELECT id, CASE WHEN processing_status = 'PROCESSING' AND id IN (SELECT document_id FROM v_jobs WHERE status IN ('PENDING', 'RUNNING')) THEN 'FAILED' ELSE processing_status END AS processing_status FROM {_SQL_DOCS}""",
       "v_jobs v_records")
def _(spark, d):
    return state.reconcile_stale(v.jobs(spark, d), documents(spark, d), NOW)[1]


def _record_requests(spark, d):
    n = F.col("seq")
    return _requests(spark, d, "record_id").withColumns({
        "reason": F.when(n % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" why "), n.cast("string"))),
        "priority": F.when(n % 2 == 0, "HIGH").otherwise("LOW")})


_OPEN = "(SELECT land_record_id AS record_id, count(*) AS n FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW') GROUP BY 1)"


@check("l5_create_reviews", f"""
SELECT e.event_id AS seq, CASE WHEN r.record_id IS NULL THEN 'RECORD_NOT_FOUND' WHEN r.status = 'APPROVED' THEN 'RECORD_FINALIZED' WHEN o.n > 0 OR NOT first THEN 'REVIEW_ALREADY_OPEN' END AS code
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS rec, {_FIRST} AS first FROM events) e LEFT JOIN v_records r ON r.record_id = e.rec LEFT JOIN {_OPEN} o ON o.record_id = e.rec""", "v_records v_tasks")
def _(spark, d):
    return state.create_reviews(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d))[1].select("seq", "code")


# Corrections --------------------------------------------------------------------------------------------------------

_CORRECTED_FIELDS = ["area", "owner_name", "village", "colour"]


def _correction_commands(spark, d):
    e = v.table(spark, d, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("seq"), F.concat(F.lit("K"), (F.col("user_id") * 7).cast("string")).alias("task_id"),
        F.element_at(F.array(*[F.lit(f) for f in _CORRECTED_FIELDS]), (n % 4 + 1).cast("int")).alias("field_name"),
        F.when(n % 4 == 0, (n % 90 + 1).cast("string")).when(n % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("new "), n.cast("string"))).alias("value"),
        F.when(n % 11 == 0, F.lit(" ")).otherwise(F.lit("checked ")).alias("reason"), F.lit("u1").alias("user_id"), F.col("ts").cast("timestamp").alias("at"))


_CORR = f"""(SELECT c.*, t.status AS task_status, t.land_record_id AS record_id, CASE WHEN field_name = 'colour' THEN 'FIELD_NOT_FOUND' WHEN seq % 11 = 0 THEN 'CORRECTION_REASON_REQUIRED'
  WHEN t.id IS NULL THEN 'REVIEW_NOT_FOUND' WHEN t.status NOT IN ('PENDING', 'IN_REVIEW') THEN 'REVIEW_CLOSED' WHEN r.record_id IS NULL THEN 'RECORD_NOT_FOUND' WHEN r.status = 'APPROVED' THEN 'RECORD_FINALIZED' END AS code
FROM (SELECT event_id AS seq, 'K' || CAST(user_id * 7 AS VARCHAR) AS task_id, {_CORRECTED_FIELDS}[event_id % 4 + 1] AS field_name,
  CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 + 1 AS VARCHAR) WHEN event_id % 5 <> 0 THEN 'new ' || CAST(event_id AS VARCHAR) END AS value FROM events) c
LEFT JOIN v_tasks t ON t.id = c.task_id LEFT JOIN v_records r ON r.record_id = t.land_record_id)"""


def _corrected(spark, d):
    ref = v.reference(spark, d)
    found = v.issues(spark, d)
    return state.apply_corrections(v.normalized(spark, d), v.tasks(spark, d), found, _correction_commands(spark, d), ref)


@check("l6_correction_outcomes", f"SELECT seq, code FROM {_CORR}", "v_tasks v_records")
def _(spark, d):
    return _corrected(spark, d)["outcomes"].select("seq", "code")


@check("l6_corrected_records", f"""
SELECT n.record_id, CASE WHEN o.seq IS NOT NULL THEN o.value ELSE n.owner_name END AS owner_name, CASE WHEN a.seq IS NOT NULL THEN a.value ELSE n.area END AS area,
  CASE WHEN w.seq IS NOT NULL THEN w.value ELSE n.village END AS village FROM n_records n
{' '.join(f"LEFT JOIN (SELECT * FROM {_CORR} WHERE code IS NULL AND field_name = '{f}' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1) {a} ON {a}.record_id = n.record_id" for f, a in (('owner_name', 'o'), ('area', 'a'), ('village', 'w')))}""",
       "n_records v_tasks v_records")
def _(spark, d):
    return _corrected(spark, d)["records"].select("record_id", "owner_name", "area", "village")


@check("l6_correction_log", f"""
SELECT record_id AS land_record_id, field_name, value AS new_value, CASE WHEN rn = 1 THEN CASE field_name WHEN 'area' THEN n.area WHEN 'owner_name' THEN n.owner_name ELSE n.village END ELSE prev END AS old_value
FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM {_CORR} WHERE code IS NULL WINDOW w AS (PARTITION BY record_id, field_name ORDER BY seq)) JOIN n_records n USING (record_id)""",
       "n_records v_tasks v_records")
def _(spark, d):
    return _corrected(spark, d)["corrections"].select("land_record_id", "field_name", "new_value", "old_value")


@check("l6_tasks_after", f"""
SELECT id, CASE WHEN status = 'PENDING' AND id IN (SELECT task_id FROM {_CORR} WHERE code IS NULL) THEN 'IN_REVIEW' ELSE status END AS status FROM v_tasks""", "v_tasks v_records")
def _(spark, d):
    return _corrected(spark, d)["tasks"].select("id", "status")


def _last(field: str) -> str:
    return f"(SELECT * FROM {_CORR} WHERE code IS NULL AND field_name = '{field}' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1)"


# The records with their corrections, and the findings of all rules on them.
_AGAIN = f""", c_records AS (SELECT n.* REPLACE (CASE WHEN o.seq IS NOT NULL THEN o.value ELSE n.owner_name END AS owner_name, CASE WHEN a.seq IS NOT NULL THEN a.value ELSE n.area END AS area,
  CASE WHEN w.seq IS NOT NULL THEN w.value ELSE n.village END AS village) FROM n_records n
  LEFT JOIN {_last('owner_name')} o USING (record_id) LEFT JOIN {_last('area')} a USING (record_id) LEFT JOIN {_last('village')} w USING (record_id)
  WHERE n.record_id IN (SELECT record_id FROM {_CORR} WHERE code IS NULL)),
c_issues AS ({v.SQL_VIEWS["r_issues"][1].replace("n_records", "c_records")})"""


@check("l6_issues_after", f"""{_AGAIN}
SELECT record_id, rule_id, coalesce(field_name, '') AS field, status, coalesce(severity, '') AS severity, message, count(*) AS n FROM (
SELECT record_id, rule_id, field_name, status, severity, message FROM v_issues WHERE record_id NOT IN (SELECT record_id FROM {_CORR} WHERE code IS NULL)
UNION ALL SELECT record_id, rule_id, field_name, status, severity, message FROM c_issues) GROUP BY ALL""", "v_issues v_tasks v_records n_records v_reference")
def _(spark, d):
    rows = _corrected(spark, d)["issues"].select("record_id", "rule_id", F.coalesce("field_name", F.lit("")).alias("field"), "status", F.coalesce("severity", F.lit("")).alias("severity"), "message")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _logged(audit, *parts):
    """The columns of audit rows and parts of their metadata, by name."""
    facts = [F.get_json_object("metadata", f"$.{p}").alias(p) for p in parts]
    return audit.select("action", "entity_type", "entity_id", "user_id", F.unix_micros("timestamp").alias("at"), "old_value", "new_value", *facts)


@check("l6_audit", f"""
SELECT 'FIELD_CORRECTED' AS action, 'land_record' AS entity_type, record_id AS entity_id, 'u1' AS user_id, task_id AS review_id, field_name AS field, 'checked' AS reason, value AS new_text,
  CASE WHEN rn = 1 THEN CASE field_name WHEN 'area' THEN n.area WHEN 'owner_name' THEN n.owner_name ELSE n.village END ELSE prev END AS old_text
FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM {_CORR} WHERE code IS NULL WINDOW w AS (PARTITION BY record_id, field_name ORDER BY seq)) JOIN n_records n USING (record_id)""",
       "n_records v_tasks v_records")
def _(spark, d):
    def text(name: str):
        return F.element_at(F.from_json(name, "map<string,string>"), F.col("field"))

    rows = _logged(_corrected(spark, d)["audit"], "review_id", "field", "reason")
    return rows.select("action", "entity_type", "entity_id", "user_id", "review_id", "field", "reason", text("new_value").alias("new_text"), text("old_value").alias("old_text"))


@check("l5_audit", f"""
SELECT 'REVIEW_CREATED' AS action, 'land_record' AS entity_type, rec AS entity_id, 'u1' AS user_id, t AS at, CASE WHEN event_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS priority,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'why ' || CAST(event_id AS VARCHAR) END AS reason
FROM (SELECT event_id, epoch_us(ts) AS t, CAST(user_id AS VARCHAR) AS rec, {_FIRST} AS first FROM events) e JOIN v_records r ON r.record_id = e.rec LEFT JOIN {_OPEN} o ON o.record_id = e.rec
WHERE first AND r.status <> 'APPROVED' AND coalesce(o.n, 0) = 0""", "v_records v_tasks")
def _(spark, d):
    audit = state.create_reviews(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d))[2]
    return _logged(audit, "priority", "reason").drop("old_value", "new_value")


@check("l7_complete_reviews", """
SELECT e.event_id AS seq, CASE WHEN t.id IS NULL THEN 'REVIEW_NOT_FOUND' WHEN t.status NOT IN ('PENDING', 'IN_REVIEW') OR NOT first THEN 'REVIEW_CLOSED' END AS code
FROM (SELECT event_id, 'K' || CAST(user_id AS VARCHAR) AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS first FROM events) e LEFT JOIN v_tasks t ON t.id = e.task""", "v_tasks")
def _(spark, d):
    commands = _requests(spark, d, "task_id").withColumn("task_id", F.concat(F.lit("K"), F.col("task_id")))
    return state.complete_reviews(v.tasks(spark, d), commands)[1].select("seq", "code")


@check("l7_tasks_after", """
SELECT id, CASE WHEN status IN ('PENDING', 'IN_REVIEW') AND id IN (SELECT 'K' || CAST(user_id AS VARCHAR) FROM events) THEN 'COMPLETED' ELSE status END AS status FROM v_tasks""", "v_tasks")
def _(spark, d):
    commands = _requests(spark, d, "task_id").withColumn("task_id", F.concat(F.lit("K"), F.col("task_id")))
    return state.complete_reviews(v.tasks(spark, d), commands)[0].select("id", "status")


@check("l7_audit", """
SELECT 'REVIEW_COMPLETED' AS action, 'land_record' AS entity_type, t.land_record_id AS entity_id, 'u1' AS user_id, e.t AS at, t.id AS review_id
FROM (SELECT 'K' || CAST(user_id AS VARCHAR) AS task, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS first FROM events) e JOIN v_tasks t ON t.id = e.task
WHERE first AND t.status IN ('PENDING', 'IN_REVIEW')""", "v_tasks")
def _(spark, d):
    commands = _requests(spark, d, "task_id").withColumn("task_id", F.concat(F.lit("K"), F.col("task_id")))
    return _logged(state.complete_reviews(v.tasks(spark, d), commands)[2], "review_id").drop("old_value", "new_value")


_BLOCK = """CASE WHEN r.record_id IS NULL THEN 'RECORD_NOT_FOUND' WHEN r.status = 'APPROVED' THEN 'RECORD_FINALIZED' WHEN b.bad OR o.n > 0 THEN 'APPROVAL_BLOCKED' END"""
_BAD = """(SELECT record_id, bool_or(severity IN ('ERROR', 'CRITICAL') OR rule_id IN ('REQ_OWNER_NAME_001', 'REQ_SURVEY_NUMBER_001', 'REQ_AREA_001', 'REQ_VILLAGE_001', 'REQ_TEHSIL_001', 'REQ_DISTRICT_001')) AS bad FROM r_issues GROUP BY 1)"""


@check("l8_approve", f"""
SELECT e.event_id AS seq, CASE WHEN {_BLOCK} IS NULL AND NOT first THEN 'RECORD_FINALIZED' ELSE {_BLOCK} END AS code
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS rec, {_FIRST} AS first FROM events) e LEFT JOIN v_records r ON r.record_id = e.rec LEFT JOIN {_OPEN} o ON o.record_id = e.rec LEFT JOIN {_BAD} b ON b.record_id = e.rec""",
       "v_records v_tasks r_issues")
def _(spark, d):
    return state.approve(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d), v.reference(spark, d))[1].select("seq", "code")


@check("l8_records_after", f"""
SELECT r.record_id, CASE WHEN {_BLOCK} IS NULL AND r.record_id IN (SELECT CAST(user_id AS VARCHAR) FROM events) THEN 'APPROVED' ELSE r.status END AS status
FROM v_records r LEFT JOIN {_OPEN} o USING (record_id) LEFT JOIN {_BAD} b USING (record_id)""", "v_records v_tasks r_issues")
def _(spark, d):
    return state.approve(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d), v.reference(spark, d))[0].select("record_id", "status")


@check("l8_audit", f"""
SELECT 'RECORD_APPROVED' AS action, 'land_record' AS entity_type, rec AS entity_id, 'u1' AS user_id, t AS at, '{{"status":"' || r.status || '"}}' AS old_value, '{{"status":"APPROVED"}}' AS new_value,
  CASE WHEN event_id % 11 <> 0 THEN 'why ' || CAST(event_id AS VARCHAR) END AS reason
FROM (SELECT event_id, epoch_us(ts) AS t, CAST(user_id AS VARCHAR) AS rec, {_FIRST} AS first FROM events) e JOIN v_records r ON r.record_id = e.rec
LEFT JOIN {_OPEN} o ON o.record_id = e.rec LEFT JOIN {_BAD} b ON b.record_id = e.rec WHERE first AND {_BLOCK} IS NULL""", "v_records v_tasks r_issues")
def _(spark, d):
    return _logged(state.approve(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d), v.reference(spark, d))[2], "reason")


_REJECT = f"""(SELECT e.event_id AS seq, rec, CASE WHEN event_id % 11 = 0 THEN 'REJECTION_REASON_REQUIRED' WHEN r.record_id IS NULL THEN 'RECORD_NOT_FOUND' WHEN r.status = 'APPROVED' OR NOT first THEN 'RECORD_FINALIZED' END AS code
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS rec, row_number() OVER (PARTITION BY user_id, event_id % 11 = 0 ORDER BY event_id) = 1 AS first FROM events) e LEFT JOIN v_records r ON r.record_id = e.rec)"""


@check("l9_reject", f"SELECT seq, code FROM {_REJECT}", "v_records")
def _(spark, d):
    return state.reject(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d))[2].select("seq", "code")


@check("l9_tasks_after", f"""
SELECT id, CASE WHEN status IN ('PENDING', 'IN_REVIEW') AND land_record_id IN (SELECT rec FROM {_REJECT} WHERE code IS NULL) THEN 'CANCELLED' ELSE status END AS status FROM v_tasks""", "v_records v_tasks")
def _(spark, d):
    return state.reject(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d))[1].select("id", "status")


@check("l9_audit", f"""
SELECT 'RECORD_REJECTED' AS action, 'land_record' AS entity_type, j.rec AS entity_id, 'u1' AS user_id, epoch_us(e.ts) AS at, '{{"status":"' || r.status || '"}}' AS old_value, '{{"status":"REJECTED"}}' AS new_value,
  'why ' || CAST(j.seq AS VARCHAR) AS reason, coalesce((SELECT '["' || string_agg(t.id, '","' ORDER BY t.id) || '"]' FROM v_tasks t WHERE t.land_record_id = j.rec AND t.status IN ('PENDING', 'IN_REVIEW')), '[]') AS cancelled_reviews
FROM {_REJECT} j JOIN events e ON e.event_id = j.seq JOIN v_records r ON r.record_id = j.rec WHERE j.code IS NULL""", "v_records v_tasks")
def _(spark, d):
    return _logged(state.reject(v.records(spark, d), v.tasks(spark, d), _record_requests(spark, d))[3], "reason", "cancelled_reviews")


@check("l10_fail_jobs", """
SELECT id, CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN 'OCR_FAILED' ELSE error_code END AS error_code FROM v_jobs""", "v_jobs")
def _(spark, d):
    j = v.jobs(spark, d)
    failures = j.filter("status = 'RUNNING'").select(
        F.col("id").alias("job_id"), "document_id", F.lit("u1").alias("user_id"), F.lit("OCR_FAILED").alias("error_code"), F.lit("no text").alias("error_message"), F.lit(NOW).alias("at"))
    return state.fail_jobs(j, documents(spark, d), failures)[0].select("id", "status", "error_code")


@check("l10_audit", """
SELECT 'PROCESSING_FAILED' AS action, 'document' AS entity_type, document_id AS entity_id, 'u1' AS user_id, epoch_us(TIMESTAMP '2001-01-01') AS at, id AS job_id, 'OCR_FAILED' AS error_code FROM v_jobs WHERE status = 'RUNNING'""", "v_jobs")
def _(spark, d):
    j = v.jobs(spark, d)
    failures = j.filter("status = 'RUNNING'").select(
        F.col("id").alias("job_id"), "document_id", F.lit("u1").alias("user_id"), F.lit("OCR_FAILED").alias("error_code"), F.lit("no text").alias("error_message"), F.lit(NOW).alias("at"))
    return _logged(state.fail_jobs(j, documents(spark, d), failures)[2], "job_id", "error_code").drop("old_value", "new_value")


# Processing a batch -------------------------------------------------------------------------------------------------

_USABLE = "(SELECT * FROM n_records WHERE k % 4 <> 1 AND k % 53 <> 0 AND k % 59 <> 0)"
_MATCHES = f"""(SELECT record_id, CASE WHEN coalesce(village, '') <> '' THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS m
FROM (SELECT record_id, survey_number, village FROM {_USABLE} UNION ALL SELECT record_id, survey_number, village FROM n_records WHERE k % 4 = 1))"""


def _pages(answers):
    k = F.col("document_id").cast("long")
    text = F.when(k % 59 == 0, F.lit("  ")).otherwise(F.concat(F.lit("page of "), F.col("document_id")))
    line = F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), F.lit(None).cast("array<double>").alias("box"))
    page = F.struct(F.lit(1).alias("page_number"), text.alias("text"), F.lit(0.9).alias("confidence"), F.array(line).alias("lines"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    return answers.select("document_id", F.array(page).alias("pages"))


def _arrivals(spark, d):
    """(pages, responses, stored records): a quarter of the records is on file, the rest arrives."""
    answers = raw_responses(spark, d).filter(F.col("document_id").cast("long") % 4 != 1)
    stored = v.normalized(spark, d).filter(F.col("record_id").cast("long") % 4 == 1)
    return _pages(answers), answers, stored


@check("p1_prepare_batch", f"""
SELECT a.record_id AS document_id, CASE WHEN a.k % 59 = 0 THEN 'OCR_FAILED' WHEN a.k % 53 = 0 THEN 'PROVIDER_BAD_RESPONSE' END AS error_code,
  CASE WHEN u.record_id IS NOT NULL THEN m.m END AS match_count,
  CASE WHEN u.record_id IS NOT NULL THEN coalesce(i.n, 0) + CASE WHEN m.m > 0 THEN 1 ELSE 0 END END AS issues,
  CASE WHEN u.record_id IS NULL THEN NULL WHEN i.bad > 0 THEN 'VALIDATION_FAILED' WHEN i.n > 0 OR m.m > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS document_status
FROM n_records a LEFT JOIN {_USABLE} u USING (record_id) LEFT JOIN {_MATCHES} m ON m.record_id = a.record_id
LEFT JOIN (SELECT record_id, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS bad FROM r_issues GROUP BY 1) i ON i.record_id = a.record_id WHERE a.k % 4 <> 1""", "n_records r_issues")
def _(spark, d):
    pages, answers, stored = _arrivals(spark, d)
    out = process.prepare_batch(pages, answers, v.reference(spark, d), stored, scratch(spark, "batch"))
    return out.select("document_id", "error_code", "match_count", F.size("issues").cast("bigint").alias("issues"), "outcome.document_status")


def empty_tables(spark):
    """The tables a batch is stored into, without rows."""
    from recordlake.schemas import AUDIT, FIELD_NAMES

    kinds = {"area": "decimal(38,10)", "record_date": "date"}
    record = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in FIELD_NAMES)
    ddl = {
        "ocr_results": "document_id string, page_number int, text string, ocr_confidence double, structured_output_reference struct<lines:int,width:int,height:int>",
        "land_records": f"record_id string, document_id string, status string, {record}, approved_by string, approved_at timestamp, created_at timestamp, updated_at timestamp",
        "extracted_fields": "record_id string, field_name string, value string, confidence double, source_page int, source_text string, bounding_box array<double>, extraction_status string, validation_status string",
        "validation_results": "record_id string, rule_id string, field_name string, status string, severity string, message string",
        "review_tasks": "id string, land_record_id string, assigned_to string, status string, priority string, reason string, created_at timestamp, completed_at timestamp",
        "audit_logs": AUDIT,
        "processing_jobs": "id string, document_id string, status string, pipeline_version string, started_at timestamp, completed_at timestamp, error_code string, error_message string, created_at timestamp",
        "documents": "id string, processing_status string",
    }
    return {name: spark.createDataFrame([], schema) for name, schema in ddl.items()}


def batch_tables(spark, answers):
    """Tables in which every arriving document has a running job."""
    tables = empty_tables(spark)
    tables["documents"] = answers.select(F.col("document_id").alias("id"), F.lit("PROCESSING").alias("processing_status"))
    jobs = answers.select(F.col("job_id").alias("id"), "document_id", F.lit("RUNNING").alias("status"), F.lit("v1").alias("pipeline_version"))
    tables["processing_jobs"] = tables["processing_jobs"].unionByName(jobs, allowMissingColumns=True)
    return tables


_RIGHT = "(k % 53 <> 0 AND k % 59 <> 0)"
_JUDGED = f"""(SELECT u.*, coalesce(i.n, 0) + CASE WHEN m.m > 0 THEN 1 ELSE 0 END AS issues, m.m,
  CASE WHEN i.bad > 0 THEN 'VALIDATION_FAILED' WHEN i.n > 0 OR m.m > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS document_status FROM n_records u
JOIN (SELECT record_id, CASE WHEN coalesce(village, '') <> '' THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS m FROM n_records WHERE {_RIGHT}) m USING (record_id)
LEFT JOIN (SELECT record_id, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS bad FROM r_issues GROUP BY 1) i USING (record_id) WHERE {_RIGHT})"""
_PARCEL = "concat_ws('|', coalesce(owner_name, ''), coalesce(survey_number, ''), coalesce(village, ''), coalesce(tehsil, ''), coalesce(district, ''), coalesce(area_unit, ''))"


_STORED = f"""
SELECT 'land_records' AS name, record_id AS document, CASE WHEN document_status = 'READY_FOR_APPROVAL' THEN document_status ELSE 'REVIEW_REQUIRED' END || '|' || {_PARCEL} AS value FROM {_JUDGED}
UNION ALL SELECT 'documents', n.record_id, coalesce(j.document_status, 'PROCESSING') FROM n_records n LEFT JOIN {_JUDGED} j USING (record_id)
UNION ALL SELECT 'processing_jobs', n.record_id, CASE WHEN j.document_status IS NULL THEN 'RUNNING' ELSE 'SUCCEEDED' END FROM n_records n LEFT JOIN {_JUDGED} j USING (record_id)
UNION ALL SELECT 'ocr_results', record_id, 'page of ' || record_id FROM {_JUDGED}
UNION ALL SELECT 'extracted_fields', record_id, CAST(14 AS VARCHAR) FROM {_JUDGED}
UNION ALL SELECT 'validation_results', record_id, concat_ws('|', rule_id, coalesce(field_name, ''), i.status, severity, message) FROM r_issues i JOIN n_records USING (record_id) WHERE {_RIGHT}
UNION ALL SELECT 'validation_results', record_id, 'DUP_CANDIDATE_001|survey_number|REVIEW_REQUIRED|WARNING|survey_number: ''' || survey_number || ''' of ''' || village || ''' is also in ' || CAST(m AS VARCHAR)
  || ' other record(s); a parcel can be recorded twice for good reasons, so look at them before approval' FROM {_JUDGED} WHERE m > 0
UNION ALL SELECT 'review_tasks', record_id, CASE WHEN document_status = 'VALIDATION_FAILED' THEN 'HIGH|PENDING|Sent to review: verdict BLOCKED, findings: ' ELSE 'MEDIUM|PENDING|Sent to review: verdict REVIEW_REQUIRED, findings: ' END
  || CAST(issues AS VARCHAR) FROM {_JUDGED} WHERE document_status <> 'READY_FOR_APPROVAL'
UNION ALL SELECT 'audit_logs', record_id, 'PROCESSING_COMPLETED|document|u1' FROM {_JUDGED}
UNION ALL SELECT 'audit_logs', record_id, 'REVIEW_CREATED|land_record|u1' FROM {_JUDGED} WHERE document_status <> 'READY_FOR_APPROVAL'
UNION ALL SELECT 'failures', record_id, CASE WHEN k % 59 = 0 THEN 'OCR_FAILED' ELSE 'PROVIDER_BAD_RESPONSE' END FROM n_records WHERE NOT {_RIGHT}"""


@check("l4_persist_results", _STORED, "n_records r_issues")
def _(spark, d):
    answers = raw_responses(spark, d)
    return stored_facts(process.process_batch(_pages(answers), answers, v.reference(spark, d), batch_tables(spark, answers), NOW, scratch(spark, "batch")))


@check("l4_persist_touched", _STORED, "n_records r_issues")
def _(spark, d):
    answers, folder = raw_responses(spark, d), scratch(spark, "tables")
    tables = process.create_tables(spark, folder, batch_tables(spark, answers), 8)
    _, failures = process.process_touched(_pages(answers), answers, v.reference(spark, d), tables, f"{folder}/audit_logs", NOW, scratch(spark, "batch"))
    audit = spark.read.parquet(f"{folder}/audit_logs")
    return stored_facts({n: t.read() for n, t in tables.items()} | {"audit_logs": audit, "failures": failures})


def stored_facts(tables):
    """The content of all tables as (name, document, value)."""
    owner = tables["land_records"].select(F.col("record_id").alias("_record"), F.col("document_id").alias("_document"))

    def text(*columns: str):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    def of_record(name: str, key: str, value):
        return tables[name].withColumn("value", value).join(owner, F.col(key) == F.col("_record")).select(F.lit(name).alias("name"), F.col("_document").alias("document"), "value")

    def of_document(name: str, key: str, value):
        return tables[name].select(F.lit(name).alias("name"), F.col(key).alias("document"), value.alias("value"))

    audit = tables["audit_logs"].join(owner, F.col("entity_id") == F.col("_record"), "left")
    parts = [
        of_document("land_records", "document_id", text("status", "owner_name", "survey_number", "village", "tehsil", "district", "area_unit")),
        of_document("documents", "id", F.col("processing_status")), of_document("processing_jobs", "document_id", F.col("status")),
        of_document("ocr_results", "document_id", F.col("text")),
        of_record("extracted_fields", "record_id", F.lit("x")).groupBy("name", "document").agg(F.count("*").cast("string").alias("value")),
        of_record("validation_results", "record_id", text("rule_id", "field_name", "status", "severity", "message")),
        of_record("review_tasks", "land_record_id", text("priority", "status", "reason")),
        audit.select(F.lit("audit_logs").alias("name"), F.coalesce("_document", "entity_id").alias("document"), text("action", "entity_type", "user_id").alias("value")),
        of_document("failures", "document_id", F.col("error_code")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Reports ------------------------------------------------------------------------------------------------------------

@check("p5_ocr_benchmark", """
SELECT id, CASE WHEN failed THEN 1.0 ELSE 0.0 END AS cer, CASE WHEN failed THEN 1.0 ELSE 0.0 END AS wer, failed, CAST(CASE WHEN failed THEN -1 ELSE n END AS BIGINT) AS lines_detected
FROM (SELECT document_id AS id, count(*) AS n, CAST(document_id AS BIGINT) % 10 = 0 AS failed FROM v_lines GROUP BY 1)""", "v_lines")
def _(spark, d):
    from .language import _paged

    pages = _paged(spark, d)
    full = pages.select("document_id", F.transform("pages", lambda p: p.withField("text", F.array_join(F.transform(p["lines"], lambda l: l["text"]), "\n"))).alias("pages"), F.lit(1.0).alias("elapsed_seconds"))
    truth = full.select(F.col("document_id").alias("id"), F.col("pages")[0]["text"].alias("text"), F.transform(F.col("pages")[0]["lines"], lambda l: l["text"]).alias("lines"))
    # Every tenth document has no recognised text.
    results, _ = evaluate.ocr_benchmark(truth, full.filter(F.col("document_id").cast("long") % 10 != 0))
    return results.select("id", "cer", "wer", "failed", F.coalesce("lines_detected", F.lit(-1)).cast("bigint").alias("lines_detected"))


@check("p5_ocr_rates", r"""
SELECT id, round((length(page) - length(replace(page, 'g', ''))) / length(page), 9) AS cer, round(len(list_filter(string_split(page, ' '), lambda w: contains(w, 'g'))) / len(string_split(page, ' ')), 9) AS wer
FROM (SELECT document_id AS id, trim(regexp_replace(lower(string_agg(text, ' ' ORDER BY turn)), '\s+', ' ', 'g')) AS page FROM v_lines GROUP BY 1)""", "v_lines")
def _(spark, d):
    from .language import _paged

    lines = F.transform(F.col("pages")[0]["lines"], lambda l: l["text"])
    pages = _paged(spark, d).withColumn("text", F.array_join(lines, "\n"))
    # Every g is misread, upper or lower case.
    misread = F.regexp_replace("text", "[gG]", "§")
    read = pages.select("document_id", F.transform("pages", lambda p: p.withField("text", misread)).alias("pages"), F.lit(1.0).alias("elapsed_seconds"))
    results, _ = evaluate.ocr_benchmark(pages.select(F.col("document_id").alias("id"), "text", lines.alias("lines")), read)
    return results.select("id", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


# The truth differs from the output in two fields of some records, and every 1 of a page is misread.
_REPORT_ROWS = """(SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE owner_name END AS true_owner,
  CASE WHEN k % 4 = 1 THEN survey_number || 'X' ELSE survey_number END AS true_survey,
  lower(trim(regexp_replace(concat_ws(' ', owner_name, survey_number, area, village, tehsil, district, record_date), '\\s+', ' ', 'g'))) AS page FROM v_outputs)"""
_REPORT_SCORES = f"""(SELECT *, CASE WHEN true_owner IS NULL AND owner_name IS NOT NULL THEN 1 ELSE 0 END AS made_up, CASE WHEN true_survey <> survey_number THEN 1 ELSE 0 END AS wrong,
  (length(page) - length(replace(page, '1', ''))) / length(page) AS cer, len(list_filter(string_split(page, ' '), lambda w: contains(w, '1'))) / len(string_split(page, ' ')) AS wer FROM {_REPORT_ROWS})"""


@check("a30_report", f"""
SELECT count(*) AS documents, count(*) FILTER (failed) AS failures, avg(round((7 - made_up - wrong) / 7, 4)) FILTER (NOT failed) AS mean_accuracy,
  count(*) FILTER (failed OR model <> 'm-new' OR prompt_version <> 'v1') AS extraction_rerun,
  CAST(sum(7 - made_up - wrong) FILTER (NOT failed) AS BIGINT) AS correct, CAST(sum(made_up) FILTER (NOT failed) AS BIGINT) AS hallucinated, CAST(sum(wrong) FILTER (NOT failed) AS BIGINT) AS incorrect,
  CAST(0 AS BIGINT) AS missing, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, CAST(0 AS BIGINT) AS ocr_failures, count(*) * 1.0 AS ocr_seconds,
  round(1 - sum(made_up) FILTER (NOT failed) / count(*) FILTER (NOT failed), 4) AS owner_accuracy, round(1 - sum(wrong) FILTER (NOT failed) / count(*) FILTER (NOT failed), 4) AS survey_accuracy,
  1.0 AS area_accuracy, CAST(7 AS INTEGER) AS names, string_agg(DISTINCT 'p1/' || model, ',' ORDER BY 'p1/' || model) FILTER (NOT failed) AS providers,
  avg(elapsed_seconds) FILTER (NOT failed) AS mean_extraction_seconds, max(elapsed_seconds) FILTER (NOT failed) AS max_extraction_seconds,
  CAST(0 AS BIGINT) AS issues_unknown, CAST(0 AS BIGINT) AS issues_critical, 7 * count(*) FILTER (NOT failed) AS scored_fields, 'd7' AS dataset_version, 'v1' AS prompt_version, 'v1' AS reference_version
FROM {_REPORT_SCORES}""", "v_outputs")
def _(spark, d):
    # The five sources are derived from the same rows, which are built once.
    n = process.stored_once(spark, v.normalized(spark, d).drop("originals"), scratch(spark, "normalized"))
    k = F.col("record_id").cast("long")
    names = ["owner_name", "survey_number", "area", "village", "tehsil", "district", "record_date"]
    manifest = n.select(F.col("record_id").alias("id"))
    truth = n.withColumns({"owner_name": F.when(k % 5 != 0, F.col("owner_name")), "survey_number": F.when(k % 4 == 1, F.concat("survey_number", F.lit("X"))).otherwise(F.col("survey_number"))})
    truth = truth.select(F.col("record_id").alias("id"), *names)
    text = n.select(F.col("record_id").alias("id"), F.concat_ws(" ", *names).alias("text"), F.array(F.lit("x")).alias("lines"))
    read = F.replace(F.col("text"), F.lit("1"), F.lit("§"))
    line = F.struct(read.alias("text"), F.lit(0.9).alias("confidence"), F.lit(None).cast("array<double>").alias("box"))
    ocr = text.select(F.col("id").alias("document_id"), F.array(F.struct(
        F.lit(1).alias("page_number"), read.alias("text"), F.lit(0.9).alias("confidence"), F.array(line).alias("lines"), F.lit(1).alias("width"), F.lit(1).alias("height"))).alias("pages"),
        F.lit(1.0).alias("elapsed_seconds"))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.8).alias("confidence"), F.lit("EXTRACTED").alias("status"))
    outputs = v.outputs_of(n).withColumn("fields", F.transform_values("values", lambda k, _: none))
    report = evaluate.evaluation_report(manifest, truth, text, outputs, ocr, v.reference(spark, d), "m-new", "v1", NOW, "d7")
    per_name = {f"{short}_accuracy": F.element_at("field_accuracy", name) for short, name in (("owner", "owner_name"), ("survey", "survey_number"), ("area", "area"))}
    return report.withColumns(per_name).select(
        "documents", "failures", "mean_accuracy", "extraction_rerun", "correct", "hallucinated", "incorrect", "missing", F.round("mean_cer", 9).alias("mean_cer"),
        F.round("mean_wer", 9).alias("mean_wer"), "ocr_failures", "ocr_seconds", *per_name, F.size("field_accuracy").alias("names"),
        F.array_join(F.transform("providers", lambda p: F.concat(p["provider"], F.lit("/"), p["model"])), ",").alias("providers"),
        "mean_extraction_seconds", "max_extraction_seconds", "issues_unknown", "issues_critical", "scored_fields", "dataset_version", "prompt_version", "reference_version")


# Streams ------------------------------------------------------------------------------------------------------------

_FILES, _PARTS = 4, 2


def _in_files(spark, df, order: str, name: str) -> str:
    """The rows written in order of a column to a few folders, one after the other, as they would arrive."""
    source = scratch(spark, name)
    cuts = df.select(F.percentile_approx(F.unix_micros(order) if order == "ts" else F.col(order), [i / _FILES for i in range(1, _FILES)])).first()[0]
    place = F.unix_micros(order) if order == "ts" else F.col(order)
    part = sum((F.when(place > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(_FILES):
        df.filter(part == i).repartition(_PARTS).write.parquet(f"{source}/f{i}")
    return source


def _event_stream(spark, d, name: str):
    events = v.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source = _in_files(spark, events, "ts", name)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", _PARTS).parquet(f"{source}/*")


@check("st2_failed_attempts", """
SELECT event_id, coalesce(CAST(sum(fail) OVER (PARTITION BY user_id, run ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS BIGINT), 0) AS recent_failures,
  coalesce(sum(fail) OVER (PARTITION BY user_id, run ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW), 0) >= 2 AS blocked, false AS late
FROM (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS fail, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS reset FROM events))""")
def _(spark, d):
    out, kind = scratch(spark, "attempts"), F.col("event_type")
    streams.start_failed_attempts(_event_stream(spark, d, "events"), "user_id", kind.isin("error", "click"), kind == "signup", out,
                                  scratch(spark, "attempts-state"), window_s=43200, limit=2).awaitTermination()
    return spark.read.parquet(out).select("event_id", "recent_failures", "blocked", "late")


@check("st3_drop_repeats", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
k AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL
  SELECT user_id, t FROM (SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + 21600000000) AS t FROM k) WHERE t IS NOT NULL)
SELECT user_id, t FROM k""")
def _(spark, d):
    out, place = scratch(spark, "repeats"), scratch(spark, "repeats-state")
    kept = streams.drop_repeats(_event_stream(spark, d, "requests").select("user_id", "ts"), "user_id", "ts", 21600)
    streams.run_to_end(kept, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n}"), place)
    return spark.read.schema(kept.schema).parquet(out).select("user_id", F.unix_micros("ts").alias("t"))


# Three arrivals: everything, then every sixth document again by two jobs, then every tenth again.
_ROUNDS = """(SELECT record_id, k, survey_number, village, 0 AS n FROM n_records UNION ALL SELECT record_id, k, survey_number, village, 1 FROM n_records WHERE k % 6 = 0
UNION ALL SELECT record_id, k, survey_number, village, 2 FROM n_records WHERE k % 10 = 0)"""


@check("st1_incremental", f"""
SELECT r.n AS batch, r.record_id || ':' || CASE WHEN r.n = 1 THEN 'b' ELSE 'a' END AS job, CASE WHEN k % 59 = 0 THEN 'OCR_FAILED' WHEN k % 53 = 0 THEN 'PROVIDER_BAD_RESPONSE' END AS error_code,
  CASE WHEN {_RIGHT} THEN m.m END AS match_count,
  CASE WHEN NOT {_RIGHT} THEN NULL WHEN i.bad > 0 THEN 'BLOCKED' WHEN i.n > 0 OR m.m > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS verdict
FROM {_ROUNDS} r
LEFT JOIN (SELECT record_id, CASE WHEN coalesce(village, '') <> '' THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS m FROM n_records WHERE {_RIGHT}) m USING (record_id)
LEFT JOIN (SELECT record_id, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS bad FROM r_issues GROUP BY 1) i USING (record_id)
UNION ALL SELECT 1, record_id || ':a', 'JOB_SUPERSEDED', NULL, NULL FROM n_records WHERE k % 6 = 0""", "n_records r_issues")
def _(spark, d):
    answers = raw_responses(spark, d)
    rows = answers.join(_pages(answers), "document_id")
    k = F.col("document_id").cast("long")
    source, target, place = scratch(spark, "arrivals"), scratch(spark, "prepared"), scratch(spark, "arrivals-state")

    def named(df, n: int, job: str):
        return df.withColumn("job_id", F.concat("document_id", F.lit(f":{n}:{job}")))

    again = rows.filter(k % 6 == 0)
    for part in (named(rows, 0, "a"), named(again, 1, "a").unionByName(named(again, 1, "b")), named(rows.filter(k % 10 == 0), 2, "a")):
        # What was added since the last start is one micro-batch.
        part.write.mode("append").json(source)
        streams.start_incremental(spark, source, target, v.reference(spark, d), place, buckets=8).awaitTermination()
    done = spark.read.parquet(target)
    return done.select(F.col("batch").cast("int").alias("batch"), F.concat("document_id", F.lit(":"), F.substring_index("job_id", ":", -1)).alias("job"),
                       "error_code", "match_count", "verdict")


@check("hook_extract_with", r"SELECT doc_id, length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS letters FROM documents")
def _(spark, d):
    def read(batches):
        for part in batches:
            yield part.assign(letters=part.body.str.len())[["doc_id", "letters"]]

    docs = v.table(spark, d, "documents").select("doc_id", compare_key(F.col("text")).alias("body"))
    return process.extract_with(docs, read, "doc_id long, letters long")
