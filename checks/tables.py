"""Sources and sinks, filters, joins, aggregates, windows, ordering."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recordlake.functions import confidence as conf
from recordlake.functions import labels
from recordlake.functions.files import is_stored_path
from recordlake.operators import aggregates as agg
from recordlake.operators import joins, search, windows
from recordlake.plans import process, reports
from recordlake.sources import readers, sinks
from recordlake.sources.keyed import KeyedTable
from recordlake.sources.pages import AUDIT_ORDER, RECORD_ORDER, TASK_ORDER, PagedTable

from . import views as v
from .records import judged
from .registry import check, scratch

NOW = datetime(2001, 1, 1, tzinfo=timezone.utc)


def us(c):
    return F.unix_micros(c.cast("timestamp"))


# Sources and sinks --------------------------------------------------------------------------------------------------

@check("s2_flatten_lines", """
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS line_index, md5(text) AS digest, confidence FROM v_lines""", "v_lines")
def _(spark, d):
    one = v.lines(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "confidence"))).alias("l"))
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.transform("l", lambda x: F.struct(
        x["text"].alias("text"), x["confidence"].alias("confidence"), F.lit(None).cast("array<double>").alias("box"))).alias("lines")))
    from recordlake.operators.ocr import flatten_lines

    return flatten_lines(one.select("document_id", pages.alias("pages"))).select(
        "document_id", F.col("line_index").cast("bigint").alias("line_index"), F.md5("text").alias("digest"), "confidence")


@check("s3_decode_outputs", """
SELECT id, failed, model, area, survey_number FROM v_outputs""", "v_outputs")
def _(spark, d):
    from recordlake.schemas import MODEL_OUTPUT_FILE

    written = v.outputs(spark, d).select(F.to_json(F.struct("*")).alias("j"))
    return written.select(readers.decode_payload(F.col("j"), MODEL_OUTPUT_FILE).alias("o")).select(
        "o.id", "o.failed", "o.model", F.col("o.values")["area"].alias("area"), F.col("o.values")["survey_number"].alias("survey_number"))


@check("s5_with_missing", """
SELECT m.record_id AS id, CASE WHEN m.k % 6 = 5 THEN true ELSE m.failed END AS failed,
  CASE WHEN m.k % 6 = 5 THEN 'NO_OUTPUT' WHEN m.failed THEN 'PROVIDER_TIMEOUT' END AS error_code FROM v_outputs m""", "v_outputs")
def _(spark, d):
    manifest = v.records(spark, d).select(F.col("record_id").alias("id"))
    outputs = v.outputs(spark, d).filter(F.col("id").cast("long") % 6 != 5)
    return joins.with_missing(manifest, outputs).select("id", "failed", "error_code")


_FILE_ERROR = """coalesce(mime_error, CASE WHEN length <= 0 THEN 'EMPTY_FILE' WHEN length > 20000 THEN 'FILE_TOO_LARGE' END,
  CASE WHEN NOT (any_mime = 'application/pdf' AND body LIKE '%\\%PDF-%' ESCAPE '\\' AND left(body, 5) = '%PDF-') THEN 'FILE_CONTENT_MISMATCH' END)"""


@check("s6_ingest_rejects", f"SELECT path, file_name, CAST(length AS BIGINT) AS length, {_FILE_ERROR} AS error_code FROM m_files WHERE {_FILE_ERROR} IS NOT NULL", "m_files")
def _(spark, d):
    return readers.ingest_files(v.files(spark, d), 20000)[1]


@check("s6_ingest_accepted", f"""
SELECT sha256(path) AS id, file_name, any_mime AS file_type, CAST(length AS BIGINT) AS file_size, sha256(body) AS checksum, 'deed' AS document_type, CAST(NULL AS VARCHAR) AS language,
  'documents/' || md5(path) || '/' || md5(sha256(body) || path) || '.pdf' AS storage_path, true AS stored, 'u1' AS uploaded_by FROM m_files WHERE {_FILE_ERROR} IS NULL""", "m_files")
def _(spark, d):
    return readers.ingest_files(v.files(spark, d), 20000, " deed ", " ", "u1")[0].select(
        "id", "file_name", "file_type", "file_size", "checksum", "document_type", "language", "storage_path", is_stored_path(F.col("storage_path")).alias("stored"), "uploaded_by")


@check("s7_projected_scans", """
SELECT 'record' AS kind, status, count(*) AS n FROM v_records GROUP BY status UNION ALL SELECT 'task', status, count(*) FROM v_tasks GROUP BY status""", "v_records v_tasks")
def _(spark, d):
    return agg.count_by(v.records(spark, d).select("status"), "status").select(F.lit("record").alias("kind"), "status", "n").unionByName(
        agg.count_by(v.tasks(spark, d).select("status"), "status").select(F.lit("task").alias("kind"), "status", "n"))


@check("s8_decode_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", readers.decode_payload(F.col("props"), "k int")["k"].alias("k"))


@check("s8_decode_rowset", "SELECT event_id, unnest([CAST(json_extract_string(props, '$.k') AS INTEGER), CAST(event_id % 10 AS INTEGER)]) AS k FROM events")
def _(spark, d):
    e = v.table(spark, d, "events")
    rows = F.concat(F.lit("["), F.col("props"), F.lit(',{"k":'), (F.col("event_id") % 10).cast("string"), F.lit("}]"))
    return e.select("event_id", F.inline(readers.decode_payload(rows, "array<struct<k:int>>")))


_REPLACED = """
SELECT record_id, rule_id, message FROM v_issues WHERE CAST(record_id AS BIGINT) % 5 <> 0
UNION ALL SELECT record_id, 'RECHECKED', 'again' FROM (SELECT DISTINCT record_id FROM v_issues WHERE CAST(record_id AS BIGINT) % 5 = 0)"""


def _replacement(spark, d):
    target = v.issues(spark, d).select("record_id", "rule_id", "message")
    return target, target.filter(F.col("record_id").cast("long") % 5 == 0).select("record_id").distinct().select(
        "record_id", F.lit("RECHECKED").alias("rule_id"), F.lit("again").alias("message"))


@check("s9_replace_by_key", _REPLACED, "v_issues")
def _(spark, d):
    return sinks.replace_by_key(*_replacement(spark, d), "record_id")


@check("s9_replace_touched", _REPLACED, "v_issues")
def _(spark, d):
    target, new = _replacement(spark, d)
    table = KeyedTable(spark, scratch(spark, "issues"), "record_id", 16).create(target)
    table.replace(new)
    return table.read()


_UPSERTED = """
SELECT record_id, CASE WHEN k % 4 = 0 THEN 'DRAFT' ELSE status END AS status, CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 'new' ELSE owner_name END AS owner_name
FROM v_records"""


def _updates(spark, d):
    k = F.col("record_id").cast("long")
    rows = v.records(spark, d).select("record_id", "status", "owner_name")
    # Every fourth record is updated; of those, every third is not on file yet.
    updates = rows.filter(k % 4 == 0).select("record_id", F.lit("DRAFT").alias("status"), F.lit("new").alias("owner_name"))
    return rows.filter((k % 4 != 0) | (k % 3 != 0)), updates


@check("s10_upsert", _UPSERTED, "v_records")
def _(spark, d):
    return sinks.upsert(*_updates(spark, d), "record_id", ["status"])


@check("s10_upsert_touched", _UPSERTED, "v_records")
def _(spark, d):
    rows, updates = _updates(spark, d)
    table = KeyedTable(spark, scratch(spark, "records"), "record_id", 16).create(rows)
    table.upsert(updates, ["status"])
    return table.read()


_ALL_FIELDS = """(SELECT record_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS v FROM (
  SELECT record_id, field_name || '=' || coalesce(value, 'NULL') || '/' || coalesce(extraction_status, '') AS x FROM v_fields) GROUP BY 1)"""
_ALL_ISSUES = """(SELECT record_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS v FROM (
  SELECT record_id, rule_id || ':' || coalesce(field_name, '') || ':' || status || ':' || coalesce(severity, '') || ':' || message AS x FROM v_issues) GROUP BY 1)"""


def _children(out):
    """The children of detail rows as sorted text, and their numbers."""
    def none(c):
        return F.coalesce(c, F.lit(""))

    fields = F.transform("extracted_fields", lambda f: F.concat(f["field_name"], F.lit("="), F.coalesce(f["value"], F.lit("NULL")), F.lit("/"), none(f["extraction_status"])))
    issues = F.transform("validation", lambda i: F.concat_ws(":", i["rule_id"], none(i["field_name"]), i["status"], none(i["severity"]), i["message"]))
    return [F.array_join(F.array_sort(fields), ",").alias("field_values"), F.size("extracted_fields").cast("bigint").alias("fields"),
            F.array_join(F.array_sort(issues), ",").alias("findings"), F.size("validation").cast("bigint").alias("issues")]


@check("s12_export_records", f"""
SELECT r.record_id, r.status, coalesce(f.n, 0) AS fields, coalesce(f.v, '') AS field_values, coalesce(i.n, 0) AS issues, coalesce(i.v, '') AS findings,
  'v1' AS format_version, 0 AS part FROM v_records r
LEFT JOIN {_ALL_FIELDS} f USING (record_id) LEFT JOIN {_ALL_ISSUES} i USING (record_id)""", "v_records v_fields v_issues")
def _(spark, d):
    recs = v.records(spark, d)
    docs = recs.select(F.col("document_id").alias("id"), F.lit("a.pdf").alias("file_name"))
    out = sinks.export_records(recs, v.fields(spark, d), v.issues(spark, d), docs, NOW, part_rows=10_000)
    return out.select("record.record_id", "record.status", *_children(out), "format_version", "part")


@check("s13_export_audit", """
SELECT entity_id AS record_id, CAST((rn - 1) // 20 AS INTEGER) AS part, count(*) AS events, string_agg(action, ',' ORDER BY rn) AS actions
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY at_us, id) AS rn FROM v_audit) GROUP BY ALL""", "v_audit")
def _(spark, d):
    # Small parts, so that the histories here are split as a long one would be.
    return sinks.export_audit(v.audit(spark, d), NOW, part_rows=20).select(
        "record_id", "part", F.size("events").cast("bigint").alias("events"),
        F.array_join(F.transform("events", lambda e: e["action"]), ",").alias("actions"))


def _known(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.filter(F.col("lang") == "en").groupBy(F.upper(F.sha2("text", 256)).alias("sha256")).agg(
        F.min("doc_id").cast("string").alias("fixture_id"))


def _uploads(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), F.sha2("text", 256)).alias("checksum"))


@check("s15_replay_known", """
SELECT doc_id, fixture_id FROM (SELECT doc_id, sha256(text) AS s FROM documents) JOIN
(SELECT sha256(text) AS s, CAST(min(doc_id) AS VARCHAR) AS fixture_id FROM documents WHERE lang = 'en' GROUP BY 1) USING (s)""")
def _(spark, d):
    return readers.replay_known(_uploads(spark, d), _known(spark, d))[0].select("doc_id", "fixture_id")


@check("s15_replay_rejects", """
SELECT doc_id, 'DEMO_DOCUMENT_NOT_RECOGNISED' AS error_code FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def _(spark, d):
    return readers.replay_known(_uploads(spark, d), _known(spark, d))[1].select("doc_id", "error_code")


@check("j11_match_checksum", """
SELECT doc_id, fixture_id FROM (SELECT doc_id, sha256(text) AS s FROM documents) LEFT JOIN
(SELECT sha256(text) AS s, CAST(min(doc_id) AS VARCHAR) AS fixture_id FROM documents WHERE lang = 'en' GROUP BY 1) USING (s)""")
def _(spark, d):
    return joins.match_checksum(_uploads(spark, d), _known(spark, d)).select("doc_id", "fixture_id")


@check("s16_dispatch_approved", """
SELECT record_id, CASE WHEN status = 'APPROVED' THEN 'MOCK_LRMS_DISPATCHED' ELSE 'MOCK_LRMS_NOT_APPROVED' END AS result FROM v_records""", "v_records")
def _(spark, d):
    sent, refused = sinks.dispatch_approved(v.records(spark, d))
    logged = sinks.dispatch_audit(sent, "u1", NOW)
    return logged.select(F.col("entity_id").alias("record_id"), F.col("action").alias("result")).unionByName(
        refused.select("record_id", F.col("error_code").alias("result")))


# Filters ------------------------------------------------------------------------------------------------------------

@check("f2_search_records", """
SELECT record_id FROM v_records WHERE contains(lower(owner_name), 'customer#00000001') AND contains(lower(tehsil), 'nation_1') AND status = 'APPROVED'""", "v_records")
def _(spark, d):
    return search.search_records(
        v.records(spark, d), owner=" CUSTOMER#00000001 ", tehsil="nation_1", status="APPROVED", village="  ").select("record_id")


@check("f2_search_literal", "SELECT record_id FROM v_records WHERE contains(lower(survey_number), '1%') OR contains(lower(survey_number), '9/6')", "v_records")
def _(spark, d):
    rows = v.records(spark, d)
    return search.search_records(rows, survey_number="1%").unionByName(search.search_records(rows, survey_number="9/6")).select("record_id")


@check("f5_filter_queue", """
SELECT id FROM v_tasks WHERE status = 'PENDING' AND priority IN ('HIGH', 'URGENT') AND assigned_to IS NULL AND contains(lower(reason || ' ' || land_record_id), 'reason 4')
UNION ALL SELECT id FROM v_tasks WHERE priority = 'LOW' AND assigned_to = '3'""", "v_tasks")
def _(spark, d):
    t = v.tasks(spark, d)
    return search.filter_queue(t, query="REASON 4", status="PENDING", priority="HIGH_PLUS", assignee="UNASSIGNED").select("id").unionByName(
        search.filter_queue(t, priority="LOW", assignee="MINE", me="3").select("id"))


@check("f6_open_tasks", "SELECT id, status FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW')", "v_tasks")
def _(spark, d):
    return search.open_tasks(v.tasks(spark, d)).select("id", "status")


@check("u1_union_open", "SELECT id, status FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW')", "v_tasks")
def _(spark, d):
    t = v.tasks(spark, d)
    return search.union_open(t.filter("status = 'PENDING'"), t.filter("status = 'IN_REVIEW'")).select("id", "status")


_DESCRIBED = """SELECT id, entity_id, at_us, CASE action WHEN 'PROCESSING_STARTED' THEN 'Processing started' WHEN 'FIELD_CORRECTED' THEN 'Field corrected'
  WHEN 'RECORD_APPROVED' THEN 'Record approved' WHEN 'RECORD_REJECTED' THEN 'Record rejected' WHEN 'REVIEW_CREATED' THEN 'Review opened' ELSE action END AS title,
  CASE WHEN user_id IS NULL THEN 'Pipeline' ELSE 'Officer' END AS source, CASE WHEN user_id IS NULL THEN 'System' ELSE left(user_id, 8) || '…' END AS actor,
  CASE WHEN action IN ('FIELD_CORRECTED', 'RECORD_REJECTED') AND n % 2 = 1 THEN 'Reason: note ' || number
    WHEN action = 'RECORD_APPROVED' THEN 'Accepted as it stands.' ELSE '' END AS description,
  CASE WHEN n % 6 = 1 THEN 'area:' || number || '>' || CAST(n AS VARCHAR) || '|unit:—>ha' END AS changes FROM v_audit"""


def _changes(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["label"], F.lit(":"), x["old"], F.lit(">"), x["new"])), "|")


@check("n47_describe_audit", f"SELECT id, title, source, actor, description, changes FROM ({_DESCRIBED})", "v_audit")
def _(spark, d):
    return search.describe_audit(v.audit(spark, d)).select("id", "title", "source", "actor", "description", _changes("changes").alias("changes"))


@check("f8_filter_audit", f"""
SELECT id FROM ({_DESCRIBED}) WHERE source = 'Officer' AND contains(lower(concat_ws(' ', title, source, actor, description, replace(replace(replace(changes, ':', ' '), '>', ' '), '|', ' '))), 'note 7')""", "v_audit")
def _(spark, d):
    return search.filter_audit(search.describe_audit(v.audit(spark, d)), "Officer", "OFFICER", " Note 7 ").select("id")


@check("u5_changed_keys", "SELECT id, CASE WHEN n % 6 = 1 THEN 'area,unit' END AS keys FROM v_audit", "v_audit")
def _(spark, d):
    a = v.audit(spark, d)
    old, new = (F.from_json(c, "map<string,string>") for c in ("old_value", "new_value"))
    return a.select("id", F.array_join(labels.changed_keys(old, new), ",").alias("keys"))


@check("f9_is_actionable", """
SELECT record_id, rule_id, coalesce(status IN ('FAIL', 'REVIEW_REQUIRED') OR severity IN ('WARNING', 'ERROR', 'CRITICAL'), false) AS actionable FROM v_issues""", "v_issues")
def _(spark, d):
    return v.issues(spark, d).select("record_id", "rule_id", conf.is_actionable(F.col("status"), F.col("severity")).alias("actionable"))


@check("f10_has_evidence", """
SELECT record_id, field_name, has_box OR coalesce(source_text, '') <> '' OR source_page IS NOT NULL AS evidence FROM v_fields""", "v_fields")
def _(spark, d):
    return v.fields(spark, d).select(
        "record_id", "field_name", labels.has_evidence(F.col("bounding_box"), F.col("source_text"), F.col("source_page")).alias("evidence"))


_DOC_STATUS = ["UPLOADED", "PROCESSING", "APPROVED", "EXTRACTION", "FAILED", "REVIEW_REQUIRED", "VALIDATION_FAILED"]


def documents(spark, d):
    """Documents with one of seven states."""
    k = F.col("record_id").cast("long")
    return v.records(spark, d).select(
        F.col("record_id").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in _DOC_STATUS]), (k % 7 + 1).cast("int")).alias("processing_status"))


_SQL_DOCS = f"(SELECT record_id AS id, k, {_DOC_STATUS}[k % 7 + 1] AS processing_status FROM v_records)"


@check("f11_process_eligibility", f"""
SELECT id, CASE processing_status WHEN 'PROCESSING' THEN 'PROCESSING_IN_PROGRESS' WHEN 'APPROVED' THEN 'DOCUMENT_FINALIZED' WHEN 'EXTRACTION' THEN 'DOCUMENT_NOT_PROCESSABLE' END AS code
FROM {_SQL_DOCS}""", "v_records")
def _(spark, d):
    return documents(spark, d).select("id", labels.process_eligibility(F.col("processing_status")).alias("code"))


@check("f12_active_jobs", "SELECT record_id AS document_id FROM v_records WHERE record_id IN (SELECT document_id FROM v_jobs WHERE status IN ('PENDING', 'RUNNING'))", "v_records v_jobs")
def _(spark, d):
    return joins.has_active_job(v.records(spark, d).select("document_id"), v.jobs(spark, d))


# Joins --------------------------------------------------------------------------------------------------------------

@check("j1_join_outputs", "SELECT record_id AS id, model FROM v_outputs WHERE k % 6 <> 5", "v_outputs")
def _(spark, d):
    manifest = v.records(spark, d).select(F.col("record_id").alias("id"))
    return joins.join_outputs(manifest, v.outputs(spark, d).filter(F.col("id").cast("long") % 6 != 5), "inner").select("id", "model")


@check("j2_align_fields", "\nUNION ALL\n".join(
    f"SELECT r.record_id AS id, '{n}' AS field_name, r.{n} AS expected, {'o.' + n if n in ('owner_name', 'area', 'record_date') else 'NULL'} AS got FROM v_records r JOIN v_outputs o USING (record_id)"
    for n in ("owner_name", "area", "record_date", "khata_number")), "v_records v_outputs")
def _(spark, d):
    truth = v.records(spark, d).select(F.col("record_id").alias("id"), "owner_name", "area", "record_date", "khata_number")
    return joins.align_fields(truth, v.outputs(spark, d))


@check("j3_record_detail", f"""
SELECT r.record_id, coalesce(f.n, 0) AS fields, coalesce(f.v, '') AS field_values, coalesce(i.n, 0) AS issues, coalesce(i.v, '') AS findings, r.record_id || '.pdf' AS file_name
FROM v_records r LEFT JOIN {_ALL_FIELDS} f USING (record_id) LEFT JOIN {_ALL_ISSUES} i USING (record_id)""", "v_records v_fields v_issues")
def _(spark, d):
    recs = v.records(spark, d)
    docs = recs.select(F.col("document_id").alias("id"), F.concat("document_id", F.lit(".pdf")).alias("file_name"))
    out = joins.record_detail(recs, v.fields(spark, d), v.issues(spark, d), docs, part_rows=10_000)
    return out.select("record_id", *_children(out), "document.file_name")


@check("j10_attach_issues", """
SELECT f.record_id, f.field_name, f.value, count(i.rule_id) AS issues, coalesce(string_agg(i.rule_id || ':' || i.message, ',' ORDER BY i.rule_id || ':' || i.message), '') AS findings
FROM v_fields f LEFT JOIN v_issues i USING (record_id, field_name) GROUP BY 1, 2, 3""", "v_fields v_issues")
def _(spark, d):
    found = F.transform("issues", lambda i: F.concat(i["rule_id"], F.lit(":"), i["message"]))
    return joins.attach_issues(v.fields(spark, d), v.issues(spark, d), part_rows=10_000).select(
        "record_id", "field_name", "value", F.size("issues").cast("bigint").alias("issues"), F.array_join(F.array_sort(found), ",").alias("findings"))


@check("j10_record_level", "SELECT record_id, rule_id, message FROM v_issues WHERE field_name IS NULL", "v_issues")
def _(spark, d):
    return joins.record_level_issues(v.issues(spark, d)).select("record_id", "rule_id", "message")


_RERUN = """SELECT id, CASE WHEN k % 6 = 5 THEN 'missing' WHEN failed THEN 'failed' WHEN model <> 'm-new' OR prompt_version <> 'v1' THEN 'stale' END AS reason FROM v_outputs"""


def _plan(spark, d):
    manifest = v.records(spark, d).select(F.col("record_id").alias("id"))
    return joins.plan_rerun(manifest, v.outputs(spark, d).filter(F.col("id").cast("long") % 6 != 5), "m-new", "v1")


@check("j12_plan_rerun", f"SELECT id, reason FROM ({_RERUN}) WHERE reason IS NOT NULL", "v_outputs")
def _(spark, d):
    return _plan(spark, d)


@check("u3_rerun_ids", f"SELECT id FROM ({_RERUN}) WHERE reason IS NOT NULL", "v_outputs")
def _(spark, d):
    p = _plan(spark, d)
    return joins.rerun_ids(p.filter("reason = 'missing'"), p.filter("reason <> 'missing' or id like '%5'"))


@check("j13_reuse_cached", """
SELECT r.event_id AS request_id, max(epoch_us(c.ts)) AS cached_us FROM events r
LEFT JOIN events c ON c.event_type = 'view' AND c.user_id = r.user_id AND c.ts <= r.ts AND epoch_us(r.ts) - epoch_us(c.ts) <= 7200000000
WHERE r.event_type = 'click' GROUP BY 1""")
def _(spark, d):
    e = v.table(spark, d, "events")
    requests = e.filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    cache = e.filter("event_type = 'view'").select(F.col("event_id").alias("cache_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return joins.reuse_cached(requests, cache, 7200).select("request_id", us(F.col("cached_at")).alias("cached_us"))


@check("j14_open_task", """
SELECT r.record_id, t.id AS task_id, t.status AS task_status FROM v_records r LEFT JOIN
(SELECT * FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW') QUALIFY row_number() OVER (PARTITION BY land_record_id ORDER BY created_at DESC, id DESC) = 1) t
ON t.land_record_id = r.record_id""", "v_records v_tasks")
def _(spark, d):
    return joins.open_task_of(v.records(spark, d), v.tasks(spark, d)).select("record_id", "task_id", "task_status")


_LATEST = """(SELECT land_record_id, field_name, new_value FROM v_corrections QUALIFY row_number() OVER (PARTITION BY land_record_id, field_name ORDER BY at_us DESC, new_value DESC) = 1)"""


@check("j17_overlay_corrections", f"""
SELECT r.record_id, CASE WHEN o.land_record_id IS NOT NULL THEN o.new_value ELSE r.owner_name END AS owner_name,
  CASE WHEN a.land_record_id IS NOT NULL THEN a.new_value ELSE r.area END AS area, CASE WHEN w.land_record_id IS NOT NULL THEN w.new_value ELSE r.village END AS village
FROM v_records r LEFT JOIN {_LATEST} o ON o.land_record_id = r.record_id AND o.field_name = 'owner_name'
LEFT JOIN {_LATEST} a ON a.land_record_id = r.record_id AND a.field_name = 'area' LEFT JOIN {_LATEST} w ON w.land_record_id = r.record_id AND w.field_name = 'village'""",
       "v_records v_corrections")
def _(spark, d):
    return joins.overlay_corrections(v.records(spark, d), v.corrections(spark, d)).select("record_id", "owner_name", "area", "village")


# Aggregates ---------------------------------------------------------------------------------------------------------

@check("a1_count_by", "SELECT coalesce(nullif(severity, ''), 'UNKNOWN') AS severity, count(*) AS n FROM v_issues GROUP BY 1", "v_issues")
def _(spark, d):
    return agg.count_by(v.issues(spark, d), "severity")


@check("t5_histogram", "SELECT district, count(*) AS n FROM v_records GROUP BY 1 ORDER BY n DESC, district", "v_records")
def _(spark, d):
    return agg.histogram(v.records(spark, d), "district")


@check("a2_dashboard_summary", f"""
SELECT 'documents_total' AS metric, NULL AS key, CAST(count(*) AS DOUBLE) AS value FROM v_records
UNION ALL SELECT 'documents_by_status', processing_status, count(*) FROM {_SQL_DOCS} GROUP BY 2
UNION ALL SELECT 'records_by_status', status, count(*) FROM v_records GROUP BY 2
UNION ALL SELECT 'open_reviews', NULL, count(*) FILTER (status IN ('PENDING', 'IN_REVIEW')) FROM v_tasks
UNION ALL SELECT 'average_confidence', NULL, avg(confidence) FROM v_fields""", "v_records v_tasks v_fields")
def _(spark, d):
    return agg.dashboard_summary(documents(spark, d), v.records(spark, d), v.tasks(spark, d), v.fields(spark, d))


@check("a3_processing_panel", "SELECT status, count(*) AS n FROM (SELECT * FROM v_jobs ORDER BY created_us DESC, id DESC LIMIT 10) GROUP BY status", "v_jobs")
def _(spark, d):
    return agg.processing_panel(v.jobs(spark, d))[0]


@check("t7_recent_jobs", "SELECT id, status FROM v_jobs ORDER BY created_us DESC, id DESC LIMIT 10", "v_jobs")
def _(spark, d):
    return agg.processing_panel(v.jobs(spark, d))[1].select("id", "status")


@check("a4_validation_panel", f"""
SELECT 'issues_by_severity' AS metric, coalesce(severity, 'UNKNOWN') AS key, CAST(count(*) AS DOUBLE) AS value FROM v_issues GROUP BY 2
UNION ALL SELECT 'issues_by_status', status, count(*) FROM v_issues GROUP BY 2
UNION ALL SELECT 'blocked_documents', NULL, count(*) FILTER (processing_status = 'VALIDATION_FAILED') FROM {_SQL_DOCS}""", "v_issues v_records")
def _(spark, d):
    return agg.validation_panel(v.issues(spark, d), documents(spark, d))


@check("a5_sum_counts", "SELECT record_id, count(*) AS total FROM v_issues GROUP BY 1", "v_issues")
def _(spark, d):
    counts = [F.struct(F.lit(s).alias("k"), F.count_if(F.col("status") == s).alias("v")) for s in ("PASS", "FAIL", "WARNING", "REVIEW_REQUIRED", "NOT_CHECKED")]
    rows = v.issues(spark, d).groupBy("record_id").agg(F.map_from_entries(F.array(*counts)).alias("m"))
    return rows.select("record_id", agg.sum_counts(F.col("m")).alias("total"))


@check("a12_flagged_fields", "SELECT count(*) FILTER (confidence IS NULL OR confidence < 0.6) AS flagged, count(*) AS total FROM v_fields", "v_fields")
def _(spark, d):
    return agg.flagged_fields(v.fields(spark, d).withColumn("review_required", F.col("confidence").isNull() | (F.col("confidence") < 0.6)))


@check("a18_distinct_providers", "SELECT DISTINCT 'p1' AS provider, model FROM v_outputs WHERE NOT failed", "v_outputs")
def _(spark, d):
    return agg.distinct_providers(v.outputs(spark, d))


@check("a20_pass_rate", "SELECT count(*) FILTER (status = 'PASS') / count(*) FILTER (status <> 'NOT_CHECKED') AS pass_rate FROM v_issues", "v_issues")
def _(spark, d):
    return agg.pass_rate(v.issues(spark, d))


@check("a21_review_share", """
SELECT open_reviews, records, open_reviews / records AS review_share FROM (SELECT count(*) FILTER (status IN ('PENDING', 'IN_REVIEW')) AS open_reviews FROM v_tasks), (SELECT count(*) AS records FROM v_records)""",
       "v_tasks v_records")
def _(spark, d):
    return agg.review_share(v.tasks(spark, d), v.records(spark, d))


@check("a22_mean_job_duration", """
SELECT round(avg((completed_us - started_us) / 1e6), 6) AS seconds, count(*) AS jobs FROM v_jobs WHERE completed_us >= started_us""", "v_jobs")
def _(spark, d):
    return agg.mean_job_duration(v.jobs(spark, d)).select(F.round("seconds", 6).alias("seconds"), "jobs")


@check("a23_mean_task_age", """
SELECT round(avg((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(created_at)) / 3600e6), 6) AS hours, count(*) AS tasks FROM v_tasks
WHERE status IN ('PENDING', 'IN_REVIEW') AND created_at <= TIMESTAMP '2001-01-01'""", "v_tasks")
def _(spark, d):
    return agg.mean_task_age_hours(search.open_tasks(v.tasks(spark, d)), NOW).select(F.round("hours", 6).alias("hours"), "tasks")


@check("a24_audit_counts", """
SELECT count(*) FILTER (action = 'FIELD_CORRECTED') AS corrections, count(user_id) AS officer_events, count(*) - count(user_id) AS system_events FROM v_audit""", "v_audit")
def _(spark, d):
    return agg.audit_counts(v.audit(spark, d))


@check("a25_record_page_counts", """
SELECT record_id, coalesce(blocking, 0) AS blocking, coalesce(warnings, 0) AS warnings, coalesce(cited_fields, 0) AS cited_fields, coalesce(corrections, 0) AS corrections
FROM (SELECT record_id, count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) AS blocking, count(*) FILTER (severity = 'WARNING') AS warnings FROM v_issues GROUP BY 1)
FULL JOIN (SELECT record_id, count(*) FILTER (has_box OR coalesce(source_text, '') <> '' OR source_page IS NOT NULL) AS cited_fields FROM v_fields GROUP BY 1) USING (record_id)
FULL JOIN (SELECT entity_id AS record_id, count(*) FILTER (action = 'FIELD_CORRECTED') AS corrections FROM v_audit GROUP BY 1) USING (record_id)""", "v_issues v_fields v_audit")
def _(spark, d):
    return agg.record_page_counts(v.issues(spark, d), v.fields(spark, d), v.audit(spark, d))


@check("a26_queue_tiles", """
SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (priority IN ('HIGH', 'URGENT')) AS high, count(*) - count(assigned_to) AS unassigned,
  count(*) FILTER (status <> 'PENDING') AS in_progress FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW')""", "v_tasks")
def _(spark, d):
    return agg.queue_tiles(search.open_tasks(v.tasks(spark, d)))


_TILES = f"""SELECT * FROM (SELECT count(*) AS records_total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'READY_FOR_APPROVAL') AS ready FROM v_records),
(SELECT count(*) AS documents_total, count(*) FILTER (processing_status = 'PROCESSING') AS processing, count(*) FILTER (processing_status = 'UPLOADED') AS uploaded FROM {_SQL_DOCS}),
(SELECT count(*) FILTER (status IN ('PENDING', 'IN_REVIEW')) AS pending_review FROM v_tasks),
(SELECT count(*) AS issues_total, count(*) FILTER (severity = 'WARNING') AS warning_issues, count(*) FILTER (coalesce(severity, '') <> 'WARNING') AS non_warning_issues FROM v_issues)"""


def _tables(spark, d):
    return {"documents": documents(spark, d), "land_records": v.records(spark, d), "review_tasks": v.tasks(spark, d),
            "validation_results": v.issues(spark, d), "processing_jobs": v.jobs(spark, d), "extracted_fields": v.fields(spark, d)}


@check("a27_dashboard_tiles", _TILES, "v_records v_tasks v_issues")
def _(spark, d):
    return reports.dashboard(_tables(spark, d))["tiles"]


@check("p8_analytics", """
SELECT * FROM (SELECT count(*) FILTER (status = 'PASS') / count(*) FILTER (status <> 'NOT_CHECKED') AS pass_rate FROM v_issues),
(SELECT open_reviews, records, open_reviews / records AS review_share FROM (SELECT count(*) FILTER (status IN ('PENDING', 'IN_REVIEW')) AS open_reviews FROM v_tasks), (SELECT count(*) AS records FROM v_records)),
(SELECT round(avg((completed_us - started_us) / 1e6), 6) AS seconds, count(*) AS jobs FROM v_jobs WHERE completed_us >= started_us),
(SELECT round(avg((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(created_at)) / 3600e6), 6) AS hours, count(*) AS tasks FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW') AND created_at <= TIMESTAMP '2001-01-01')""",
       "v_issues v_tasks v_records v_jobs")
def _(spark, d):
    return reports.analytics(_tables(spark, d), NOW).withColumns({"seconds": F.round("seconds", 6), "hours": F.round("hours", 6)})


def _stages(spark, d):
    j = v.jobs(spark, d).filter("started_at is not null and completed_at is not null")
    stage = F.element_at(F.array(F.lit("ocr"), F.lit("extraction"), F.lit("validation")), (F.col("id").cast("long") % 3 + 1).cast("int"))
    return j.select(stage.alias("stage"), F.col("id").alias("document_id"), agg.seconds_between(F.col("started_at"), F.col("completed_at")).alias("seconds"),
                    (F.col("status") == "FAILED").alias("failed"))


_STAGES = """(SELECT ['ocr', 'extraction', 'validation'][n % 3 + 1] AS stage, id AS document_id, (completed_us - started_us) / 1e6 AS seconds, status = 'FAILED' AS failed FROM v_jobs
WHERE started_us IS NOT NULL AND completed_us IS NOT NULL)"""


@check("a28_stage_latency", f"SELECT stage, document_id, seconds FROM {_STAGES}", "v_jobs")
def _(spark, d):
    return agg.stage_latency(_stages(spark, d))


@check("a28_stage_summary", f"SELECT stage, count(*) AS documents, round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds FROM {_STAGES} GROUP BY 1", "v_jobs")
def _(spark, d):
    return agg.stage_latency_summary(_stages(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@check("a28_stage_failures", f"SELECT stage, document_id FROM {_STAGES} WHERE failed", "v_jobs")
def _(spark, d):
    return agg.stage_failures(_stages(spark, d))


# Windows and order --------------------------------------------------------------------------------------------------

@check("wn1_latest_job", "SELECT document_id, id, status FROM v_jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_us DESC, id DESC) = 1", "v_jobs")
def _(spark, d):
    return windows.latest_job(v.jobs(spark, d)).select("document_id", "id", "status")


@check("wn2_latest_open_task", """
SELECT land_record_id, id FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW') QUALIFY row_number() OVER (PARTITION BY land_record_id ORDER BY created_at DESC, id DESC) = 1""", "v_tasks")
def _(spark, d):
    return windows.latest_open_task(v.tasks(spark, d)).select("land_record_id", "id")


@check("wn4_failed_attempts", """
SELECT event_id, coalesce(CAST(sum(fail) OVER (PARTITION BY user_id, run ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS BIGINT), 0) AS recent_failures,
  coalesce(sum(fail) OVER (PARTITION BY user_id, run ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW), 0) >= 2 AS blocked
FROM (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS fail, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS reset FROM events))""")
def _(spark, d):
    kind = F.col("event_type")
    return windows.failed_attempt_rate(
        v.table(spark, d, "events"), "user_id", kind.isin("error", "click"), kind == "signup", window_s=43200, limit=2
    ).select("event_id", "recent_failures", "blocked")


@check("wn5_latest_corrections", f"SELECT land_record_id, field_name, new_value FROM {_LATEST}", "v_corrections")
def _(spark, d):
    return windows.latest_corrections(v.corrections(spark, d)).select("land_record_id", "field_name", "new_value")


@check("wn6_audit_positions", "SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY at_us, id) AS position FROM v_audit", "v_audit")
def _(spark, d):
    return windows.audit_positions(v.audit(spark, d)).select("id", "position")


@check("wn7_stage_durations", "SELECT id, (lead(at_us) OVER (PARTITION BY entity_id ORDER BY at_us, id) - at_us) / 1e6 AS seconds FROM v_audit", "v_audit")
def _(spark, d):
    return windows.stage_durations(v.audit(spark, d)).select("id", "seconds")


@check("t1_page_records", "SELECT record_id FROM v_records ORDER BY updated_at DESC, record_id LIMIT 25 OFFSET 50", "v_records")
def _(spark, d):
    return search.page_records(v.records(spark, d), 3, 25)[0].select("record_id")


@check("t2_page_tasks", "SELECT id FROM v_tasks ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20", "v_tasks")
def _(spark, d):
    return search.page_tasks(v.tasks(spark, d), 2, 20)[0].select("id")


@check("t3_page_audit", "SELECT id FROM v_audit ORDER BY at_us, id LIMIT 30 OFFSET 60", "v_audit")
def _(spark, d):
    return search.page_audit(v.audit(spark, d), 3, 30)[0].select("id")


def _after(df, order, pages: int, limit: int):
    """The page after ``pages`` pages, each reached from the last row of the one before."""
    last = None
    for _ in range(pages):
        last = search.page_after(df, order, last, limit).tail(1)[0].asDict()
    return search.page_after(df, order, last, limit)


@check("t1_page_after", "SELECT record_id FROM v_records ORDER BY updated_at DESC, record_id LIMIT 25 OFFSET 50", "v_records")
def _(spark, d):
    return _after(v.records(spark, d), [("updated_at", False), ("record_id", True)], 2, 25).select("record_id")


@check("t3_page_after", "SELECT id FROM v_audit ORDER BY at_us, id LIMIT 30 OFFSET 60", "v_audit")
def _(spark, d):
    return _after(v.audit(spark, d), [("timestamp", True), ("id", True)], 2, 30).select("id")


def _deep(spark, rows, order, limit: int):
    """The last full page out of a layout by position."""
    table = PagedTable(spark, scratch(spark, "pages"), order, 16).create(rows)
    return table.page(max(1, table.total() // limit), limit)


def _deep_sql(key: str, order: str, view: str, limit: int) -> str:
    return f"""SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY {order}) AS p, count(*) OVER () AS n FROM {view})
WHERE p > greatest(n // {limit} - 1, 0) * {limit} AND p <= greatest(n // {limit}, 1) * {limit}"""


@check("t1_page_deep", _deep_sql("record_id", "updated_at DESC NULLS LAST, record_id", "v_records", 25), "v_records")
def _(spark, d):
    return _deep(spark, v.records(spark, d), RECORD_ORDER, 25).select("record_id")


@check("t2_page_deep", _deep_sql("id", "created_at DESC NULLS LAST, id DESC", "v_tasks", 20), "v_tasks")
def _(spark, d):
    return _deep(spark, v.tasks(spark, d), TASK_ORDER, 20).select("id")


@check("t3_page_deep", _deep_sql("id", "at_us NULLS LAST, id", "v_audit", 30), "v_audit")
def _(spark, d):
    return _deep(spark, v.audit(spark, d), AUDIT_ORDER, 30).select("id")


@check("t2_page_after", "SELECT id FROM v_tasks ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40", "v_tasks")
def _(spark, d):
    return _after(v.tasks(spark, d), [("created_at", False), ("id", False)], 2, 20).select("id")


def _queue(spark, d, mode):
    return search.first_n(v.tasks(spark, d), search.queue_order(mode), 40).select("id")


_QUEUE = "CASE priority WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
for _mode, _order in {"PRIORITY": f"{_QUEUE}, created_at, id", "OLDEST": "created_at, id", "NEWEST": "created_at DESC, id"}.items():
    check(f"t4_queue_{_mode.lower()}", f"SELECT id FROM v_tasks ORDER BY {_order} LIMIT 40", "v_tasks")(
        lambda spark, d, mode=_mode: _queue(spark, d, mode))


@check("t4_sort_queue", f"SELECT id, {_QUEUE} AS rank FROM v_tasks ORDER BY {_QUEUE}, created_at, id", "v_tasks")
def _(spark, d):
    return search.sort_queue(v.tasks(spark, d)).select("id", labels.priority_rank(F.col("priority")).alias("rank"))


@check("n43_priority_rank", f"SELECT priority, {_QUEUE} AS rank, count(*) AS n FROM v_tasks GROUP BY 1, 2", "v_tasks")
def _(spark, d):
    return v.tasks(spark, d).groupBy("priority", labels.priority_rank(F.col("priority")).alias("rank")).agg(F.count("*").alias("n"))


@check("n46_failure_stage", """
SELECT id, CASE WHEN error_code = 'OCR_FAILED' THEN 2 WHEN error_code = 'RENDER_FAILED' THEN 1 WHEN error_code LIKE 'PROVIDER_%' THEN 4 END AS stage FROM v_jobs""", "v_jobs")
def _(spark, d):
    return v.jobs(spark, d).select("id", labels.failure_stage(F.col("status"), F.col("error_code")).alias("stage"))


# Measures without code in the source documents ----------------------------------------------------------------------

@check("x1_rule_confusion", """
SELECT rule_id, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (NOT e AND NOT f) AS tn, count(*) FILTER (e AND NOT f) AS fn
FROM (SELECT rule_id, status <> 'PASS' AS f, CAST(record_id AS BIGINT) % 3 = 0 AS e FROM v_issues) GROUP BY 1""", "v_issues")
def _(spark, d):
    rows = v.issues(spark, d).select("rule_id", (F.col("status") != "PASS").alias("flagged"), (F.col("record_id").cast("long") % 3 == 0).alias("expected"))
    return agg.rule_confusion(rows)


_BAND = "CASE WHEN confidence IS NULL THEN 'REVIEW_REQUIRED' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"


@check("x2_correction_rate", f"""
SELECT band, count(*) AS fields, count(c) AS corrected, count(c) / count(*) AS correction_rate FROM (SELECT record_id, field_name, {_BAND} AS band FROM v_fields)
LEFT JOIN (SELECT DISTINCT land_record_id AS record_id, field_name, 1 AS c FROM v_corrections) USING (record_id, field_name) GROUP BY 1""", "v_fields v_corrections")
def _(spark, d):
    return agg.correction_rate_by_band(v.fields(spark, d).withColumn("band", conf.band(F.col("confidence"))), v.corrections(spark, d))


@check("x3_review_effort", """
SELECT (SELECT count(DISTINCT land_record_id) FROM v_tasks) / (SELECT count(*) FROM v_records) AS reviewed_share,
  (SELECT avg(epoch_us(completed_at) - epoch_us(created_at)) / 3600e6 FROM v_tasks WHERE completed_at IS NOT NULL) AS mean_hours,
  (SELECT count(DISTINCT (land_record_id, field_name)) FROM v_corrections) / (SELECT count(*) FROM v_fields) AS corrected_share""", "v_tasks v_records v_corrections v_fields")
def _(spark, d):
    return agg.review_effort(v.tasks(spark, d), v.records(spark, d), v.fields(spark, d), v.corrections(spark, d))


@check("x5_split_bucket", """
SELECT doc_id, CASE WHEN b < 70 THEN 'dev' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 100 AS b FROM documents)""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", agg.split_bucket(F.col("doc_id")).alias("split"))


# Whole jobs over these tables ---------------------------------------------------------------------------------------

@check("p2_check_outputs", """
SELECT o.id, o.failed, CASE WHEN o.failed THEN 'PROVIDER_TIMEOUT' END AS error_code, CASE WHEN NOT o.failed THEN m.n END AS match_count,
  CASE WHEN NOT o.failed THEN coalesce(b.blocking, false) END AS area_error FROM v_outputs o
LEFT JOIN (SELECT id, CASE WHEN coalesce(village, '') <> '' THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS n FROM v_outputs WHERE NOT failed) m USING (id)
LEFT JOIN (SELECT record_id AS id, true AS blocking FROM r_issues WHERE severity = 'ERROR') b USING (id)""", "v_outputs r_issues")
def _(spark, d):
    manifest = v.records(spark, d).select(F.col("record_id").alias("id"))
    out = process.check_outputs(manifest, v.outputs(spark, d), v.reference(spark, d))
    return out.select("id", "failed", "error_code", "match_count", (F.col("verdict") == "BLOCKED").alias("area_error"))


@check("p2_judged_outputs", "SELECT verdict, count(*) AS n, CAST(sum(issues) AS BIGINT) AS issues FROM verdicts GROUP BY 1", "verdicts")
def _(spark, d):
    return judged(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.size("issues")).cast("bigint").alias("issues"))
