"""Responses, files, scripts, text distance, evaluation, confidence, recognised text."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recordlake.functions import confidence as conf
from recordlake.functions import distance, files, labels, responses, scripts
from recordlake.functions.text import compare_key
from recordlake.operators import aggregates as agg
from recordlake.operators import evaluation as ev
from recordlake.operators import joins, ocr
from recordlake.plans import evaluate, process
from recordlake.schemas import FIELD_NAMES
from recordlake.sources.readers import spread

from . import views as v
from .registry import check

NOW = datetime(2001, 1, 1, tzinfo=timezone.utc)


# Responses ----------------------------------------------------------------------------------------------------------

@check("n6_coerce_value", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN k WHEN 1 THEN 'x ' || k WHEN 2 THEN 'true' END AS value,
  CASE event_id % 6 WHEN 3 THEN 'MISSING' WHEN 4 THEN 'UNCERTAIN' WHEN 5 THEN 'MISSING' ELSE 'EXTRACTED' END AS status
FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def _(spark, d):
    e = v.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, k).when(kind == 1, F.concat(F.lit('" x '), k, F.lit(' "'))).when(kind == 2, "true")
        .when(kind == 3, "null").when(kind == 4, F.concat(F.lit("["), k, F.lit("]"))).otherwise('"  "')
    )
    return e.select("event_id", responses.coerce_value(F.try_parse_json(raw)).alias("c")).select("event_id", "c.*")


@check("n7_coerce_confidence", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(1.0, k / 50.0) WHEN event_id % 4 = 1 THEN k / 100.0 WHEN event_id % 4 = 2 THEN 1.0 END AS confidence
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def _(spark, d):
    e = v.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, (k / 50).cast("string")).when(kind == 1, F.concat(F.lit('"'), (k / 100).cast("string"), F.lit('"'))).when(
        kind == 2, "true").otherwise('"high"')
    return e.select("event_id", responses.coerce_confidence(F.try_parse_json(raw)).alias("confidence"))


@check("n7_confidence_text", """
SELECT record_id, field_name, CASE WHEN confidence IS NOT NULL THEN least(1.0, greatest(0.0, confidence * 2 - 0.5)) END AS confidence FROM v_fields""", "v_fields")
def _(spark, d):
    return v.fields(spark, d).select(
        "record_id", "field_name", responses.confidence_from_text((F.col("confidence") * 2 - 0.5).cast("string")).alias("confidence"))


@check("n8_strip_fences", r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM documents""")
def _(spark, d):
    body = F.col("text")
    fenced = F.when(F.col("doc_id") % 3 == 0, body).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` \n"))).otherwise(F.concat(F.lit("```\n"), body))
    return v.table(spark, d, "documents").select("doc_id", F.md5(responses.strip_fences(fenced)).alias("body"))


@check("n9_parse_envelope", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'PROVIDER_BAD_RESPONSE' END AS error_code, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def _(spark, d):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit('{"fields":'), F.col("props"), F.lit("}"))).when(n % 6 == 1, F.col("props")).when(
        n % 6 == 4, '{"fields":[1]}').otherwise("{no json")
    return v.table(spark, d, "events").select("event_id", responses.parse_envelope(raw).alias("p")).select(
        "event_id", "p.error_code", F.try_variant_get("p.fields", "$.k", "string").alias("k"))


def raw_responses(spark, d):
    """Response texts for records: JSON, sometimes fenced, sometimes broken."""
    r = v.records(spark, d)
    k = F.col("record_id").cast("long")
    entry = F.map_from_arrays(
        F.array(*[F.lit(n) for n in (*FIELD_NAMES, "unknown_field")]),
        F.array(*[F.struct(F.col(n).alias("value"), F.lit(0.9).alias("confidence")) for n in FIELD_NAMES],
                F.struct(F.lit("x").alias("value"), F.lit(0.1).alias("confidence"))))
    body = F.to_json(F.struct(entry.alias("fields")), {"ignoreNullFields": "false"})
    text = F.when(k % 53 == 0, "sorry, no answer").when(k % 10 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return r.select(
        F.concat(F.lit("J"), F.col("record_id")).alias("job_id"), "document_id", F.lit("u1").alias("user_id"), text.alias("raw_text"),
        F.lit("p1").alias("provider"), F.lit("m1").alias("model"), F.lit("v1").alias("prompt_version"), F.lit("v1").alias("schema_version"))


_MAPPED = ", ".join(f"CASE WHEN k % 53 <> 0 THEN nullif(trim({n}), '') END AS {n}" for n in FIELD_NAMES)


@check("n10_parse_model_responses", f"""
SELECT document_id, k % 53 = 0 AS failed, CASE WHEN k % 53 = 0 THEN 'PROVIDER_BAD_RESPONSE' END AS error_code, CASE WHEN k % 53 <> 0 THEN 14 ELSE -1 END AS known, {_MAPPED} FROM v_records""",
       "v_records")
def _(spark, d):
    out = responses.parse_model_responses(raw_responses(spark, d))
    return process.values_to_columns(out).select("document_id", "failed", "error_code", F.coalesce(F.size("fields"), F.lit(-1)).alias("known"), *FIELD_NAMES)


@check("n53_response_text", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a' || k || 'b' WHEN event_id % 4 = 1 THEN 'answer ' || k END AS text,
  CASE WHEN event_id % 4 > 1 THEN 'PROVIDER_BAD_RESPONSE' END AS error_code FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def _(spark, d):
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    parts = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"a'), k, F.lit('"},{"other":1},{"text":"b"}]}}]}'))
    choice = F.concat(F.lit('{"choices":[{"message":{"content":"```\\nanswer '), k, F.lit('\\n```"}}]}'))
    raw = F.when(n % 4 == 0, parts).when(n % 4 == 1, choice).when(n % 4 == 2, '{"choices":[{"message":{"content":7}}]}').otherwise("oops")
    text = F.when(n % 4 == 0, responses.response_text(raw, "candidates")).otherwise(responses.response_text(raw, "choices"))
    return v.table(spark, d, "events").select("event_id", text.alias("t")).select("event_id", "t.*")


_CODES = [200, 429, 401, 403, 400, 500, 404, 200]


@check("n54_classify_status", f"""
SELECT event_id, CASE WHEN s = 200 AND event_id % 16 = 7 THEN 'PROVIDER_RATE_LIMITED' WHEN s = 200 THEN NULL WHEN s = 429 THEN 'PROVIDER_RATE_LIMITED' WHEN s IN (401, 403) THEN 'PROVIDER_AUTH_ERROR'
  WHEN s = 400 THEN 'PROVIDER_BAD_REQUEST' ELSE 'PROVIDER_UNAVAILABLE' END AS code FROM (SELECT event_id, {_CODES}[event_id % 8 + 1] AS s FROM events)""")
def _(spark, d):
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (n % 8 + 1).cast("int"))
    body = F.when(n % 16 == 7, '{"error":{"code":429}}').when(n % 16 == 15, '{"error":{"code":429},"choices":[]}').otherwise(F.col("props"))
    return v.table(spark, d, "events").select("event_id", responses.classify_status(status, responses.embedded_error_code(body)).alias("code"))


@check("n39_is_transient", """
SELECT error_code, error_code = 'PROVIDER_TIMEOUT' AS transient, count(*) AS n FROM v_jobs WHERE error_code IS NOT NULL GROUP BY 1, 2""", "v_jobs")
def _(spark, d):
    j = v.jobs(spark, d).filter("error_code is not null")
    return j.groupBy("error_code", responses.is_transient(F.col("error_code")).alias("transient")).agg(F.count("*").alias("n"))


@check("n41_route_statistics", """
SELECT provider, model, outcome, count(*) AS routes, CAST(sum(attempts) AS BIGINT) AS attempts FROM (
SELECT 'p1' AS provider, 'm1' AS model, status AS outcome, n % 3 AS attempts FROM v_jobs
UNION ALL SELECT 'p2', 'm' || CAST(n % 2 AS VARCHAR), 'ok', 1 FROM v_jobs WHERE status = 'FAILED') GROUP BY 1, 2, 3""", "v_jobs")
def _(spark, d):
    n = F.col("id").cast("long")
    first = F.struct(F.lit("p1").alias("provider"), F.lit("m1").alias("model"), F.col("status").alias("outcome"), (n % 3).alias("attempts"))
    second = F.struct(F.lit("p2").alias("provider"), F.concat(F.lit("m"), (n % 2).cast("string")).alias("model"), F.lit("ok").alias("outcome"), F.lit(1).cast("long").alias("attempts"))
    routes = F.array_compact(F.array(first, F.when(F.col("status") == "FAILED", second)))
    return responses.route_statistics(v.jobs(spark, d).select(routes.alias("attempted_routes")))


@check("n42_prompt_text", """
SELECT doc_id, md5('Read this.' || chr(10) || 'Document type: ' || source || chr(10) || CASE WHEN lang <> 'de' THEN 'Language/script: ' || lang || chr(10) ELSE '' END || '<<<' || chr(10) || text || chr(10) || '>>>') AS prompt FROM documents""")
def _(spark, d):
    lang = F.when(F.col("lang") != "de", F.col("lang"))
    return v.table(spark, d, "documents").select(
        "doc_id", F.md5(responses.prompt_text(F.col("text"), "Read this.", F.col("source"), lang)).alias("prompt"))


@check("n16_cache_key", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'checksum:c' || CAST(doc_id AS VARCHAR) ELSE 'text-sha256:' || sha256(text) END AS source,
  sha256(CASE WHEN doc_id % 2 = 0 THEN 'checksum:c' || CAST(doc_id AS VARCHAR) ELSE 'text-sha256:' || sha256(text) END || '|v1|' || lang || '|v1|v1') AS key FROM documents""")
def _(spark, d):
    checksum = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" c"), F.col("doc_id").cast("string"))).otherwise(" ")
    source = responses.source_key(checksum, F.col("text"))
    one = F.lit("v1")
    return v.table(spark, d, "documents").select(
        "doc_id", source.alias("source"), responses.cache_key(source, one, F.col("lang"), one, one).alias("key"))


# Files --------------------------------------------------------------------------------------------------------------

@check("n17_sanitize_filename", "SELECT path, file_name FROM f_files", "f_files")
def _(spark, d):
    return v.files(spark, d).select("path", files.sanitize_filename(F.col("filename")).alias("file_name"))


@check("n18_resolve_mime", "SELECT path, CASE WHEN mime_error IS NULL THEN any_mime END AS mime, mime_error AS error_code FROM m_files", "m_files")
def _(spark, d):
    name = files.sanitize_filename(F.col("filename"))
    return v.files(spark, d).select("path", files.resolve_mime(name, F.col("declared_mime")).alias("m")).select("path", "m.*")


@check("n18_upload_check", """
SELECT path, CASE WHEN expected IS NULL THEN 'UNSUPPORTED_FILE_TYPE' WHEN coalesce(declared, '') <> '' AND declared <> expected THEN 'FILE_TYPE_MISMATCH' WHEN length > 20000 THEN 'FILE_TOO_LARGE' END AS code
FROM (SELECT *, CASE lower(split_part(filename, '.', -1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
  WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' END AS expected, octet_length(encode(body)) AS length FROM v_files)""", "v_files")
def _(spark, d):
    return v.files(spark, d).select("path", files.upload_check(F.col("filename"), F.col("length"), F.col("declared_mime"), 20000).alias("code"))


@check("n19_content_matches", "SELECT path, left(body, 5) = '%PDF-' AS pdf FROM v_files", "v_files")
def _(spark, d):
    return v.files(spark, d).select("path", files.content_matches(F.col("content"), F.lit("application/pdf")).alias("pdf"))


@check("n20_size_error", "SELECT path, CASE WHEN length <= 0 THEN 'EMPTY_FILE' WHEN length > 9000 THEN 'FILE_TOO_LARGE' END AS code FROM f_files", "f_files")
def _(spark, d):
    return v.files(spark, d).select("path", files.size_error(F.col("length"), 9000).alias("code"))


@check("n21_stored_path", "SELECT page_id, page_id % 3 = 0 AS stored FROM pages")
def _(spark, d):
    digest = F.md5("url")
    path = F.concat(F.when(F.col("page_id") % 3 == 1, F.lit("/")).otherwise(F.lit("")), F.lit("documents/"), digest, F.lit("/"), digest,
                    F.when(F.col("page_id") % 3 == 2, F.lit(".exe")).otherwise(F.lit(".pdf")))
    return v.table(spark, d, "pages").select("page_id", files.is_stored_path(path).alias("stored"))


# Scripts ------------------------------------------------------------------------------------------------------------

_LATIN = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@check("n22_count_scripts", f"SELECT doc_id, {_LATIN} AS latin, length(text) AS devanagari, 0 AS gujarati FROM documents")
def _(spark, d):
    # Every character also appears once as a Devanagari letter.
    local = F.concat("text", F.repeat(F.lit("क"), F.length("text")))
    return v.table(spark, d, "documents").select("doc_id", scripts.count_scripts(local).alias("c")).select(
        "doc_id", *[F.col(f"c.{n}").cast("bigint").alias(n) for n in ("latin", "devanagari", "gujarati")])


@check("n23_language_config", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 AND latin > 0 THEN 'eng' WHEN doc_id % 4 = 2 THEN NULL
  WHEN doc_id % 4 = 0 AND 10.0 / (latin + 10) >= 0.06 THEN CASE WHEN latin * 1.0 / (latin + 10) >= 0.06 THEN 'hin+eng' ELSE 'hin' END
  WHEN doc_id % 4 = 1 THEN CASE WHEN latin * 1.0 / (latin + len * 2) >= 0.06 THEN 'guj+eng' ELSE 'guj' END ELSE 'eng' END AS language
FROM (SELECT doc_id, {_LATIN} AS latin, length(text) AS len FROM documents)""")
def _(spark, d):
    k = F.col("doc_id") % 4
    local = F.when(k == 0, F.concat("text", F.repeat(F.lit("क"), F.lit(10)))).when(
        k == 1, F.concat("text", F.repeat(F.lit("ગ"), F.length("text") * 2))).when(k == 2, F.col("text")).otherwise("12 345 -")
    return v.table(spark, d, "documents").select("doc_id", scripts.language_config(scripts.count_scripts(local)).alias("language"))


@check("n24_normalize_declared", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'hin+eng' WHEN 'fr' THEN 'guj+eng' END AS declared FROM documents")
def _(spark, d):
    said = F.when(F.col("lang") == "de", " Hindi ").when(F.col("lang") == "fr", "GU").otherwise(F.col("lang"))
    return v.table(spark, d, "documents").select("doc_id", scripts.normalize_declared(said).alias("declared"))


@check("n25_detect_language", f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'guj+eng' WHEN doc_id % 5 = 1 AND lang = 'en' THEN 'eng' WHEN doc_id % 5 = 1 THEN 'eng' ELSE 'eng' END AS language,
  CASE WHEN doc_id % 5 = 0 THEN 'osd' WHEN doc_id % 5 = 1 OR latin = 0 THEN CASE WHEN lang = 'en' THEN 'declared' ELSE 'default' END ELSE 'codepoints' END AS source
FROM (SELECT *, {_LATIN} AS latin FROM documents)""")
def _(spark, d):
    text = F.when(F.col("doc_id") % 5 == 1, F.lit("123")).otherwise(F.col("text"))
    sure = F.when(F.col("doc_id") % 5 == 0, 3.0).otherwise(2.9)
    return v.table(spark, d, "documents").select(
        "doc_id", scripts.detect_language(text, F.col("lang"), F.lit("Gujarati"), sure).alias("x")).select("doc_id", "x.*")


# Text distance ------------------------------------------------------------------------------------------------------

@check("n26_edit_distance", "SELECT id, length(ref) - length(hyp) + length(hyp) - length(replace(hyp, '§', '')) AS distance FROM v_pairs", "v_pairs")
def _(spark, d):
    return v.text_pairs(spark, d).select(
        "id", distance.edit_distance(F.col("ref"), F.col("hypothesis")).cast("bigint").alias("distance"))


_HURT = "len(list_filter(string_split(hyp, ' '), lambda w: contains(w, '§')))"
_WORD_DISTANCE = f"len(string_split(ref, ' ')) - len(string_split(hyp, ' ')) + {_HURT}"


@check("n27_word_distance", f"SELECT id, {_WORD_DISTANCE} AS distance FROM v_pairs", "v_pairs")
def _(spark, d):
    return v.text_pairs(spark, d).select(
        "id", distance.word_distance(F.col("ref"), F.col("hypothesis")).cast("bigint").alias("distance"))


_RATES = f"""SELECT id, lang, (length(ref) - length(hyp) + length(hyp) - length(replace(hyp, '§', ''))) / length(ref) AS cer,
  ({_WORD_DISTANCE}) / len(string_split(ref, ' ')) AS wer, n_chars / 1000.0 AS seconds, n_chars % 17 = 0 AS failed FROM v_pairs"""


def _rated(spark, d):
    pairs = v.text_pairs(spark, d).withColumns({"seconds": F.col("n_chars") / 1000.0, "failed": F.col("n_chars") % 17 == 0})
    return distance.with_error_rates(pairs)


@check("n28_error_rates", f"SELECT id, cer, wer FROM ({_RATES})", "v_pairs")
def _(spark, d):
    return _rated(spark, d).select("id", "cer", "wer")


@check("n26_benchmark_pairs", """SELECT item_id, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', '')) AS INTEGER) AS blanks_lost FROM benchmark""")
def _(spark, d):
    b = v.table(spark, d, "benchmark")
    ref = compare_key(F.col("text"))
    return b.select("item_id", distance.edit_distance(ref, F.replace(ref, F.lit(" "), F.lit(""))).alias("blanks_lost"))


@check("a14_ocr_summary", f"""
SELECT count(*) AS documents, count(*) FILTER (failed) AS failures, round(avg(cer) FILTER (NOT failed), 9) AS mean_cer, round(avg(wer) FILTER (NOT failed), 9) AS mean_wer, round(sum(seconds), 6) AS total_seconds FROM ({_RATES})""", "v_pairs")
def _(spark, d):
    out = ev.ocr_summary(_rated(spark, d))
    return out.withColumns({"mean_cer": F.round("mean_cer", 9), "mean_wer": F.round("mean_wer", 9), "total_seconds": F.round("total_seconds", 6)})


_PHASES = f"""SELECT id, CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS family, 'before' AS phase, cer, wer, seconds FROM ({_RATES})
UNION ALL SELECT id, CASE WHEN lang = 'en' THEN 'english' ELSE lang END, 'after', 0.0, 0.0, seconds * 2 FROM ({_RATES})"""


def _configs(spark, d):
    pairs = v.text_pairs(spark, d)
    family = F.when(F.col("lang") == "en", "english").otherwise(F.col("lang"))
    truth = pairs.select("id", F.col("reference").alias("text"), family.alias("family"))
    seconds = F.col("n_chars") / 1000.0
    before = pairs.select("id", F.col("hypothesis").alias("text"), seconds.alias("seconds"))
    after = pairs.select("id", F.col("reference").alias("text"), (seconds * 2).alias("seconds"))
    return evaluate.compare_configs(truth, before, after)


@check("j15_compare_phases", f"""
SELECT id, family, max(cer) FILTER (phase = 'before') AS cer_before, max(wer) FILTER (phase = 'before') AS wer_before, max(seconds) FILTER (phase = 'before') AS seconds_before,
  max(cer) FILTER (phase = 'after') AS cer_after, max(wer) FILTER (phase = 'after') AS wer_after, max(seconds) FILTER (phase = 'after') AS seconds_after FROM ({_PHASES}) GROUP BY 1, 2""", "v_pairs")
def _(spark, d):
    return _configs(spark, d)[0]


@check("a15_phase_means", f"""
SELECT phase, coalesce(g, 'all') AS script_group, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, round(avg(seconds), 6) AS mean_seconds, count(*) AS documents
FROM (SELECT *, CASE WHEN family = 'english' THEN family ELSE 'other' END AS g FROM ({_PHASES})) GROUP BY GROUPING SETS ((phase, g), (phase))""", "v_pairs")
def _(spark, d):
    return _configs(spark, d)[1].withColumns({c: F.round(c, n) for c, n in {"mean_cer": 9, "mean_wer": 9, "mean_seconds": 6}.items()})


# Field verdicts -----------------------------------------------------------------------------------------------------

_NAMES = ("owner_name", "survey_number", "area", "village", "tehsil", "record_date")


def _truth_pairs(spark, d):
    """Expected and extracted values with every kind of difference."""
    n = v.normalized(spark, d)
    long = joins.to_long(n, "record_id", _NAMES).withColumnRenamed("value", "expected")
    k = F.col("record_id").cast("long")
    got = (
        F.when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, F.upper("expected")).when(k % 7 == 3, F.concat("expected", F.lit("0")))
        .when(k % 7 == 4, F.concat(F.lit("zzzz"), F.substring("expected", 1, 1)))
        # One character in the middle is wrong, so the ratio is (length - 1) / length.
        .when((k % 7 == 6) & (F.length("expected") >= 3), F.overlay("expected", F.lit("§"), F.floor(F.length("expected") / 2).cast("int") + 1)).otherwise(F.col("expected"))
    )
    filled = F.when(F.col("expected").isNull() & (k % 7 == 5), F.lit("made up")).otherwise(got)
    return long.select(F.col("record_id").alias("id"), "field_name", "expected", filled.alias("got"))


_PAIRS = "(" + "\nUNION ALL\n".join(f"SELECT record_id AS id, k, '{n}' AS field_name, {n} AS expected FROM n_records" for n in _NAMES) + ")"
_GOT = f"""(SELECT *, CASE WHEN expected IS NULL AND k % 7 = 5 THEN 'made up' WHEN k % 7 = 1 THEN NULL WHEN k % 7 = 2 THEN upper(expected) WHEN k % 7 = 3 THEN expected || '0'
  WHEN k % 7 = 4 THEN 'zzzz' || substr(expected, 1, 1)
  WHEN k % 7 = 6 AND length(expected) >= 3 THEN left(expected, length(expected) // 2) || '§' || substr(expected, length(expected) // 2 + 2) ELSE expected END AS got FROM {_PAIRS})"""
# The share of equal characters of the damaged copies is known here, so plain SQL can tell the verdicts.
_VERDICTS = f"""(SELECT id, field_name, CASE WHEN expected IS NULL AND got IS NULL THEN 'CORRECT' WHEN expected IS NULL THEN 'HALLUCINATED' WHEN got IS NULL THEN 'MISSING'
  WHEN field_name = 'area' AND abs(TRY_CAST(expected AS DOUBLE) - TRY_CAST(got AS DOUBLE)) < 1e-9 THEN 'CORRECT' WHEN lower(trim(expected)) = lower(trim(got)) THEN 'CORRECT'
  WHEN field_name IN ('survey_number', 'record_date') THEN 'INCORRECT'
  WHEN trim(expected) <> '' AND trim(got) <> '' AND (contains(lower(got), lower(expected)) OR contains(lower(expected), lower(got))) THEN 'PARTIALLY_CORRECT'
  WHEN contains(got, '§') AND (length(expected) - 1) / length(expected) >= 0.8 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS verdict FROM {_GOT})"""


@check("n29_numbers_equal", "SELECT id, field_name, coalesce(abs(TRY_CAST(expected AS DOUBLE) - TRY_CAST(got AS DOUBLE)) < 1e-9, false) AS same FROM "
       f"(SELECT id, field_name, expected, coalesce(got, 'x') AS got FROM {_GOT})", "n_records")
def _(spark, d):
    return _truth_pairs(spark, d).select("id", "field_name", distance.numbers_equal(F.col("expected"), F.coalesce("got", F.lit("x"))).alias("same"))


@check("n31_classify_fields", f"SELECT id, field_name, verdict FROM {_VERDICTS}", "n_records")
def _(spark, d):
    return distance.classify_fields(_truth_pairs(spark, d)).select("id", "field_name", "verdict")


@check("n30_similarity", f"""SELECT id, field_name, CASE WHEN coalesce(length(expected), 0) = 0 THEN 0.0 ELSE (length(expected) - 1) / length(expected) END AS ratio FROM {_GOT}""", "n_records")
def _(spark, d):
    # Every value against itself with one wrong character in the middle.
    key = compare_key(F.col("expected"))
    half = F.floor(F.length(key) / 2).cast("int")
    wrong = F.concat(F.left(key, half), F.lit("§"), F.substring(key, half + 2, F.length(key)))
    return _truth_pairs(spark, d).select("id", "field_name", distance.similarity(key, wrong).alias("ratio"))


def reversed_ratios(spark, d):
    """(conv_id, turn, ratio) for every row of conversations: its text against the reverse. No SQL has this ratio; a test computes it by brute force."""
    text = compare_key(F.col("text"))
    return v.table(spark, d, "conversations").select("conv_id", "turn", distance.similarity(text, F.reverse(text)).alias("ratio"))


# Every row of conversations, whole texts, against itself with something appended: all of the text matches.
@check("n30_similarity_appended", """SELECT conv_id, turn, 2 * n / (2 * n + 7) AS ratio
  FROM (SELECT conv_id, turn, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS n FROM conversations)""")
def _(spark, d):
    text = compare_key(F.col("text"))
    return v.table(spark, d, "conversations").select("conv_id", "turn", distance.similarity(text, F.concat(text, F.lit(" § more"))).alias("ratio"))


@check("a8_evaluate_documents", f"""
SELECT id, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'INCORRECT') AS incorrect, count(*) FILTER (verdict = 'MISSING') AS missing,
  count(*) FILTER (verdict = 'HALLUCINATED') AS hallucinated, count(*) FILTER (verdict = 'PARTIALLY_CORRECT') AS partially_correct, count(*) AS fields,
  round(count(*) FILTER (verdict = 'CORRECT') / count(*), 4) AS accuracy FROM {_VERDICTS} GROUP BY id""", "n_records")
def _(spark, d):
    return ev.evaluate_documents(distance.classify_fields(_truth_pairs(spark, d)))


@check("a10_field_accuracy", f"""
SELECT field_name, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) AS total, round(count(*) FILTER (verdict = 'CORRECT') / count(*), 4) AS accuracy FROM {_VERDICTS} GROUP BY 1""", "n_records")
def _(spark, d):
    return ev.field_accuracy(distance.classify_fields(_truth_pairs(spark, d)))


@check("x4_precision_recall", f"""
SELECT field_name, c / (c + h + i) AS precision, c / (c + m + i) AS recall, 2 * c / (2 * c + h + m + 2 * i) AS f1 FROM (SELECT field_name, CAST(count(*) FILTER (verdict = 'CORRECT') AS DOUBLE) AS c,
  count(*) FILTER (verdict = 'HALLUCINATED') AS h, count(*) FILTER (verdict = 'INCORRECT') AS i, count(*) FILTER (verdict = 'MISSING') AS m FROM {_VERDICTS} GROUP BY 1)""", "n_records")
def _(spark, d):
    return agg.field_precision_recall(distance.classify_fields(_truth_pairs(spark, d)))


def _evaluation(spark, d):
    n = v.normalized(spark, d)
    manifest = n.select(F.col("record_id").alias("id"))
    truth = n.select(F.col("record_id").alias("id"), "owner_name", "survey_number", "area", "village", "tehsil", "district", "record_date")
    outputs = v.outputs(spark, d)
    k = F.col("id").cast("long")
    # Every ninth extraction lost the village, every eleventh document has no output.
    outputs = outputs.withColumn("values", F.when(k % 9 == 0, F.map_filter("values", lambda n, _: n != "village")).otherwise(F.col("values")))
    return evaluate.evaluate_extraction(manifest, truth, outputs.filter(k % 11 != 0))


@check("a9_evaluation_summary", """
SELECT count(*) AS documents, count(*) FILTER (bad) AS failures, avg(CASE WHEN NOT bad THEN round((7 - lost) / 7, 4) END) AS mean_accuracy,
  CAST(sum(CASE WHEN NOT bad THEN 7 - lost END) AS BIGINT) AS correct, CAST(0 AS BIGINT) AS incorrect, CAST(sum(CASE WHEN NOT bad THEN lost END) AS BIGINT) AS missing,
  CAST(0 AS BIGINT) AS hallucinated, CAST(0 AS BIGINT) AS partially_correct
FROM (SELECT failed OR k % 11 = 0 AS bad, CASE WHEN k % 9 = 0 AND village IS NOT NULL THEN 1 ELSE 0 END AS lost FROM v_outputs)""", "v_outputs")
def _(spark, d):
    return _evaluation(spark, d)["summary"]


@check("p4_evaluate_extraction", """
SELECT id, failed OR k % 11 = 0 AS failed, CASE WHEN k % 11 = 0 THEN 'NO_OUTPUT' WHEN failed THEN 'PROVIDER_TIMEOUT' END AS error_code,
  CASE WHEN NOT (failed OR k % 11 = 0) THEN round((7 - CASE WHEN k % 9 = 0 AND village IS NOT NULL THEN 1 ELSE 0 END) / 7, 4) END AS accuracy FROM v_outputs""", "v_outputs")
def _(spark, d):
    return _evaluation(spark, d)["results"].select("id", "failed", "error_code", "accuracy")


# Recognised text ----------------------------------------------------------------------------------------------------

@check("a16_words_to_lines", "SELECT document_id, CAST(line_num AS INTEGER) AS line_num, text, round(confidence, 9) AS confidence, x1, y1, x2, y2 FROM w_lines", "w_lines")
def _(spark, d):
    box = F.col("box")
    return ocr.words_to_lines(v.words(spark, d)).select(
        "document_id", "line_num", "text", F.round("confidence", 9).alias("confidence"),
        box[0].alias("x1"), box[1].alias("y1"), box[2].alias("x2"), box[3].alias("y2"))


@check("a17_assemble_pages", """
SELECT document_id, 1 AS page_number, string_agg(text, chr(10) ORDER BY line_num) AS text, round(avg(confidence), 9) AS confidence, count(*) AS lines FROM w_lines GROUP BY 1""", "w_lines")
def _(spark, d):
    return ocr.assemble_pages(ocr.words_to_lines(v.words(spark, d))).withColumn("confidence", F.round("confidence", 9))


@check("a17_assemble_text", """
SELECT document_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS pages FROM v_lines GROUP BY 1""", "v_lines")
def _(spark, d):
    return ocr.assemble_text(v.lines(spark, d).select("document_id", F.col("turn").alias("page_number"), "text"))


@check("t6_best_line", "SELECT document_id, max(confidence) FILTER (confidence BETWEEN 0 AND 1) AS confidence FROM v_lines GROUP BY 1", "v_lines")
def _(spark, d):
    return ocr.best_line(v.lines(spark, d))


# Confidence ---------------------------------------------------------------------------------------------------------

_TARGETS = [("owner_name", "the "), ("village", "tion"), ("tehsil", "hein it"), ("district", "no such words"), ("area", "   ")]


def _paged(spark, d):
    line = F.struct("turn", "text", "confidence")
    one = v.lines(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    shaped = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), F.lit(None).cast("array<double>").alias("box")))
    page = F.struct(F.lit(1).alias("page_number"), F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence"), shaped.alias("lines"),
                    F.lit(1).alias("width"), F.lit(1).alias("height"))
    return one.select("document_id", F.array(page).alias("pages"))


_TARGET_ROWS = ", ".join(f"('{n}', '{t}')" for n, t in _TARGETS)
_BEST = f"""SELECT d.document_id, t.name, max(l.confidence) AS ocr FROM (SELECT DISTINCT document_id FROM v_lines) d CROSS JOIN (VALUES {_TARGET_ROWS}) t(name, value)
LEFT JOIN v_lines l ON l.document_id = d.document_id AND trim(t.value) <> '' AND l.confidence BETWEEN 0 AND 1
  AND contains(trim(regexp_replace(lower(l.text), '\\s+', ' ', 'g')), trim(t.value)) GROUP BY 1, 2"""


@check("n32_match_ocr_confidence", f"SELECT document_id, name, ocr FROM ({_BEST})", "v_lines")
def _(spark, d):
    lines = ocr.page_lines(F.col("pages"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), conf.best_line_confidence(F.lit(t), lines).alias("ocr")) for n, t in _TARGETS])
    return _paged(spark, d).select("document_id", F.inline(pairs))


_SCORED_SQL = f"""SELECT document_id, name, value, ocr, ext, blocking, acting, CASE WHEN value IS NULL THEN NULL WHEN base IS NULL THEN NULL WHEN blocking THEN least(base, 0.39) WHEN acting THEN least(base, 0.69) ELSE base END AS score
FROM (SELECT *, CASE WHEN ocr IS NULL THEN ext WHEN ext IS NULL THEN ocr ELSE (ocr + ext) / 2 END AS base FROM
(SELECT b.document_id, b.name, t.value, b.ocr, CASE WHEN CAST(b.document_id AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(b.document_id AS BIGINT) % 10 / 10.0 END AS ext,
  b.name = 'village' AND CAST(b.document_id AS BIGINT) % 4 = 0 AS blocking, (b.name = 'village' AND CAST(b.document_id AS BIGINT) % 4 = 0) OR (b.name = 'owner_name' AND CAST(b.document_id AS BIGINT) % 4 = 1) AS acting
FROM ({_BEST}) b JOIN (VALUES {_TARGET_ROWS}) t(name, value) ON t.name = b.name))"""


def _scored(spark, d):
    pages = _paged(spark, d)
    k = F.col("document_id").cast("long")
    names = F.array(*[F.lit(n) for n, _ in _TARGETS])
    ext = F.when(k % 3 != 0, k % 10 / 10.0)
    field = F.struct(F.lit(None).cast("string").alias("value"), ext.alias("confidence"), F.lit("EXTRACTED").alias("status"))
    outputs = pages.select(
        F.col("document_id").alias("id"), F.lit(False).alias("failed"), F.map_from_arrays(names, F.array(*[F.lit(t) for _, t in _TARGETS])).alias("values"),
        F.map_from_arrays(names, F.array(*[field] * len(_TARGETS))).alias("fields"))

    def issue(rule, name, status, severity):
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(name).cast("string").alias("field_name"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit("why").alias("message"))

    issues = pages.select(F.col("document_id").alias("id"), F.array_compact(F.array(
        F.when(k % 4 == 0, issue("R1", "village", "FAIL", "ERROR")), F.when(k % 4 == 1, issue("R2", "owner_name", "REVIEW_REQUIRED", "WARNING")),
        F.when(k % 8 == 2, issue("R3", None, "REVIEW_REQUIRED", "WARNING")), issue("R4", None, "NOT_CHECKED", "INFO"))).alias("issues"))
    return process.score_outputs(outputs, pages, issues)


_BANDS = "CASE WHEN score IS NULL THEN 'REVIEW_REQUIRED' WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"


@check("n33_score_field", f"SELECT document_id AS id, name AS field_name, score, {_BANDS} AS band, ocr AS ocr_confidence, ext AS extraction_confidence FROM ({_SCORED_SQL})", "v_lines")
def _(spark, d):
    return process.scored_fields(_scored(spark, d)).select("id", "field_name", "score", "band", "ocr_confidence", "extraction_confidence")


@check("n35_reasons", f"""
SELECT document_id AS id, name AS field_name, score IS NULL OR score < 0.6 OR acting AS review_required, concat_ws(' / ',
  CASE WHEN ocr IS NOT NULL THEN 'line on the page: ' || format('{{:.2f}}', ocr) ELSE 'no line on the page holds the value' END,
  CASE WHEN ext IS NOT NULL THEN 'extraction: ' || format('{{:.2f}}', ext) ELSE 'extraction: not stated' END,
  CASE WHEN blocking THEN 'rule R1 FAIL: why' WHEN acting THEN 'rule R2 REVIEW_REQUIRED: why' END,
  CASE WHEN blocking THEN 'a blocking finding limits the score to 0.39' WHEN acting THEN 'a finding limits the score to 0.69' END,
  CASE WHEN acting AND score >= 0.6 THEN 'a finding asks for a look at the value' END) AS reasons FROM ({_SCORED_SQL})""", "v_lines")
def _(spark, d):
    return process.scored_fields(_scored(spark, d)).select("id", "field_name", "review_required", F.array_join("reasons", " / ").alias("reasons"))


@check("p3_score_outputs", f"""
SELECT id, overall_score, CASE WHEN overall_score IS NULL THEN 'REVIEW_REQUIRED' WHEN overall_score >= 0.8 THEN 'HIGH' WHEN overall_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS overall_band,
  review OR CAST(id AS BIGINT) % 8 = 2 AS review_required, concat_ws(' / ', CASE WHEN CAST(id AS BIGINT) % 8 = 2 THEN '1 finding(s) on the whole record' END,
  CASE WHEN overall_score IS NULL THEN 'no field has a score' END) AS reasons
FROM (SELECT document_id AS id, avg(score) AS overall_score, bool_or(score IS NULL OR score < 0.6 OR acting) AS review FROM ({_SCORED_SQL}) GROUP BY 1)""", "v_lines")
def _(spark, d):
    return _scored(spark, d).select("id", "overall_score", "overall_band", "review_required", F.array_join("reasons", " / ").alias("reasons"))


@check("n34_band", """
SELECT record_id, field_name, CASE WHEN confidence IS NULL THEN 'REVIEW_REQUIRED' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN confidence IS NULL THEN 'REVIEW_REQUIRED' WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS display_band FROM v_fields""", "v_fields")
def _(spark, d):
    c = F.col("confidence")
    return v.fields(spark, d).select("record_id", "field_name", conf.band(c).alias("band"), conf.band(c, conf.DISPLAY_HIGH, conf.DISPLAY_MEDIUM).alias("display_band"))


@check("a7_record_confidence", """
SELECT f.record_id, round(avg(confidence), 9) AS overall_score, bool_or(confidence IS NULL OR confidence < 0.6) OR coalesce(max(r.n), 0) > 0 AS review_required, count(*) AS fields, count(confidence) AS scored, coalesce(max(r.n), 0) AS record_issues
FROM v_fields f LEFT JOIN (SELECT record_id, count(*) AS n FROM v_issues WHERE field_name IS NULL AND (status IN ('FAIL', 'REVIEW_REQUIRED') OR severity IN ('WARNING', 'ERROR', 'CRITICAL')) GROUP BY 1) r USING (record_id) GROUP BY f.record_id""", "v_fields v_issues")
def _(spark, d):
    fields = v.fields(spark, d).withColumn("score", F.col("confidence")).withColumn("review_required", F.col("score").isNull() | (F.col("score") < 0.6))
    return process.record_confidence(fields, v.issues(spark, d)).withColumn("overall_score", F.round("overall_score", 9)).drop("overall_band")


# Errors -------------------------------------------------------------------------------------------------------------

_STATES = ["22008", "23505", "23503", "08006", "XX000", "23514", "57014"]


def _messages(spark, d):
    n = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (n % 7 + 1).cast("int"))
    message = F.when(n % 9 == 8, F.lit("Connection refused by peer")).when(n % 9 == 7, F.lit("PGRST103 no rows")).otherwise(
        F.concat(F.lit("ERROR:  "), state, F.lit(": value "), n.cast("string")))
    return v.table(spark, d, "events").select("event_id", message.alias("message"))


_STATE_SQL = f"""(SELECT event_id, CASE WHEN event_id % 9 < 7 AND event_id % 7 <> 4 THEN {_STATES}[event_id % 7 + 1] END AS state, event_id % 9 = 8 AS refused, event_id % 9 = 7 AS pg, CAST(event_id AS VARCHAR) AS t FROM events)"""


@check("n37_extract_codes", f"""
SELECT event_id, CASE WHEN state IS NULL AND NOT refused AND NOT pg AND regexp_matches(t, '^\\d{{5}}$') THEN t ELSE state END AS sqlstate, CASE WHEN pg THEN 'PGRST103' END AS provider_code FROM {_STATE_SQL}""")
def _(spark, d):
    m = F.col("message")
    return _messages(spark, d).select("event_id", labels.extract_sqlstate(m).alias("sqlstate"), labels.extract_provider_code(m).alias("provider_code"))


@check("n38_classify_error", f"""
SELECT event_id, CASE WHEN state IN ('22008', '23514') THEN 422 WHEN state IN ('23505', '23503') THEN 409 WHEN state IN ('08006', '57014') OR refused THEN 503 ELSE 500 END AS http_status,
  CASE WHEN state IN ('22008', '23514') THEN 'INVALID_FIELD_VALUE' WHEN state = '23505' THEN 'ALREADY_EXISTS' WHEN state = '23503' THEN 'REFERENCE_CONFLICT'
  WHEN state IN ('08006', '57014') OR refused THEN 'DATABASE_UNAVAILABLE' ELSE 'PERSISTENCE_FAILED' END AS code FROM {_STATE_SQL}""")
def _(spark, d):
    # The number in the message is not a state, so the state is taken from the fixed position here.
    m = F.col("message")
    state = labels.extract_sqlstate(F.regexp_extract(m, r"^ERROR:  (\S+):", 1))
    return _messages(spark, d).select("event_id", labels.classify_error(state, m).alias("e")).select("event_id", "e.*")
