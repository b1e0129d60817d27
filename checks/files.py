"""Readers and sinks over files: the given tables are written in the file form to the shared folder and read back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recordlake.operators.ocr import flatten_lines
from recordlake.schemas import FIELD_NAMES
from recordlake.sources import readers, sinks

from . import views as v
from .changes import scratch
from .registry import check

PER_FILE = 500


def _write(df, path: str, key: str, whole: str | None = None) -> None:
    """JSON files of about PER_FILE rows each: arrays of objects, or with ``whole`` one object that holds the rows under that name.

    They lie side by side in ``path``: a folder of its own for each would have to be made, moved and listed by the driver.
    """
    bucket = (F.xxhash64(key) % F.lit(1 << 20)).alias("h")
    n = max(1, -(-df.count() // PER_FILE))
    rows = df.select(F.pmod(bucket, F.lit(n)).alias("file"), F.struct(*df.columns).alias("row")).groupBy("file").agg(F.collect_list("row").alias("rows"))
    body = F.to_json("rows") if whole is None else F.to_json(F.struct(F.lit("v1").alias("version"), F.col("rows").alias(whole)))
    rows.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@check("s1_read_manifest", "SELECT 'v1' AS version, record_id AS id, record_id || '.pdf' AS file, district AS language, [land_classification] AS attributes FROM v_records", "v_records")
def _(spark, d):
    path, r = scratch(spark, "manifest"), v.records(spark, d)
    _write(r.select(F.col("record_id").alias("id"), F.concat("record_id", F.lit(".pdf")).alias("file"), F.col("district").alias("language"),
                    F.array("land_classification").alias("attributes")), path, "id", "documents")
    return readers.read_manifest(spark, path).select("version", "id", "file", "language", "attributes")


@check("s2_read_ocr", """
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS line_index, md5(text) AS digest, confidence FROM v_lines""", "v_lines")
def _(spark, d):
    path = scratch(spark, "ocr")
    one = v.lines(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "confidence"))).alias("l"))
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))).alias("lines")))
    _write(one.select("document_id", F.lit("e").alias("engine"), pages.alias("pages")), path, "document_id")
    return flatten_lines(readers.read_ocr(spark, path)).select("document_id", F.col("line_index").cast("bigint").alias("line_index"), F.md5("text").alias("digest"), "confidence")


@check("s3_read_model_outputs", "SELECT id, failed, CASE WHEN failed THEN 'PROVIDER_TIMEOUT' END AS error_code, model, area, survey_number FROM v_outputs", "v_outputs")
def _(spark, d):
    path = scratch(spark, "outputs")
    _write(v.outputs(spark, d), path, "id")
    return readers.read_model_outputs(spark, path).select("id", "failed", "error_code", "model", F.col("values")["area"].alias("area"), F.col("values")["survey_number"].alias("survey_number"))


@check("s4_read_ground_truth", "SELECT record_id AS id, owner_name, survey_number, area, village, record_date, 'line ' || record_id || chr(10) || 'end' AS text FROM v_records", "v_records")
def _(spark, d):
    records, texts, r = scratch(spark, "truth"), scratch(spark, "truth-text"), v.records(spark, d)
    _write(r.select(F.col("record_id").alias("id"), *FIELD_NAMES), records, "id")
    _write(r.select(F.col("record_id").alias("id"), F.array(F.concat(F.lit("line "), "record_id"), F.lit("end")).alias("lines")), texts, "id")
    text = readers.read_ground_truth(spark, texts).select("id", "text")
    return readers.read_ground_truth(spark, records, "record").select("id", "owner_name", "survey_number", "area", "village", "record_date").join(text, "id")


@check("s11_append_log", "SELECT id, entity_id, action, at_us FROM v_audit", "v_audit")
def _(spark, d):
    path, audit = scratch(spark, "log"), v.audit(spark, d)
    early = F.col("id").cast("long") % 2 == 0
    # Two batches, one after the other.
    sinks.append_log(audit.filter(early), path, ["action"])
    sinks.append_log(audit.filter(~early), path, ["action"])
    return spark.read.schema(audit.schema).parquet(path).select("id", "entity_id", "action", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at_us"))


@check("s14_report_history", "SELECT count(*) AS records, count(*) FILTER (status = 'APPROVED') AS approved, 978307200000000 + 86400000000 AS at_us FROM v_records", "v_records")
def _(spark, d):
    path, r = scratch(spark, "reports"), v.records(spark, d)
    for day, rows in ((2, r), (1, r.filter("status = 'APPROVED'"))):
        report = rows.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "APPROVED").alias("approved"))
        sinks.write_report(report.withColumn("date", F.lit(datetime(2001, 1, day, tzinfo=timezone.utc))), path)
    return sinks.latest_report(spark, path, "records long, approved long, date timestamp").select("records", "approved", F.unix_micros("date").alias("at_us"))
