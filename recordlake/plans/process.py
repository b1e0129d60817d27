"""Whole jobs: processing a batch, checking outputs, scoring confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import confidence as conf
from ..functions.normalize import coerce_typed_columns, normalize_record
from ..functions.responses import parse_model_responses
from ..operators import duplicates, rules
from ..operators.joins import with_missing
from ..operators.ocr import page_lines, pages_text
from ..operators.reference import Reference
from ..operators.state import persist_results, persistence_codes
from ..schemas import FIELD_NAMES, ISSUE
from ..sources.keyed import KeyedTable


def extract_with(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a reader of your own over partitions of ``df``; batches are streamed, never a whole partition at once."""
    return df.mapInPandas(fn, schema)


def values_to_columns(df: DataFrame, values: str = "values") -> DataFrame:
    """Spread a map of field values over the record columns."""
    return df.select("*", *[F.element_at(F.col(values), n).alias(n) for n in FIELD_NAMES])


def stored_once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back, so that later steps do not compute it again or lose it."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepare_batch(ocr: DataFrame, responses: DataFrame, reference: Reference | None, existing: DataFrame | Callable[[DataFrame], DataFrame],
                  stage_path: str, within_batch: bool = True, version: Column | None = None) -> DataFrame:
    """One row per job: parsed, normalised, checked, compared with other records, typed, with its outcome.

    ``ocr`` has (document_id, pages) and, if every job has pages of its own, job_id; ``responses`` has (job_id, document_id, user_id,
    raw_text, provider, model, prompt_version, schema_version), ``existing`` the stored records, whose versions ``version`` orders if
    it holds several of a document; or it is a function that finds the stored records which the checked rows lead to. A response that cannot be read, or a document without text, comes out with ``error_code`` and no
    record. Of several jobs of a document in one batch the one with the largest job_id counts; the others come out as JOB_SUPERSEDED.
    Repeated rows of a job are one job; of several page lists for a document the largest counts.

    The comparison reads the checked rows several times, so they are stored under ``stage_path`` first: responses are
    parsed and checked once, and the plan of the comparison starts from a plain table. Where a level of the reference is large, the
    normalised rows are stored before its lookup as well. The texts of the responses are not among what is stored.
    """
    of = ["job_id", "document_id"] if "job_id" in ocr.columns else ["document_id"]
    pages = ocr.groupBy(*of).agg(F.max("pages").alias("pages"))
    last = Window.partitionBy("document_id").orderBy(F.desc("job_id"))
    jobs = responses.dropDuplicates(["job_id"]).withColumn("_superseded", F.row_number().over(last) > 1)
    parsed = parse_model_responses(jobs)
    joined = parsed.join(pages, of, "left")
    has_text = F.regexp_like(pages_text(F.col("pages")), F.lit(r"(?U)\S"))
    staged = joined.withColumn(
        "error_code",
        F.when(F.col("_superseded"), F.lit("JOB_SUPERSEDED")).when(~F.coalesce(has_text, F.lit(False)), F.lit("OCR_FAILED"))
        .otherwise(F.col("error_code")),
    ).drop("_superseded")
    normal = normalize_record(values_to_columns(staged)).drop("raw_text", "values", "failed")
    if reference is not None and not all(reference.small.values()):
        # The lookup of a large level reads its rows once more, so they are stored before and not parsed again for it.
        normal = stored_once(ocr.sparkSession, normal, f"{stage_path}/normalized")
    rows = stored_once(ocr.sparkSession, rules.validate(normal, reference), f"{stage_path}/checked")
    checked, failed = rows.filter("error_code is null"), rows.filter("error_code is not null")
    known = existing if isinstance(existing, DataFrame) else existing(checked)
    compared = duplicates.find_duplicates_incremental(checked, known, within_batch, version=version)
    judged = duplicates.add_duplicate_issue(compared).withColumn("verdict", rules.record_verdict(F.col("issues")))
    typed = coerce_typed_columns(judged.withColumn("outcome", rules.map_verdict(F.col("verdict"), F.size("issues"))))
    info = F.create_map(*[x for name in ("job_id", "verdict", "provider", "model", "prompt_version", "schema_version")
                          for x in (F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("")))])
    lost = F.when(F.size("dropped") > 0, F.create_map(F.lit("unrepresentable_values"), F.to_json("dropped")))
    good = typed.withColumn("metadata", F.map_concat(info, F.coalesce(lost, F.create_map().cast("map<string,string>"))))
    keep = ["job_id", "document_id", "user_id", "error_code", "pages", "fields", *FIELD_NAMES, "originals", "dropped",
            "issues", "duplicate_key", "match_count", "verdict", "outcome", "metadata"]
    return good.select(*keep).unionByName(failed.select("job_id", "document_id", "user_id", "error_code"), allowMissingColumns=True)


def process_batch(ocr: DataFrame, responses: DataFrame, reference: Reference | None, tables: dict[str, DataFrame],
                  now: datetime, stage_path: str, within_batch: bool = True) -> dict[str, DataFrame]:
    """Process a batch and return new table versions; ``stage_path`` is a folder all executors can reach.

    Failed documents are reported in ``failures`` as (job_id, document_id, user_id, error_code); hand them to
    :func:`recordlake.operators.state.fail_jobs`.
    """
    prepared = prepare_batch(ocr, responses, reference, tables["land_records"], stage_path, within_batch)
    batch = stored_once(ocr.sparkSession, prepared, f"{stage_path}/prepared")
    good = batch.filter("error_code is null")
    # Every table is made out of the judged rows, so they are joined with the tables on file once.
    out = persist_results(good, tables, now, stored_once(ocr.sparkSession, persistence_codes(good, tables), f"{stage_path}/judged"))
    out["failures"] = batch.filter("error_code is not null").select("job_id", "document_id", "user_id", "error_code")
    return out


#: The key that each stored table is laid out by; the audit log is only added to.
TABLE_KEYS = {
    "documents": "id", "processing_jobs": "id", "land_records": "document_id", "ocr_results": "document_id",
    "extracted_fields": "record_id", "validation_results": "record_id", "review_tasks": "land_record_id",
}


def create_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], buckets: int = 256) -> dict[str, KeyedTable]:
    """Write the tables of ``TABLE_KEYS`` laid out by their keys."""
    return {name: KeyedTable(spark, f"{folder}/{name}", key, buckets).create(tables[name]) for name, key in TABLE_KEYS.items()}


def persist_touched(batch: DataFrame, tables: dict[str, KeyedTable], audit_path: str, stage_path: str, now: datetime) -> DataFrame:
    """Store a batch as :func:`persist_results` does, reading and writing only the partitions its keys fall into; returns the outcomes.

    The new rows are written under ``stage_path`` first and then put in place, one table after the other. A run that broke off is
    repeated with the same ``stage_path``: once the stage is complete its rows are put in place again, which changes nothing that was
    done already. The audit rows of a batch are a folder of their own below ``audit_path``, named by the end of ``stage_path``.
    """
    from ..schemas import AUDIT

    spark = batch.sparkSession
    try:
        plan = {r["name"]: r["buckets"] for r in spark.read.parquet(f"{stage_path}/plan").collect()}
    except AnalysisException:  # the stage is not complete
        of_key = {"documents": "document_id", "processing_jobs": "job_id", "land_records": "document_id", "ocr_results": "document_id"}
        plan = {name: tables[name].touched(batch, column) for name, column in of_key.items()}
        found = {name: tables[name].rows_of(plan[name]) for name in plan}
        judged = stored_once(spark, persistence_codes(batch, found), f"{stage_path}/judged")
        for name in TABLE_KEYS.keys() - plan.keys():
            plan[name] = tables[name].touched(judged, "record_id")
            found[name] = tables[name].rows_of(plan[name])
        found["audit_logs"] = spark.createDataFrame([], AUDIT)
        for name, rows in persist_results(batch, found, now, judged).items():
            rows.write.mode("overwrite").parquet(f"{stage_path}/{name}")
        spark.createDataFrame(list(plan.items()), "name string, buckets array<int>").write.mode("overwrite").parquet(f"{stage_path}/plan")
    for name, buckets in plan.items():
        tables[name].overwrite(spark.read.parquet(f"{stage_path}/{name}"), buckets)
    audit = spark.read.parquet(f"{stage_path}/audit_logs")
    audit.write.mode("overwrite").parquet(f"{audit_path}/batch={stage_path.rstrip('/').rsplit('/', 1)[-1]}")
    return spark.read.parquet(f"{stage_path}/outcomes")


def process_touched(ocr: DataFrame, responses: DataFrame, reference: Reference | None, tables: dict[str, KeyedTable], audit_path: str,
                    now: datetime, stage_path: str, existing: DataFrame | None = None, within_batch: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outcomes, failures) of a batch stored by :func:`persist_touched`; ``existing`` defaults to all stored records."""
    prepared = prepare_batch(ocr, responses, reference, tables["land_records"].read() if existing is None else existing, stage_path, within_batch)
    batch = stored_once(ocr.sparkSession, prepared, f"{stage_path}/prepared")
    outcomes = persist_touched(batch.filter("error_code is null"), tables, audit_path, stage_path, now)
    return outcomes, batch.filter("error_code is not null").select("job_id", "document_id", "user_id", "error_code")


def check_outputs(manifest: DataFrame, outputs: DataFrame, reference: Reference | None) -> DataFrame:
    """Verdict, issues and duplicate matches per manifest document; failed ones keep their error code."""
    return judge(with_missing(manifest, outputs), reference)


def judge(staged: DataFrame, reference: Reference | None) -> DataFrame:
    """:func:`check_outputs` of documents that already have their output: (id, failed, error_code, values)."""
    good = normalize_record(values_to_columns(staged.filter(~F.col("failed")))).withColumnRenamed("id", "record_id")
    checked = duplicates.find_duplicates(rules.validate(good, reference))
    judged = duplicates.add_duplicate_issue(checked).select(
        F.col("record_id").alias("id"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error_code"),
        rules.record_verdict(F.col("issues")).alias("verdict"), rules.approval_blocked(F.col("issues")).alias("approval_blocked"),
        "duplicate_check", "match_count", "issues",
    )
    failed = staged.filter("failed").select("id", "failed", "error_code")
    return judged.unionByName(failed, allowMissingColumns=True)


def score_outputs(outputs: DataFrame, ocr: DataFrame, issues: DataFrame) -> DataFrame:
    """Scored record per output: fields array, overall score, band, review flag and reasons.

    ``issues`` is (id, issues). Lines, fields and issues of a document meet in one row, so lines are looked up
    with array functions and are not repeated per field.
    """
    lines = ocr.select(F.col("document_id").alias("id"), conf.prepare_lines(page_lines(F.col("pages"))).alias("_lines"))
    none = F.array().cast(f"array<{ISSUE}>")
    no_lines = F.array().cast("array<struct<text:string,confidence:double>>")
    staged = (
        outputs.filter(~F.coalesce(F.col("failed"), F.lit(False)))
        .join(lines, "id", "left").join(issues.select("id", F.col("issues").alias("_issues")), "id", "left")
        .withColumns({"_lines": F.coalesce("_lines", no_lines), "_issues": F.coalesce("_issues", none)})
    )
    return rollup_record(with_scored_fields(staged).select("id", "fields", "_issues")).select(
        "id", "overall_score", "overall_band", "review_required", "reasons", "fields"
    )


def with_scored_fields(staged: DataFrame) -> DataFrame:
    """``fields`` as an array of scored fields, out of the maps ``fields`` and ``values`` and the arrays ``_lines`` and ``_issues``."""
    def one(entry: Column) -> Column:
        name = entry["key"]
        own = F.filter("_issues", lambda i: i["field_name"] == name)
        extraction = F.element_at(F.col("fields"), name)["confidence"]
        return conf.score_field(name, entry["value"], extraction, F.col("_lines"), own)

    return staged.withColumn("fields", F.transform(F.map_entries("values"), one))


def rollup_record(df: DataFrame) -> DataFrame:
    """Record score from the ``fields`` array and the record-level findings in ``_issues``."""
    scores = F.filter(F.transform("fields", lambda f: f["score"]), lambda s: s.isNotNull())
    overall = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s), F.size(scores).cast("double"))
    record_level = F.size(F.filter(
        "_issues", lambda i: i["field_name"].isNull() & conf.is_actionable(i["status"], i["severity"])))
    return df.withColumn("overall_score", overall).withColumns({
        "overall_band": conf.band(F.col("overall_score")),
        "review_required": F.exists("fields", lambda f: f["review_required"]) | (record_level > 0),
        "reasons": F.array_compact(F.array(
            F.when(record_level > 0, F.concat(record_level.cast("string"), F.lit(" finding(s) on the whole record"))),
            F.when(F.col("overall_score").isNull(), F.lit("no field has a score")),
        )),
    })


def record_confidence(fields: DataFrame, issues: DataFrame) -> DataFrame:
    """The same rollup for long tables: ``fields`` (record_id, score, review_required), ``issues`` long."""
    scores = fields.groupBy("record_id").agg(
        F.avg("score").alias("overall_score"), F.bool_or("review_required").alias("_fields_review"),
        F.count("*").alias("fields"), F.count("score").alias("scored"),
    )
    level = issues.filter(F.col("field_name").isNull() & conf.is_actionable(F.col("status"), F.col("severity"))).groupBy(
        "record_id").agg(F.count("*").alias("record_issues"))
    return scores.join(level, "record_id", "left").select(
        "record_id", "overall_score", conf.band(F.col("overall_score")).alias("overall_band"),
        (F.col("_fields_review") | (F.coalesce("record_issues", F.lit(0)) > 0)).alias("review_required"),
        "fields", "scored", F.coalesce("record_issues", F.lit(0)).cast("long").alias("record_issues"),
    )


def scored_fields(scored: DataFrame) -> DataFrame:
    """Long form of ``score_outputs``."""
    return scored.select("id", F.inline("fields"))
