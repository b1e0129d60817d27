"""Evaluation jobs and the combined report."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions.distance import classify_fields, with_error_rates, with_rates_of_keys
from ..functions.text import compare_key
from ..operators import aggregates as agg
from ..operators import evaluation as ev
from ..operators.joins import align_fields, to_long, with_missing
from ..operators.ocr import page_lines, pages_text
from ..operators.skew import shared_folder
from ..schemas import FIELD_VERDICTS, ISSUE, SEVERITIES
from .process import judge, stored_once, with_scored_fields


def field_verdicts(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, field_name, expected, got, verdict) of the outputs that did not fail."""
    good = outputs.filter(~F.coalesce(F.col("failed"), F.lit(False)))
    covered = truth.join(good.select("id"), "id", "left_semi")
    return classify_fields(align_fields(covered, good))


def document_results(manifest: DataFrame, outputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per manifest document: failed or not, verdict counts and accuracy."""
    status = with_missing(manifest.select("id"), outputs.select("id", "failed", "error_code", "provider", "model", "elapsed_seconds"))
    return status.join(ev.evaluate_documents(verdicts), "id", "left")


def evaluate_extraction(manifest: DataFrame, truth: DataFrame, outputs: DataFrame) -> dict[str, DataFrame]:
    """Field verdicts, per-document results, the summary and the accuracy of each field."""
    verdicts = field_verdicts(truth, outputs)
    results = document_results(manifest, outputs, verdicts)
    return {"verdicts": verdicts, "results": results, "summary": ev.evaluation_summary(results),
            "fields": ev.field_accuracy(verdicts)}


def ocr_benchmark(truth: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-document error rates, summary). A document without text, or with ``error``, counts as failed."""
    read = ocr.select(
        F.col("document_id").alias("id"), pages_text(F.col("pages")).alias("hypothesis"),
        F.size(page_lines(F.col("pages"))).alias("lines_detected"), F.col("elapsed_seconds").alias("seconds"), _error_of(ocr),
    )
    joined = truth.select("id", F.col("text").alias("reference"), F.size("lines").alias("lines_expected")).join(read, "id", "left")
    results = _rated(joined).drop("reference", "hypothesis")
    return results, ev.ocr_summary(results)


def _error_of(ocr: DataFrame) -> Column:
    return (F.col("error") if "error" in ocr.columns else F.lit(None).cast("string")).alias("error")


def _rated(joined: DataFrame) -> DataFrame:
    """``failed``, ``error``, ``cer`` and ``wer`` of rows with ``reference``, ``hypothesis`` and ``error``."""
    empty = ~F.coalesce(F.regexp_like("hypothesis", F.lit(r"(?U)\S")), F.lit(False))
    return with_error_rates(joined.withColumns({
        "hypothesis": F.coalesce("hypothesis", F.lit("")),
        "failed": F.col("error").isNotNull() | empty,
        "error": F.coalesce("error", F.when(empty, F.lit("empty OCR output"))),
    }))


def compare_configs(truth: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document with both runs, means per phase and script group).

    ``before`` and ``after`` have (id, text, seconds), ``truth`` (id, text, family). Each text is normalised once, before the join.
    """
    def run(df: DataFrame, phase: str) -> DataFrame:
        return df.select("id", compare_key(F.col("text")).alias("hypothesis"), "seconds", F.lit(phase).alias("phase"))

    both = run(before, "before").unionByName(run(after, "after"))
    expected = truth.select("id", "family", compare_key(F.col("text")).alias("reference"))
    rated = with_rates_of_keys(both.join(expected, "id"), "reference", "hypothesis")
    slim = rated.select("id", "family", "phase", "cer", "wer", "seconds")
    from ..operators.joins import compare_phases

    return compare_phases(slim), ev.phase_means(slim)


def assemble_report(results: DataFrame, fields: DataFrame, checks: DataFrame, scored: DataFrame, ocr: DataFrame,
                    rerun: DataFrame, now: datetime, versions: dict[str, str | None]) -> DataFrame:
    """One row with every headline number, the accuracy of every field name that occurs, and the providers and models in use.

    Findings are counted by severity; one that is NULL or not a known name is in ``issues_unknown``. ``versions`` become columns.
    """
    flagged = agg.flagged_fields(scored.select(F.inline("fields")))
    severity = checks.select(F.explode("issues").alias("i")).select("i.severity")
    severities = severity.agg(
        *[F.count_if(F.col("severity") == s).alias(f"issues_{s.lower()}") for s in SEVERITIES],
        F.count_if(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).alias("issues_unknown"))
    ok = ~F.coalesce(F.col("failed"), F.lit(False))
    providers = results.filter(ok).select("provider", "model").distinct().agg(
        F.array_sort(F.collect_list(F.struct("provider", "model"))).alias("providers"))
    latency = results.filter(ok).agg(F.avg("elapsed_seconds").alias("mean_extraction_seconds"), F.max("elapsed_seconds").alias("max_extraction_seconds"))
    parts = [
        ev.evaluation_summary(results), agg.verdict_summary(checks), agg.review_rate(checks), severities,
        flagged.withColumnsRenamed({"flagged": "flagged_fields", "total": "scored_fields"}),
        ocr.select("mean_cer", "mean_wer", F.col("failures").alias("ocr_failures"), F.col("total_seconds").alias("ocr_seconds")),
        rerun.agg(F.count("*").alias("extraction_rerun")), _per_field(fields), providers, latency,
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.crossJoin(part)
    return _dated(report, now, versions)


def _per_field(fields: DataFrame) -> DataFrame:
    return fields.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("field_name", F.lit("")).alias("name"), "accuracy")))).alias("field_accuracy"))


def _dated(report: DataFrame, now: datetime, versions: dict[str, str | None]) -> DataFrame:
    return report.withColumns({**{f"{k}_version": F.lit(v).cast("string") for k, v in versions.items()}, "date": F.lit(now)})


def report_details(results: DataFrame, ocr_results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seconds per stage and document, failed documents per stage) of a report, as long tables of any length."""
    stages = results.select(F.lit("extraction").alias("stage"), F.col("id").alias("document_id"), F.col("elapsed_seconds").alias("seconds"), "failed").unionByName(
        ocr_results.select(F.lit("ocr").alias("stage"), F.col("id").alias("document_id"), "seconds", "failed"))
    return agg.stage_latency(stages), agg.stage_failures(stages)


def staged_sources(manifest: DataFrame, truth_records: DataFrame, truth_text: DataFrame, outputs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(id, listed, output, truth, expected, read): what the five sources hold of a document, in one row.

    Each source is read once and all of them meet in one shuffle. An id stands once in a source; rows without id match nothing and stay
    apart.
    """
    def rest(df: DataFrame) -> Column:
        return F.struct(*[c for c in df.columns if c != "id"])

    parts = [
        manifest.select("id", F.lit(True).alias("listed")), outputs.select("id", rest(outputs).alias("output")),
        truth_records.select("id", rest(truth_records).alias("truth")),
        truth_text.select("id", F.struct("text", F.size("lines").alias("lines_expected")).alias("expected")),
        ocr.select(F.col("document_id").alias("id"), F.struct("pages", "elapsed_seconds", _error_of(ocr)).alias("read")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    apart = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    return together.groupBy("id", apart.alias("_apart")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns[1:]]).drop("_apart")


def document_facts(staged: DataFrame, counts: DataFrame, checks: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """One row per document with all that the report adds up.

    ``counts`` has the verdict counts and accuracy of a document, ``checks`` its verdict and findings. Columns of a part that a document
    does not have are null: ``failed`` to ``rerun`` of one that the manifest does not list, ``n_flagged`` and ``n_fields`` of one without
    a good output, ``cer`` to ``ocr_seconds`` of one without expected text.
    """
    has, listed = F.col("output").isNotNull(), F.col("listed")
    failed = F.coalesce("output.failed", ~has)
    good = has & ~failed
    current = F.col("output.model").eqNullSafe(model) & F.col("output.prompt_version").eqNullSafe(prompt_version)
    rows = staged.select(
        "id", F.coalesce(listed, F.lit(False)).alias("listed"), F.when(listed, failed).alias("failed"), good.alias("_good"),
        *[F.when(listed & good, F.col(f"output.{c}")).alias(c) for c in ("provider", "model", "elapsed_seconds")],
        F.when(listed, ~good | ~current).alias("rerun"), F.when(good, F.col("output.fields")).alias("fields"), F.when(good, F.col("output.values")).alias("values"),
        F.when(good, conf.prepare_lines(page_lines(F.col("read.pages")))).alias("_lines"),
        F.col("expected").isNotNull().alias("_expected"), F.col("expected.text").alias("reference"), pages_text(F.col("read.pages")).alias("hypothesis"),
        F.col("read.elapsed_seconds").alias("ocr_seconds"), F.col("read.error").alias("error"),
    )
    joined = rows.join(checks.select("id", "verdict", F.col("issues").alias("_issues")), "id", "left").join(counts, "id", "left")
    none, no_lines = F.array().cast(f"array<{ISSUE}>"), F.array().cast("array<struct<text:string,confidence:double>>")
    scored = with_scored_fields(joined.withColumns({"_lines": F.coalesce("_lines", no_lines), "_issues": F.coalesce("_issues", none)}))
    found = F.transform("_issues", lambda i: i["severity"])
    severities = [F.size(F.filter(found, lambda x: x == s)).alias(f"issues_{s.lower()}") for s in SEVERITIES]
    rated = _rated(scored.withColumnRenamed("failed", "_failed")).withColumnsRenamed({"failed": "ocr_failed", "_failed": "failed"})
    expected = F.col("_expected")
    return rated.select(
        "id", "listed", "failed", "provider", "model", "elapsed_seconds", "rerun", "verdict", *severities, F.size("_issues").alias("issues"),
        F.when(F.col("_good"), F.size(F.filter("fields", lambda f: f["review_required"]))).alias("n_flagged"), F.when(F.col("_good"), F.size("fields")).alias("n_fields"),
        *[F.when(listed, F.col(c)).alias(c) for c in ("accuracy", *(v.lower() for v in FIELD_VERDICTS))],
        *[F.when(expected, F.col(c)).alias(c) for c in ("cer", "wer", "ocr_failed", "ocr_seconds")],
    )


def evaluation_report(manifest: DataFrame, truth_records: DataFrame, truth_text: DataFrame, outputs: DataFrame,
                      ocr: DataFrame, reference, model: str, prompt_version: str, now: datetime, dataset_version: str | None = None,
                      stage_path: str | None = None) -> DataFrame:
    """Run every evaluation over the same inputs and combine the results into the row of :func:`assemble_report`.

    The sources are read once, into one staged row per document below ``stage_path``. Field verdicts are added up by document and by
    field name in one pass of grouping sets, and every other number comes from one aggregate over :func:`document_facts`. A mean over
    documents can differ in its last digits from one that adds in another order.
    """
    spark = manifest.sparkSession
    folder = stage_path or f"{shared_folder(spark)}/recordlake-report/{uuid4().hex}"
    staged = stored_once(spark, staged_sources(manifest, truth_records, truth_text, outputs, ocr), f"{folder}/documents")
    compared = staged.filter(F.col("truth").isNotNull() & F.col("output").isNotNull() & ~F.coalesce("output.failed", F.lit(False)))
    truth = to_long(compared.select(F.struct("id", F.col("output.values").alias("got")).alias("_of"), "truth.*"), "_of")
    verdicts = classify_fields(truth.select("_of.id", "field_name", F.col("value").alias("expected"), F.element_at("_of.got", F.col("field_name")).alias("got")))
    measured = stored_once(spark, ev.accuracies(verdicts), f"{folder}/accuracies")
    checks = judge(staged.filter("listed").select(
        "id", F.coalesce("output.failed", F.col("output").isNull()).alias("failed"),
        F.when(F.col("output").isNull(), F.lit("NO_OUTPUT")).otherwise(F.col("output.error_code")).alias("error_code"), F.col("output.values").alias("values")), reference)
    facts = document_facts(staged, measured.filter("by_document").drop("by_document", "field_name", "fields"), checks, model, prompt_version)

    def total(c: Column | str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    listed, read = F.col("listed"), F.col("ocr_failed") == F.lit(False)
    known = reduce(lambda a, b: a + b, [F.col(f"issues_{s.lower()}") for s in SEVERITIES])
    asks = F.coalesce(F.col("verdict").isin("REVIEW_REQUIRED", "BLOCKED"), F.lit(False)).cast("double")
    report = facts.agg(
        F.count_if(listed).alias("documents"), F.count_if("failed").alias("failures"), F.avg("accuracy").alias("mean_accuracy"),
        *[total(v.lower()).alias(v.lower()) for v in FIELD_VERDICTS],
        *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("READY_FOR_APPROVAL", "ready"), ("REVIEW_REQUIRED", "review"), ("BLOCKED", "blocked"))],
        F.avg(F.when(listed, asks)).alias("review_rate"),
        *[total(f"issues_{s.lower()}").alias(f"issues_{s.lower()}") for s in SEVERITIES], total(F.col("issues") - known).alias("issues_unknown"),
        total("n_flagged").alias("flagged_fields"), total("n_fields").alias("scored_fields"),
        F.avg(F.when(read, F.col("cer"))).alias("mean_cer"), F.avg(F.when(read, F.col("wer"))).alias("mean_wer"), F.count_if("ocr_failed").alias("ocr_failures"),
        F.sum("ocr_seconds").alias("ocr_seconds"), F.count_if("rerun").alias("extraction_rerun"),
        F.array_sort(F.collect_set(F.when(listed & ~F.col("failed"), F.struct("provider", "model")))).alias("providers"),
        F.avg("elapsed_seconds").alias("mean_extraction_seconds"), F.max("elapsed_seconds").alias("max_extraction_seconds"),
    ).crossJoin(_per_field(measured.filter(~F.col("by_document"))))
    versions = {"dataset": dataset_version, "prompt": prompt_version, "reference": None if reference is None else reference.version}
    return _dated(report, now, versions)
