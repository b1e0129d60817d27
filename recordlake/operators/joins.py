"""Joins between manifests, outputs, records, fields, issues and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import FIELD_NAMES
from . import skew


def join_outputs(manifest: DataFrame, outputs: DataFrame, how: str = "left") -> DataFrame:
    """Manifest rows with their output; 'inner' keeps documents that have one."""
    return manifest.join(outputs, "id", how)


def with_missing(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every manifest document; one without an output counts as failed with NO_OUTPUT."""
    found = outputs.withColumn("_found", F.lit(True))
    joined = manifest.join(found, "id", "left")
    return joined.withColumns({
        "failed": F.coalesce(F.col("failed"), F.col("_found").isNull()),
        "error_code": F.when(F.col("_found").isNull(), F.lit("NO_OUTPUT")).otherwise(F.col("error_code")),
    }).drop("_found")


def to_long(df: DataFrame, key: str = "record_id", names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """One row per record and field."""
    present = [n for n in names if n in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("value")) for n in present
    ])
    return df.select(F.col(key), F.inline(pairs))


#: Buckets in which the rows of one key are first put together.
WIDE_SHARES = 64


def to_wide(df: DataFrame, key: str = "record_id", names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """One row per record with a column per known field name; of several values of a field the largest.

    Texts are aggregated by sorting, so rows are dealt by key before: a task sorts its share of the shuffle and not all that its part
    of the input unfolds to. A key's rows go to a bucket for each task they come from, so a hot key is put together in many tasks first.
    """
    share = F.pmod(F.spark_partition_id(), F.lit(WIDE_SHARES))
    dealt = df.select(key, "field_name", "value", share.alias("_share")).repartition(key, "_share")
    found = [F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names]
    return dealt.groupBy(key, "_share").agg(*found).groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def align_fields(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, field_name, expected, got) for the fields of the ground truth; extra output fields are ignored."""
    got = outputs.select("id", F.col("values").alias("_values"))
    long_truth = to_long(truth, "id").withColumnRenamed("value", "expected")
    # The output is one row per document and stays a map, so the join is on the document alone.
    return long_truth.join(got, "id", "left").select(
        "id", "field_name", "expected", F.element_at("_values", F.col("field_name")).alias("got")
    )


ISSUE_COLUMNS = ("rule_id", "field_name", "status", "severity", "message")


def _children(df: DataFrame, key: list[str], columns: list[str], part_rows: int, name: str) -> DataFrame:
    """All rows of ``df`` as sorted arrays of structs, one array per key and part."""
    numbered = skew.in_parts(df.select(*key, F.struct(*columns).alias("_row")), key, part_rows, "_part")
    return numbered.groupBy(*key, "_part").agg(F.array_sort(F.collect_list("_row")).alias(name))


def record_detail(records: DataFrame, fields: DataFrame, issues: DataFrame, documents: DataFrame, part_rows: int) -> DataFrame:
    """Record with all its fields, all its findings, and its document.

    Children are grouped before the join. A record with up to ``part_rows`` fields and findings is one row with part 0; with more of
    either it has several rows, which share record and document and hold the children in parts. Records get their document and their
    parts first, so the grouped children stay where their grouping put them.
    """
    docs = documents.select(F.col("id").alias("document_id"), F.struct(*documents.columns).alias("document"))
    field_columns = [c for c in fields.columns if c != "record_id"]
    issue_columns = [c for c in ISSUE_COLUMNS if c in issues.columns]
    several = reduce(DataFrame.unionByName, [skew.several_parts(c, ["record_id"], part_rows) for c in (fields, issues)])
    several = several.groupBy("record_id").agg(F.max("_parts").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    staged = records.join(docs, "document_id", "left").join(F.broadcast(several), "record_id", "left")
    staged = staged.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    for rows, columns, name in ((fields, field_columns, "extracted_fields"), (issues, issue_columns, "validation")):
        grouped = _children(rows, ["record_id"], columns, part_rows, name).withColumnRenamed("_part", "part")
        staged = staged.join(grouped, ["record_id", "part"], "left")
    # Rows are dealt to parts by a hash, which can leave one without any.
    held = staged.filter((parts == 1) | F.col("extracted_fields").isNotNull() | F.col("validation").isNotNull())
    return held.select(
        *["document_id", "record_id", *[c for c in records.columns if c not in ("document_id", "record_id")]], "part",
        F.coalesce("extracted_fields", F.array().cast(_struct_array(fields, field_columns))).alias("extracted_fields"),
        F.coalesce("validation", F.array().cast(_struct_array(issues, issue_columns))).alias("validation"), "document",
    )


def _struct_array(df: DataFrame, names: list[str]) -> str:
    return "array<struct<" + ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names) + ">>"


def attach_issues(fields: DataFrame, issues: DataFrame, part_rows: int, key: str = "record_id") -> DataFrame:
    """Add all ``issues`` of the same record and field to field rows; record-level findings stay out.

    A field row whose findings exceed ``part_rows`` comes once per part of them.
    """
    own = issues.filter(F.col("field_name").isNotNull()).withColumn("_field", F.col("field_name"))
    grouped = _children(own, [key, "_field"], list(ISSUE_COLUMNS), part_rows, "issues")
    grouped = grouped.withColumnsRenamed({"_field": "field_name", "_part": "part"})
    empty = F.array().cast(_struct_array(issues, list(ISSUE_COLUMNS)))
    return fields.join(grouped, [key, "field_name"], "left").withColumns(
        {"issues": F.coalesce("issues", empty), "part": F.coalesce("part", F.lit(0))})


def record_level_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("field_name").isNull())


def match_checksum(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``fixture_id`` of the known file with the same SHA-256, NULL when there is none."""
    digest = F.lower(strip(F.col("checksum")))
    listed = known.select(
        F.lower(strip(F.col("sha256"))).alias("_sha"), F.col("fixture_id")
    ).groupBy("_sha").agg(F.min("fixture_id").alias("fixture_id"))
    keyed = documents.withColumn("_sha", F.when(F.length(digest) == 64, digest))
    return keyed.join(listed, "_sha", "left").drop("_sha")


def plan_rerun(manifest: DataFrame, outputs: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Documents to extract again, with the reason missing, failed or stale."""
    have = outputs.select(
        "id", F.lit(True).alias("_found"), F.coalesce("failed", F.lit(False)).alias("_failed"),
        F.col("model").alias("_model"), F.col("prompt_version").alias("_prompt"),
    )
    current = F.col("_model").eqNullSafe(model) & F.col("_prompt").eqNullSafe(prompt_version)
    reason = (
        F.when(F.col("_found").isNull(), F.lit("missing"))
        .when(F.col("_failed"), F.lit("failed"))
        .when(~current, F.lit("stale"))
    )
    return manifest.join(have, "id", "left").select("id", reason.alias("reason")).filter("reason is not null")


def rerun_ids(missing: DataFrame, stale: DataFrame) -> DataFrame:
    return missing.select("id").unionByName(stale.select("id")).distinct().orderBy("id")


def reuse_cached(requests: DataFrame, cache: DataFrame, ttl_seconds: int, slices: int | None = None) -> DataFrame:
    """Add ``cached_at`` and ``cached_id``: the newest stored result with the same key, at most ``ttl_seconds`` old.

    ``requests`` has (request_id, key, at), ``cache`` has (cache_id, key, at). Both are laid out in one order per key; a pass over
    slices of it finds the newest predecessor of each request without pairing requests and stored rows.
    """
    ttl = ttl_seconds * 1_000_000

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    asked = requests.select(
        "request_id", "key", F.col("at"), micros("at").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("struct<t:bigint,at:timestamp,id:string>").alias("_hit"),
    )
    stored = cache.select(
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "key", F.col("at"),
        micros("at").alias("_t"), F.lit(0).alias("_kind"),
        F.struct(
            micros("at").alias("t"), F.col("at").cast("timestamp").alias("at"), F.col("cache_id").cast("string").alias("id")
        ).alias("_hit"),
    )
    tie = F.coalesce(F.col("_hit.id"), F.col("request_id").cast("string"), F.lit(""))
    seen = skew.last_before(asked.unionByName(stored), "key", [F.col("_t"), F.col("_kind"), tie], "_hit", slices, "_last")
    fresh = F.col("_t") - F.col("_last.t") <= ttl
    return seen.filter("_kind = 1").select(
        "request_id", "key", "at",
        F.when(fresh, F.col("_last.at")).alias("cached_at"), F.when(fresh, F.col("_last.id")).alias("cached_id"),
    )


def open_task_of(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records with the newest open task, NULL when there is none."""
    from .windows import latest_open_task

    newest = latest_open_task(tasks).select(
        F.col("land_record_id").alias("record_id"), F.col("id").alias("task_id"), F.col("status").alias("task_status")
    )
    return records.join(newest, "record_id", "left")


def has_active_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with a pending or running job."""
    active = jobs.filter(F.col("status").isin("PENDING", "RUNNING")).select(F.col("document_id").alias("_doc")).distinct()
    return documents.join(active, F.col("document_id") == F.col("_doc"), "left_semi")


def compare_phases(df: DataFrame, phases: tuple[str, str] = ("before", "after")) -> DataFrame:
    """One row per document with both phases side by side; ``df`` has (id, family, phase, cer, wer, seconds)."""
    metrics = ("cer", "wer", "seconds")
    sides = [
        F.max(F.when(F.col("phase") == phase, F.col(metric))).alias(f"{metric}_{phase}")
        for phase in phases for metric in metrics
    ]
    return df.groupBy("id", "family").agg(*sides)


def overlay_corrections(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records with the newest correction of each field applied; a correction to NULL wins as well."""
    from .windows import latest_corrections

    columns = [n for n in FIELD_NAMES if n in records.columns]
    latest = latest_corrections(corrections)
    wide = latest.groupBy(F.col("land_record_id").alias("record_id")).agg(*[
        F.max(F.when(F.col("field_name") == n, F.struct(F.col("new_value").alias("v")))).alias(f"_c_{n}") for n in columns
    ])
    joined = records.join(wide, "record_id", "left")
    return joined.select(*[
        F.when(F.col(f"_c_{c}").isNotNull(), F.col(f"_c_{c}.v")).otherwise(F.col(c).cast("string")).alias(c)
        if c in columns else F.col(c)
        for c in records.columns
    ])

