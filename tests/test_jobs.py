"""Whole jobs on the specimen set, state changes, files and streams."""

import json
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recordlake.operators import duplicates, joins, skew, state
from recordlake.plans import evaluate, process
from recordlake.schemas import FIELD_NAMES, ISSUE
from recordlake.sources import readers, sinks
from recordlake.streaming import jobs as streams

from .test_rules import VALID, demo

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
BAD = {"owner_name": None, "area": "0", "area_unit": "bigha", "tehsil": "Wrong Tehsil", "record_date": "99/99/2024"}
SPECIMENS = {  # values and confidence of the four specimen documents
    "doc01_clean": ({"area_unit": "Hectare"}, 1.0), "doc02_noisy": ({"area_unit": "Hectare", "survey_number": "4145/2"}, 0.99),
    "doc03_faded": ({"area_unit": "Hectare"}, 0.99), "step08_bad": (BAD, 0.95),
}
LINES = ["District: Demo District", "Tehsil: Demo Tehsil", "Village: Demo Village", "Khata Number: 123", "Khasra Number: 78", "Survey Number: 145/2",
         "Owner Name: Ramesh Kumar", "Father Name: Suresh Kumar", "Area: 2.45 Hectare", "Land Classification: Agricultural",
         "Mutation Number: M-2024-0091", "Record Date: 2024-03-15"]
FIRST_PAGE = [0.956667, 0.956667, 0.956667, 0.943333, 0.946667, 0.936667, 0.96, 0.9575, 0.93, 0.96, 0.936667, 0.96]


def write(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(value))


def dataset(folder):
    ids = list(SPECIMENS)
    write(folder, "manifest", {"version": "v1", "documents": [{"id": i, "file": f"{i}.pdf", "ground_truth": f"{i}.json", "difficulty": "EASY", "attributes": ["printed"]} for i in ids]})
    for i, (change, c) in SPECIMENS.items():
        values = {**VALID, **change}
        fields = {n: {"value": v, "confidence": None if v is None else (0.9 if v == "99/99/2024" else c), "status": "EXTRACTED"} for n, v in values.items()}
        write(folder / "outputs", i, {"id": i, "failed": False, "provider": "p", "model": "m", "prompt_version": "v1", "elapsed_seconds": 1.0, "fields": fields, "values": values})
        truth = {**VALID, **(BAD if i == "step08_bad" else {"area_unit": "Hectare"}), "id": i}
        truth["area"] = float(truth["area"])
        write(folder / "truth", f"{i}_record", truth)
        lines = [{"text": t, "confidence": x, "box": [0, 0, 1, 1]} for t, x in zip(LINES, FIRST_PAGE)]
        write(folder / "ocr", i, {"engine": "e", "engine_version": "1", "source_file": "f", "elapsed_seconds": 1.0,
                                  "pages": [{"page_number": 1, "text": "\n".join(LINES), "confidence": 0.9, "lines": lines, "width": 1, "height": 1}]})
        write(folder / "text", i, {"id": i, "lines": LINES})
    return str(folder)


def test_specimen_set(spark, tmp_path):
    d = dataset(tmp_path)
    manifest, outputs = readers.read_manifest(spark, f"{d}/manifest.json"), readers.read_model_outputs(spark, f"{d}/outputs")
    checks = process.check_outputs(manifest, outputs, demo(spark)).cache()
    verdicts = {r.id: r.verdict for r in checks.collect()}
    assert verdicts == {"doc01_clean": "REVIEW_REQUIRED", "doc02_noisy": "READY_FOR_APPROVAL", "doc03_faded": "REVIEW_REQUIRED", "step08_bad": "BLOCKED"}
    assert {r.id: r.match_count for r in checks.collect()} == {"doc01_clean": 2, "doc02_noisy": 0, "doc03_faded": 2, "step08_bad": 2}
    result = evaluate.evaluate_extraction(manifest, readers.read_ground_truth(spark, f"{d}/truth", "record"), outputs)
    s = result["summary"].first()
    assert (s.documents, s.failures, s.correct, s.incorrect, round(s.mean_accuracy, 4)) == (4, 0, 55, 1, 0.9821)
    ocr = readers.read_ocr(spark, f"{d}/ocr")
    scored = process.score_outputs(outputs, ocr, checks.select("id", "issues")).cache()
    flagged = sum(f.review_required for r in scored.collect() for f in r.fields)
    assert flagged == 12 and sum(len(r.fields) for r in scored.collect()) == 56
    first = {r.id: r for r in scored.collect()}["doc01_clean"]
    assert round(first.overall_score, 4) == 0.9529 and first.overall_band == "HIGH" and first.review_required
    rates, summary = evaluate.ocr_benchmark(readers.read_ground_truth(spark, f"{d}/text"), ocr)
    assert summary.first().mean_cer == 0.0 and {r.lines_detected for r in rates.collect()} == {12}
    report = evaluate.evaluation_report(manifest, readers.read_ground_truth(spark, f"{d}/truth", "record"), readers.read_ground_truth(spark, f"{d}/text"),
                                        outputs, ocr, demo(spark), "m", "v1", NOW)
    sinks.write_report(report, f"{d}/report")
    latest = sinks.latest_report(spark, f"{d}/report", "documents long, blocked long, flagged_fields long, date timestamp").first()
    assert (latest.documents, latest.blocked, latest.flagged_fields) == (4, 1, 12)
    assert "flagged_fields: 12" in sinks.render_report(latest)


def test_report_out_of_one_pass_equals_its_parts(spark, tmp_path):
    """Documents that only some of the sources have; every source is scanned once and the report reads the stage alone."""
    d = dataset(tmp_path / "set")
    write(tmp_path / "set" / "outputs", "unlisted", {"id": "unlisted", "failed": False, "provider": "q", "model": "m", "prompt_version": "v0", "elapsed_seconds": 9.0,
                                                     "fields": {"area": {"value": "1", "confidence": 0.1, "status": "EXTRACTED"}}, "values": {"area": "1"}})
    write(tmp_path / "set" / "outputs", "broken", {"id": "broken", "failed": True, "error_code": "PROVIDER_TIMEOUT", "provider": "q", "model": "m", "prompt_version": "v1", "elapsed_seconds": 5.0, "fields": None, "values": None})
    write(tmp_path / "set" / "truth", "unlisted_record", {"id": "unlisted", "area": 2.0})
    write(tmp_path / "set" / "truth", "lonely_record", {"id": "lonely", "area": 2.0})
    write(tmp_path / "set" / "text", "unread", {"id": "unread", "lines": ["a b"]})
    more = spark.createDataFrame([("broken",), ("absent",), (None,), (None,)], "id string")
    sources = [readers.read_manifest(spark, f"{d}/manifest.json").select("id").unionByName(more), readers.read_ground_truth(spark, f"{d}/truth", "record"),
               readers.read_ground_truth(spark, f"{d}/text"), readers.read_model_outputs(spark, f"{d}/outputs"), readers.read_ocr(spark, f"{d}/ocr")]
    manifest, truth, text, outputs, ocr = [process.stored_once(spark, s, str(tmp_path / f"s{i}")) for i, s in enumerate(sources)]
    staged = evaluate.staged_sources(manifest, truth, text, outputs, ocr)
    assert staged._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 5
    got = evaluate.evaluation_report(manifest, truth, text, outputs, ocr, demo(spark), "m", "v1", NOW, "d", str(tmp_path / "stage"))
    assert all(str(tmp_path / "stage") in f for f in got.inputFiles())
    extraction, checks = evaluate.evaluate_extraction(manifest, truth, outputs), process.check_outputs(manifest, outputs, demo(spark))
    want = evaluate.assemble_report(
        extraction["results"], extraction["fields"], checks, process.score_outputs(outputs, ocr, checks.select("id", "issues")),
        evaluate.ocr_benchmark(text, ocr)[1], joins.plan_rerun(manifest, outputs, "m", "v1"), NOW, {"dataset": "d", "prompt": "v1", "reference": demo(spark).version})
    got, want = got.first().asDict(recursive=True), want.first().asDict(recursive=True)
    assert (got["documents"], got["failures"], got["extraction_rerun"], got["ocr_failures"]) == (8, 4, 4, 1)
    assert sorted(got) == sorted(want)
    for name, value in want.items():
        assert got[name] == (pytest.approx(value) if isinstance(value, float) else value), name
    empty = evaluate.evaluation_report(*[s.limit(0) for s in (manifest, truth, text, outputs, ocr)], demo(spark), "m", "v1", NOW, None, str(tmp_path / "none")).first()
    assert (empty.documents, empty.correct, empty.mean_accuracy, empty.providers, empty.field_accuracy) == (0, 0, None, [], {})


def arrivals(spark, ids):
    rows = []
    for i in ids:
        change = {"survey_number": str(i), "owner_name": None if i % 2 else f"Owner {i}", "record_date": "99/99/2024" if i % 5 == 0 else "2024-03-15"}
        body = "broken" if i == 7 else json.dumps({"fields": {n: {"value": v, "confidence": 0.9} for n, v in {**VALID, **change}.items()}})
        text = " " if i == 8 else "page"
        rows.append((f"J{i}", f"D{i}", "u", body, "p", "m", "v1", "v1", [(1, text, 0.9, [(text, 0.9, None)], 1, 1)]))
    return spark.createDataFrame(rows, streams.ARRIVAL)


def batch(spark, rows):
    from checks.changes import batch_tables

    return rows.select("document_id", "pages"), rows.drop("pages"), batch_tables(spark, rows)


def counts(tables):
    return {n: t.count() for n, t in tables.items() if n not in ("outcomes", "failures")}


def test_batch_is_stored_once(spark, tmp_path):
    rows = arrivals(spark, range(1, 11))
    pages, answers, tables = batch(spark, rows)
    out = process.process_batch(pages, answers, demo(spark), tables, NOW, str(tmp_path / "a"))
    assert {r.document_id: r.error_code for r in out["failures"].collect()} == {"D7": "PROVIDER_BAD_RESPONSE", "D8": "OCR_FAILED"}
    got = counts(out)
    assert got["land_records"] == 8 and got["extracted_fields"] == 8 * 14 and got["ocr_results"] == 8
    lost = out["audit_logs"].filter("action = 'PROCESSING_COMPLETED' and entity_id = 'D5'").first()
    assert "99/99/2024" in lost.metadata
    assert out["land_records"].filter("document_id = 'D5'").first().record_date is None
    # The same jobs again: every one is a replay and no table changes.
    saved = {n: process.stored_once(spark, t, str(tmp_path / "t" / n)) for n, t in out.items() if n not in ("outcomes", "failures")}
    again = process.process_batch(pages, answers, demo(spark), saved, NOW, str(tmp_path / "b"))
    assert counts(again) == got
    assert again["outcomes"].filter("replayed").count() == 8
    failed = state.fail_jobs(saved["processing_jobs"], saved["documents"], again["failures"].withColumns({"error_message": F.lit("x"), "at": F.lit(NOW)}))
    assert failed[0].filter("status = 'FAILED'").count() == 2 and failed[1].filter("processing_status = 'FAILED'").count() == 2


def test_terminal_record_is_refused(spark, tmp_path):
    rows = arrivals(spark, [2])
    pages, answers, tables = batch(spark, rows)
    done = spark.createDataFrame([("R", "D2", "APPROVED")], "record_id string, document_id string, status string")
    tables["land_records"] = tables["land_records"].unionByName(done, allowMissingColumns=True)
    out = process.process_batch(pages, answers, None, tables, NOW, str(tmp_path / "a"))
    assert [r.code for r in out["outcomes"].collect()] == ["55000"]


def test_two_drops_equal_one_union(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(1, 6), range(6, 11)):
        arrivals(spark, part).write.mode("append").json(source)
        streams.start_incremental(spark, source, target, demo(spark), str(tmp_path / "state")).awaitTermination()
    once = process.prepare_batch(*(lambda r: (r.select("document_id", "pages"), r.drop("pages")))(arrivals(spark, range(1, 11))), demo(spark),
                                 spark.createDataFrame([], "document_id string, survey_number string, village string"), str(tmp_path / "stage"))
    columns = ["document_id", "error_code", "verdict", "match_count"]
    assert sorted(map(str, spark.read.parquet(target).select(columns).collect())) == sorted(map(str, once.select(columns).collect()))


def test_approve_and_reject(spark):
    names = ", ".join(f"{n} string" for n in FIELD_NAMES)
    rows = [("r1", "READY_FOR_APPROVAL", *VALID.values()), ("r2", "REVIEW_REQUIRED", *{**VALID, "area": "0"}.values()), ("r3", "APPROVED", *VALID.values()), ("r4", "REVIEW_REQUIRED", *VALID.values())]
    records = spark.createDataFrame(rows, f"record_id string, status string, {names}").withColumns({"approved_by": F.lit(None).cast("string"), "approved_at": F.lit(None).cast("timestamp")})
    tasks = spark.createDataFrame([("t4", "r4", "PENDING")], "id string, land_record_id string, status string").withColumn("completed_at", F.lit(None).cast("timestamp"))
    commands = spark.createDataFrame([(i, r, "ok", "u") for i, r in enumerate(["r1", "r1", "r2", "r3", "r4", "r9"])], "seq long, record_id string, reason string, user_id string").withColumn("at", F.lit(NOW))
    new, outcomes, audit = state.approve(records, tasks, commands, demo(spark))
    got = {r.seq: (r.code, r.blockers) for r in outcomes.collect()}
    assert got[0] == (None, None) and got[1][0] == "RECORD_FINALIZED" and got[3][0] == "RECORD_FINALIZED" and got[5][0] == "RECORD_NOT_FOUND"
    assert got[2] == ("APPROVAL_BLOCKED", ["finding blocks approval: FMT_AREA_002"]) and got[4] == ("APPROVAL_BLOCKED", ["reviews still open: 1"])
    assert new.filter("record_id = 'r1'").first().approved_by == "u" and audit.count() == 1
    records2, tasks2, outcomes2, audit2 = state.reject(records, tasks, commands.filter("record_id = 'r4'"))
    assert tasks2.first().status == "CANCELLED" and records2.filter("status = 'REJECTED'").count() == 1 and "t4" in audit2.first().metadata


def test_file_ingest(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name, content in {"a.pdf": b"%PDF-1.4", "b.png": b"no image", "c.exe": b"MZ", "d.tif": b"", "e.jpg": b"\xff\xd8\xff" + b"x" * 50}.items():
        (folder / name).write_bytes(content)
    # The scan skips the empty file, so it is added the way a landing table would hold it.
    empty = spark.createDataFrame([("d", 0, bytearray(b""), "d.tif", None)], "path string, length long, content binary, filename string, declared_mime string")
    ok, bad = readers.ingest_files(readers.read_files(spark, str(folder)).unionByName(empty), 40)
    assert [r.file_name for r in ok.collect()] == ["a.pdf"]
    assert {r.file_name: r.error_code for r in bad.collect()} == {
        "b.png": "FILE_CONTENT_MISMATCH", "c.exe": "UNSUPPORTED_FILE_TYPE", "d.tif": "EMPTY_FILE", "e.jpg": "FILE_TOO_LARGE"}


def test_append_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "entity string, n int")
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"), ["entity"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_slices_follow_the_rows_not_the_time(spark):
    from recordlake.operators import joins, skew, windows

    # Nine of ten rows belong to one key and to one second of one day.
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 70)).otherwise("hot").alias("entity_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 1000).alias("timestamp"))
    sliced = skew.in_slices(rows, "entity_id", [F.col("timestamp"), F.col("id")], 16)
    assert sliced.groupBy("_key", "_slice").count().agg(F.max("count")).first()[0] < 3 * 20_000 / 16
    got = windows.audit_positions(rows, 16).filter("entity_id = 'hot'").orderBy("position").select("position", "timestamp", "id").collect()
    assert [r.position for r in got] == list(range(1, 18_001))
    assert [(r.timestamp, r.id) for r in got] == sorted((r.timestamp, r.id) for r in got)
    spans = windows.stage_durations(rows, 16).filter("entity_id = 'hot'").orderBy("timestamp", "id").collect()
    assert [r.seconds for r in spans[:-1]] == [(b.timestamp - a.timestamp).total_seconds() for a, b in zip(got, got[1:])] and spans[-1].seconds is None
    asked = rows.select(F.col("id").alias("request_id"), F.lit("hot").alias("key"), F.col("timestamp").alias("at"))
    stored = rows.filter("entity_id <> 'hot'").select(F.col("id").alias("cache_id"), F.lit("hot").alias("key"), F.col("timestamp").alias("at"))
    found = {r.request_id: r for r in joins.reuse_cached(asked, stored, 3600, 16).collect()}
    assert all(r.cached_at <= r.at and (r.at - r.cached_at).total_seconds() < 1e-5 for r in found.values() if r.cached_at) and sum(r.cached_at is None for r in found.values()) == 0


def test_no_child_row_is_lost_in_parts(spark):
    from recordlake.operators import joins

    records = spark.createDataFrame([("r1", "d1"), ("r2", "d2"), ("r3", "d3")], "record_id string, document_id string")
    fields = spark.createDataFrame([("r1", f"f{i % 7}", str(i % 3)) for i in range(50)] + [("r2", "x", None)], "record_id string, field_name string, value string")
    issues = spark.createDataFrame([("r1", f"R{i % 2}", "f1", "FAIL", "ERROR", "same") for i in range(30)], "record_id string, rule_id string, field_name string, status string, severity string, message string")
    docs = spark.createDataFrame([("d1",), ("d2",)], "id string")
    got = joins.record_detail(records, fields, issues, docs, part_rows=8).collect()
    assert sum(len(r.extracted_fields) for r in got) == 51 and sum(len(r.validation) for r in got) == 30
    assert {r.record_id for r in got} == {"r1", "r2", "r3"} and len([r for r in got if r.record_id == "r1"]) > 3
    attached = joins.attach_issues(fields.distinct(), issues, part_rows=4).filter("field_name = 'f1' and value = '1'").collect()
    assert sum(len(r.issues) for r in attached) == 30 and len(attached) > 3


def test_the_last_job_of_a_document_counts(spark, tmp_path):
    rows = arrivals(spark, [1, 2])
    twice = rows.unionByName(rows.withColumn("job_id", F.concat("job_id", F.lit("b")))).unionByName(rows)
    out = process.prepare_batch(twice.select("job_id", "document_id", "pages"), twice.drop("pages"), demo(spark), spark.createDataFrame([], "document_id string, survey_number string, village string"), str(tmp_path))
    assert {(r.job_id, r.error_code) for r in out.collect()} == {("J1", "JOB_SUPERSEDED"), ("J2", "JOB_SUPERSEDED"), ("J1b", None), ("J2b", None)} and out.count() == 4


def test_only_the_newest_version_of_a_document_counts(spark):
    from recordlake.operators import duplicates

    batch = spark.createDataFrame([("n", "1", "v"), ("m", "2", "v")], "document_id string, survey_number string, village string")
    stored = spark.createDataFrame([("a", "1", "v", 1), ("a", "1", "v", 2), ("b", "1", "v", 1), ("b", "9", "v", 2), ("c", "3", "v", 1), ("c", "2", "v", 2)],
                                   "document_id string, survey_number string, village string, batch int")
    got = duplicates.find_duplicates_incremental(batch, stored, version=F.col("batch")).collect()
    assert {r.document_id: r.match_count for r in got} == {"n": 1, "m": 1}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_dealt_before_they_are_sorted(spark):
    rows = [(k, n, f"{v}{i}") for i in range(300) for k, n, v in (("a", "area", "x"), (None, "village", "y"), (f"k{i}", "owner_name", "z"))]
    rows += [("a", "owner_name", None), ("b", "other", "q"), ("b", None, "q")]
    df = spark.createDataFrame(rows, "record_id string, field_name string, value string").repartition(7)
    wide = joins.to_wide(df, names=("area", "village", "owner_name"))
    plan = plan_of(wide)
    assert plan.rindex("SortAggregate") < plan.rindex("Exchange hashpartitioning(record_id")
    want = {("a", "x99", None, None), (None, None, "y99", None), ("b", None, None, None)} | {(f"k{i}", None, None, f"z{i}") for i in range(300)}
    assert {tuple(r) for r in wide.collect()} == want and wide.count() == len(want)


def test_grouped_children_are_not_dealt_again(spark):
    records = spark.createDataFrame([("r1", "d1"), ("r1", "d1"), ("r2", "d2"), ("r3", None), (None, "d1")], "record_id string, document_id string")
    fields = spark.createDataFrame([("r1", f"f{i}", "v") for i in range(25)] + [("r2", "f", "v"), (None, "f", "v")], "record_id string, field_name string, value string")
    issues = spark.createDataFrame([("r2", f"R{i}", None, "FAIL", "ERROR", "m") for i in range(12)], "record_id string, rule_id string, field_name string, status string, severity string, message string")
    docs = spark.createDataFrame([("d1", "a.pdf"), ("d2", "b.pdf")], "id string, file_name string")
    out = joins.record_detail(records, fields, issues, docs, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(joins.record_detail(records, fields, issues, docs, 5)).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = max(i for i, x in enumerate(lines) if "partial_collect_list" in x)
    depth, above = len(lines[at]), []
    for line in reversed(lines[:at + 1]):  # from an aggregate up to the root
        inner = len(line) - len(line.lstrip(" :+-"))
        if inner < depth:
            depth = inner
            above.append(line)
    assert sum("Exchange" in x for x in above) == 1
    rows = out.collect()
    assert out.columns == ["document_id", "record_id", "part", "extracted_fields", "validation", "document"]
    found = {}
    for r in rows:
        at = found.setdefault(r.record_id, [0, 0, 0])
        at[0], at[1], at[2] = at[0] + 1, at[1] + len(r.extracted_fields), at[2] + len(r.validation)
        assert r.record_id in ("r3", None) or r.extracted_fields or r.validation
    assert found["r1"][1:] == [50, 0] and found["r2"][1:] == [1, 12] and found["r3"] == [1, 0, 0] and found[None] == [1, 0, 0]
    assert {r.document.file_name if r.document else None for r in rows if r.record_id in ("r2", "r3")} == {"b.pdf", None}


def large(reference):
    """The reference with lookups that are not broadcast."""
    return replace(reference, small=dict.fromkeys(reference.small, False))


def test_lookups_of_a_large_reference_do_not_parse_again(spark, tmp_path, monkeypatch):
    seen, hot_keys = [], skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, *args: seen.append(plan_of(df)) or hot_keys(df, *args))
    ocr, responses, _ = batch(spark, arrivals(spark, range(12)))

    def prepared(reference, name):
        return process.prepare_batch(ocr, responses, reference, spark.createDataFrame([], "document_id string, survey_number string, village string"), str(tmp_path / name))

    small, got = prepared(demo(spark), "small"), prepared(large(demo(spark)), "large")
    assert len(seen) == 3 and not any("raw_text" in p for p in seen)
    columns = [c for c in small.columns if c not in ("fields", "originals", "dropped", "metadata")]
    rows = [sorted(map(str, df.select(*columns, F.map_entries("fields"), F.map_entries("metadata")).collect())) for df in (small, got)]
    assert rows[0] == rows[1] and len(rows[0]) == 12


def test_stored_texts_of_responses_are_not_carried_along(spark, tmp_path):
    ocr, responses, _ = batch(spark, arrivals(spark, range(3)))
    process.prepare_batch(ocr, responses, demo(spark), spark.createDataFrame([], "document_id string, survey_number string, village string"), str(tmp_path / "b"))
    assert not {"raw_text", "values"} & set(spark.read.parquet(str(tmp_path / "b" / "checked")).columns)


def test_a_batch_is_joined_with_the_tables_once(spark, tmp_path):
    ocr, responses, tables = batch(spark, arrivals(spark, range(6)))
    out = process.process_batch(ocr, responses, demo(spark), tables, NOW, str(tmp_path / "b"))
    assert "Join" not in plan_of(out["outcomes"]) and out["outcomes"].count() == 6


def test_duplicate_message_is_not_built_inside_a_lambda(spark):
    rows = spark.createDataFrame([(1, "1", "v", 2), (2, "1", "v", 0), (3, None, "v", None)], "id int, survey_number string, village string, match_count long")
    none = F.array().cast(f"array<{ISSUE}>")
    listed = rows.withColumn("issues", F.when(F.col("id") == 1, F.array(F.lit(None).cast(ISSUE))).when(F.col("id") == 2, none))
    found = duplicates.add_duplicate_issue(listed)
    assert [r.n for r in found.select(F.transform("issues", lambda i: i["rule_id"]).alias("n")).collect()] == [["DUP_CANDIDATE_001"], [], None]
    assert "filter(concat(" not in found._jdf.queryExecution().optimizedPlan().toString()
