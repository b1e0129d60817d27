"""Rules, normalisation and coercion against literal cases."""

import pytest
from pyspark.sql import functions as F

from recordlake.functions import normalize as nz
from recordlake.functions import text as tx
from recordlake.operators import duplicates, rules
from recordlake.operators import reference as rf
from recordlake.schemas import FIELD_NAMES, REQUIRED_FIELDS

VALID = dict(zip(FIELD_NAMES, [
    "Ramesh Kumar", "Suresh Kumar", "145/2", "78", "123", "2.45", "hectare", "Demo Village", "Demo Tehsil", "Demo District",
    "Agricultural", "M-2024-0091", None, "2024-03-15"]))
SCHEMA = "record_id string, document_id string, " + ", ".join(f"{n} string" for n in FIELD_NAMES)


def records(spark, *changes):
    return spark.createDataFrame(
        [(str(i), str(i), *{**VALID, **c}.values()) for i, c in enumerate(changes)], SCHEMA)


def demo(spark):
    return rf.reference_from_names(spark, [("Demo Village", "Demo Tehsil", "Demo District")], "v1", "demo-seed")


def run(spark, change, reference="demo"):
    ref = demo(spark) if reference == "demo" else reference
    row = rules.validate(records(spark, change), ref).select(
        "issues", rules.record_verdict(F.col("issues")).alias("verdict")).first()
    return [i.rule_id for i in row.issues], row.verdict


@pytest.mark.parametrize("change,ids,verdict", [
    ({}, [], "READY_FOR_APPROVAL"),
    ({"owner_name": None}, ["REQ_OWNER_NAME_001"], "REVIEW_REQUIRED"),
    ({"survey_number": "  "}, ["REQ_SURVEY_NUMBER_001"], "REVIEW_REQUIRED"),
    ({"area_unit": None}, ["REQ_AREA_UNIT_001"], "REVIEW_REQUIRED"),
    ({"area": "abc"}, ["FMT_AREA_001"], "BLOCKED"),
    ({"area": "0"}, ["FMT_AREA_002"], "BLOCKED"),
    ({"area": "-3"}, ["FMT_AREA_002"], "BLOCKED"),
    ({"area": "0.00"}, ["FMT_AREA_002"], "BLOCKED"),
    ({"area_unit": "bigha"}, ["FMT_UNIT_001"], "REVIEW_REQUIRED"),
    ({"record_date": "sometime last year"}, ["FMT_DATE_001"], "REVIEW_REQUIRED"),
    ({"record_date": "2024-02-30"}, [], "READY_FOR_APPROVAL"),
    ({"village": "Nowhere"}, ["REF_VILLAGE_001"], "REVIEW_REQUIRED"),
    ({"tehsil": "Wrong Tehsil"}, ["REF_TEHSIL_001", "REF_GEO_CHAIN_001"], "REVIEW_REQUIRED"),
])
def test_rules(spark, change, ids, verdict):
    assert run(spark, change) == (ids, verdict)


def test_without_reference(spark):
    assert run(spark, {}, None) == (["REF_DATA_001"], "READY_FOR_APPROVAL")


def test_strict_dates(spark):
    df = records(spark, {"record_date": "2024-02-30"})
    checks = rules.required_rules() + rules.format_rules(strict_dates=True)
    assert [i.rule_id for i in rules.validate(df, demo(spark), checks).first().issues] == ["FMT_DATE_001"]


def test_bad_record_in_order(spark):
    bad = {"owner_name": None, "area": "0", "area_unit": "bigha", "tehsil": "Wrong Tehsil", "record_date": "99/99/2024"}
    df = rules.validate(records(spark, bad, {}), demo(spark))
    out = duplicates.add_duplicate_issue(duplicates.find_duplicates(df)).filter("record_id = '0'").first()
    assert [i.rule_id for i in out.issues] == [
        "REQ_OWNER_NAME_001", "FMT_AREA_002", "FMT_UNIT_001", "FMT_DATE_001", "REF_TEHSIL_001", "REF_GEO_CHAIN_001", "DUP_CANDIDATE_001"]


def test_pass_rows_on_request(spark):
    out = rules.validate(records(spark, {}), demo(spark), include_passed=True).first().issues
    assert {i.status for i in out} == {"PASS"} and len(out) == 16


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_normalisation(spark):
    assert values(spark, tx.normalize_text, ["  Ramesh   Kumar ", "a \tb", None, " "]) == ["Ramesh Kumar", "a b", None, ""]
    assert values(spark, lambda c: nz.parse_area(c)["value"], ["2,450 ", "2,45,000", " 1 2 . 5 ", "abc ", "", None]) == [
        "2450", "245000", "12.5", "abc", None, None]
    assert values(spark, nz.normalize_unit, ["Hectares", "HA", " sq   meter", "bigha ", None]) == ["hectare", "hectare", "sqm", "bigha", None]
    assert values(spark, nz.normalize_date, ["15-03-2024", "5/3/2024", "15.03.2024", "2024-3-5", " x ", "15-03/2024", "31-02-2024"]) == [
        "2024-03-15", "2024-03-05", "2024-03-15", "2024-03-05", "x", "15-03/2024", "31-02-2024"]


def test_normalize_record_is_idempotent_and_keeps_originals(spark):
    once = nz.normalize_record(records(spark, {"owner_name": "  A  B ", "area": "2,450"}))
    assert once.first().originals == {"owner_name": "  A  B ", "area": "2,450"}
    assert nz.normalize_record(once.drop("originals")).first().originals == {}


def test_coercion(spark):
    dates = ["2024-03-15", "1900-01-01", "99/99/2024", "2024-02-30", "14/03/2024", "unknown", "", None]
    got = values(spark, nz.coerce_record_date, dates)
    assert [(str(r.value) if r.value else None, r.dropped) for r in got] == [
        ("2024-03-15", False), ("1900-01-01", False), (None, True), (None, True), (None, True), (None, True), (None, False), (None, False)]
    areas = ["2.45", "0", "1234567.89", "-3", "two and a half", "2.5 hectare", "NaN", "Infinity", " ", None]
    got = values(spark, nz.coerce_area, areas)
    assert [(float(r.value) if r.value is not None else None, r.dropped) for r in got] == [
        (2.45, False), (0.0, False), (1234567.89, False), (-3.0, False), (None, True), (None, True), (None, True), (None, True), (None, False), (None, False)]


def test_quoted(spark):
    assert values(spark, tx.quoted, ["a", "it's", "it's \"x\"", "a\\b"]) == [repr(x) for x in ["a", "it's", "it's \"x\"", "a\\b"]]


def test_large_reference_takes_the_salted_path(spark):
    ref = demo(spark)
    big = rf.Reference(ref.version, ref.source, ref.levels, dict.fromkeys(rf.LEVELS, False))
    rows = records(spark, *[{"village": v} for v in ("Demo Village", "demo village ", "Nowhere", None)])
    got = {r.record_id: r.village_known for r in rf.reference_membership(rows, big, "village").collect()}
    assert got == {"0": True, "1": True, "2": False, "3": False}


def test_same_name_under_two_parents(spark):
    rows = spark.createDataFrame([
        ("T1", "tehsil", "T1", "North", None, "v1", "active"), ("T2", "tehsil", "T2", "South", None, "v1", "active"),
        ("V1", "village", "V1", "Twin", "T1", "v1", "active"), ("V2", "village", "V2", "twin", "T2", "v1", "active"),
        ("V3", "village", "V3", "Odd", "V1", "v1", "active"), ("V4", "village", "V4", "Gone", "T1", "v1", "inactive"),
    ], "id string, reference_type string, code string, name string, parent_id string, version string, status string")
    level = {r.key: r.parent for r in rf.build_reference(rows).levels["village"].collect()}
    assert level == {"twin": "south", "odd": None}
    assert rf.ambiguous_names(rows).count() == 1


def test_bits_tell_what_the_findings_tell(spark):
    df = records(spark, {}, {"owner_name": " "}, {"area": "-3", "area_unit": None}, {"area": "x", "village": "Nowhere"}, {"district": "Elsewhere", "record_date": "soon"})
    for reference in (None, demo(spark)):
        checks = rules.rule_set(reference)
        bits = rules.with_findings(df, checks, reference)
        b = F.col("findings")
        got = bits.select("record_id", rules.verdict_of(b, checks).alias("verdict"), rules.rule_ids_of(b, checks).alias("ids"),
                          rules.count_of(b, checks).alias("n"), rules.count_of(b, checks, lambda r: r.blocking).alias("hard")).collect()
        full = rules.validate(df, reference)
        i = F.col("issues")
        want = full.select("record_id", rules.record_verdict(i).alias("verdict"), F.transform(i, lambda x: x["rule_id"]).alias("ids"),
                           F.size(i).alias("n"), F.size(F.filter(i, lambda x: x["severity"] == "ERROR")).alias("hard")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.n for r in got) > 5
        sums = {r.severity: r.n for r in rules.severities_of(bits, checks).collect()}
        assert sums == {r.severity: r["count"] for r in rules.explode_issues(full).groupBy("severity").count().collect()}
    with pytest.raises(ValueError):
        rules.with_findings(df, checks * 5)


def test_a_single_rule_needs_its_lookup_only(spark):
    df = records(spark, {"village": "Nowhere"}, {})
    one = rules.validate(df, demo(spark), only=("REF_VILLAGE_001",))
    assert [[i.rule_id for i in r.issues] for r in one.orderBy(F.size("issues").desc()).collect()] == [["REF_VILLAGE_001"], []]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_rules_are_not_judged_inside_a_lambda(spark):
    df = spark.createDataFrame([("1",) + (None,) * len(FIELD_NAMES)], "record_id string, " + ", ".join(f"{n} string" for n in FIELD_NAMES))
    out = rules.validate(df, messages=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(CASE WHEN" not in plan  # the lambda of array_compact around all conditions
    assert [i.rule_id for i in out.first().issues] == [f"REQ_{n.upper()}_001" for n in REQUIRED_FIELDS] + ["REF_DATA_001"]
