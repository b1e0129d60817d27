"""Normalisation, rules, reference, duplicates, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake import schemas
from recordlake.functions import labels
from recordlake.functions import normalize as nz
from recordlake.functions import text as tx
from recordlake.operators import aggregates as agg
from recordlake.operators import constraints as cs
from recordlake.operators import duplicates as dup
from recordlake.operators import joins, rules
from recordlake.operators import reference as rf

from . import views as v
from .registry import check


def judged(spark: SparkSession, d: str, messages: bool = False) -> DataFrame:
    """Records with all issues and their verdict."""
    found = dup.add_duplicate_issue(dup.find_duplicates(v.validated(spark, d, messages)), messages)
    return found.withColumn("verdict", rules.record_verdict(F.col("issues")))


def with_bits(spark: SparkSession, d: str) -> tuple[DataFrame, list[rules.Rule]]:
    """Records with a bit for every rule that found something, their verdict, and the rules."""
    reference = v.reference(spark, d)
    checks = [*rules.rule_set(reference), dup.duplicate_rule()]
    bits = rules.with_findings(dup.find_duplicates(v.normalized(spark, d)), checks, reference)
    return bits.withColumn("verdict", rules.verdict_of(F.col("findings"), checks)), checks


@check("v19_verdict_by_district", """
SELECT district, verdict, count(*) AS records, CAST(sum(issues) AS BIGINT) AS issues FROM verdicts GROUP BY district, verdict""", "verdicts")
def _(spark, d):
    records, checks = with_bits(spark, d)
    return records.groupBy("district", "verdict").agg(
        F.count("*").alias("records"), F.sum(rules.count_of(F.col("findings"), checks)).cast("bigint").alias("issues"))


@check("v19_record_verdict", "SELECT record_id, verdict, verdict <> 'READY_FOR_APPROVAL' AS blocked FROM verdicts", "verdicts")
def _(spark, d):
    return judged(spark, d).select("record_id", "verdict", rules.approval_blocked(F.col("issues")).alias("blocked"))


@check("v19_rule_bits", "SELECT record_id, verdict, rules, issues FROM verdicts", "verdicts")
def _(spark, d):
    records, checks = with_bits(spark, d)
    bits = F.col("findings")
    return records.select("record_id", "verdict", F.array_join(rules.rule_ids_of(bits, checks), ",").alias("rules"),
                          rules.count_of(bits, checks).cast("bigint").alias("issues"))


@check("u2_issue_order", "SELECT record_id, rules, issues FROM verdicts", "verdicts")
def _(spark, d):
    return judged(spark, d).select(
        "record_id", F.array_join(F.transform("issues", lambda i: i["rule_id"]), ",").alias("rules"),
        F.size("issues").cast("bigint").alias("issues"))


@check("n51_issue_messages", "SELECT record_id, rule_id, field_name, status, severity, message FROM r_all", "r_all")
def _(spark, d):
    return rules.explode_issues(judged(spark, d, messages=True), "record_id")


_RULES = {
    "v1_req_owner_name": "REQ_OWNER_NAME_001", "v2_req_survey_number": "REQ_SURVEY_NUMBER_001", "v3_req_area": "REQ_AREA_001",
    "v4_req_village": "REQ_VILLAGE_001", "v5_req_tehsil": "REQ_TEHSIL_001", "v6_req_district": "REQ_DISTRICT_001",
    "v7_req_area_unit": "REQ_AREA_UNIT_001", "v8_fmt_area_text": "FMT_AREA_001", "v9_fmt_area_sign": "FMT_AREA_002",
    "v10_fmt_unit": "FMT_UNIT_001", "v11_fmt_date": "FMT_DATE_001", "v13_ref_village": "REF_VILLAGE_001",
    "v14_ref_tehsil": "REF_TEHSIL_001", "v15_ref_district": "REF_DISTRICT_001", "v16_geo_chain_tehsil": "REF_GEO_CHAIN_001",
    "v17_geo_chain_district": "REF_GEO_CHAIN_002", "v18_dup_candidate": "DUP_CANDIDATE_001",
}


def _rule_check(name: str, rule_id: str) -> None:
    @check(name, f"""SELECT district, count(*) AS findings, count(DISTINCT r.message) AS messages
FROM r_all r JOIN n_records USING (record_id) WHERE rule_id = '{rule_id}' GROUP BY district""", "r_all n_records")
    def _(spark, d):
        if rule_id == "DUP_CANDIDATE_001":
            rows = dup.find_duplicates(v.normalized(spark, d)).withColumn("issues", F.array_compact(F.array(dup.duplicate_issue())))
        else:
            rows = v.validated(spark, d, only=(rule_id,))
        return rules.explode_issues(rows, "district").groupBy("district").agg(
            F.count("*").alias("findings"), F.count_distinct("message").alias("messages"))


for _name, _rule in _RULES.items():
    _rule_check(_name, _rule)


@check("v12_no_reference", """
SELECT rule_id, status, severity, count(*) AS n FROM (SELECT rule_id, status, severity FROM r_issues WHERE pos < 20
UNION ALL SELECT 'REF_DATA_001', 'NOT_CHECKED', 'INFO' FROM n_records) GROUP BY ALL""", "r_issues n_records")
def _(spark, d):
    found = rules.explode_issues(rules.validate(v.normalized(spark, d)), "record_id")
    return found.groupBy("rule_id", "status", "severity").agg(F.count("*").alias("n"))


@check("v20_review_needed", """
SELECT v.record_id, v.verdict <> 'READY_FOR_APPROVAL' OR coalesce(f.low, 0) > 0 AS needed FROM verdicts v
LEFT JOIN (SELECT record_id, count(*) AS low FROM v_fields WHERE confidence < 0.65 GROUP BY record_id) f USING (record_id)""", "verdicts v_fields")
def _(spark, d):
    low = v.fields(spark, d).filter("confidence < 0.65").groupBy("record_id").agg(F.collect_set("field_name").alias("low"))
    both = judged(spark, d).join(low, "record_id", "left")
    return both.select("record_id", rules.review_needed(F.col("verdict"), F.col("low")).alias("needed"))


@check("v21_approval_blockers", """
SELECT n.record_id, coalesce(b.names, '') || CASE WHEN b.names IS NOT NULL AND m.names IS NOT NULL THEN '; ' ELSE '' END || coalesce(m.names, '')
  || CASE WHEN t.open > 0 THEN CASE WHEN b.names IS NOT NULL OR m.names IS NOT NULL THEN '; ' ELSE '' END || 'reviews still open: ' || CAST(t.open AS VARCHAR) ELSE '' END AS blockers
FROM n_records n
LEFT JOIN (SELECT record_id, string_agg('finding blocks approval: ' || rule_id, '; ' ORDER BY rule_id) AS names FROM r_all
  WHERE status = 'FAIL' OR severity IN ('ERROR', 'CRITICAL') GROUP BY record_id) b USING (record_id)
LEFT JOIN (SELECT record_id, string_agg('required value is blank: ' || field_name, '; ' ORDER BY pos) AS names FROM r_all WHERE pos < 6 GROUP BY record_id) m USING (record_id)
LEFT JOIN (SELECT land_record_id AS record_id, count(*) AS open FROM v_tasks WHERE status IN ('PENDING', 'IN_REVIEW') GROUP BY 1) t USING (record_id)""",
       "n_records r_all v_tasks")
def _(spark, d):
    from recordlake.operators.state import open_task_counts

    rows = judged(spark, d).join(open_task_counts(v.tasks(spark, d)), "record_id", "left")
    return rows.select("record_id", F.array_join(
        rules.approval_blockers(F.col("issues"), F.coalesce("_open", F.lit(0))), "; ").alias("blockers"))


@check("v22_map_verdict", """
SELECT record_id, CASE WHEN verdict = 'READY_FOR_APPROVAL' THEN verdict ELSE 'REVIEW_REQUIRED' END AS record_status,
  CASE verdict WHEN 'BLOCKED' THEN 'VALIDATION_FAILED' ELSE verdict END AS document_status,
  CASE verdict WHEN 'BLOCKED' THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  'Sent to review: verdict ' || verdict || ', findings: ' || CAST(issues AS VARCHAR) AS reason FROM verdicts""", "verdicts")
def _(spark, d):
    return judged(spark, d).select("record_id", rules.map_verdict(F.col("verdict"), F.size("issues")).alias("m")).select("record_id", "m.*")


@check("v23_check_payload", """
SELECT record_id, CASE WHEN k % 47 = 0 THEN '22023' WHEN k % 29 = 0 THEN '22023' WHEN k % 7 = 0 AND verdict <> 'READY_FOR_APPROVAL' THEN '23514'
  WHEN k % 11 = 0 AND verdict <> 'READY_FOR_APPROVAL' THEN '22023' END AS code FROM verdicts""", "verdicts")
def _(spark, d):
    rows = judged(spark, d).withColumn("o", rules.map_verdict(F.col("verdict"), F.size("issues")))
    k = F.col("record_id").cast("long")
    status = F.when(k % 29 == 0, "EXTRACTED").when(k % 7 == 0, "READY_FOR_APPROVAL").otherwise(F.col("o.document_status"))
    reason = F.when(k % 11 == 0, " ").otherwise(F.col("o.reason"))
    pages = F.when(k % 47 == 0, 0).otherwise(1)
    return rows.select("record_id", rules.check_payload(F.col("verdict"), status, pages, F.col("o.priority"), reason).alias("code"))


# Normalisation ------------------------------------------------------------------------------------------------------

@check("f1_is_blank", """
SELECT record_id, coalesce(trim(owner_name), '') = '' AS no_owner, coalesce(trim(village), '') = '' AS no_village FROM v_records""", "v_records")
def _(spark, d):
    return v.records(spark, d).select(
        "record_id", tx.is_blank(F.col("owner_name")).alias("no_owner"), tx.is_blank(F.col("village")).alias("no_village"))


@check("n1_normalize_text", r"SELECT record_id, trim(regexp_replace(owner_name, '\s+', ' ', 'g')) AS owner FROM v_records", "v_records")
def _(spark, d):
    return v.records(spark, d).select("record_id", tx.normalize_text(F.col("owner_name")).alias("owner"))


@check("n1_normalize_documents", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@check("n2_parse_area", r"SELECT record_id, area AS value, coalesce(regexp_full_match(area, '-?\d[\d,]*(\.\d+)?'), false) AS numeric FROM n_records", "n_records")
def _(spark, d):
    return v.records(spark, d).select("record_id", nz.parse_area(F.col("area")).alias("p")).select("record_id", "p.*")


@check("n3_normalize_unit", "SELECT record_id, area_unit FROM n_records", "n_records")
def _(spark, d):
    return v.records(spark, d).select("record_id", nz.normalize_unit(F.col("area_unit")).alias("area_unit"))


@check("n4_normalize_date", "SELECT record_id, record_date FROM n_records", "n_records")
def _(spark, d):
    return v.records(spark, d).select("record_id", nz.normalize_date(F.col("record_date")).alias("record_date"))


_CHANGED = "\nUNION ALL\n".join(
    f"SELECT r.record_id, {i} AS pos, '{n}' AS name, r.{n} AS raw FROM v_records r JOIN n_records n USING (record_id) WHERE r.{n} IS DISTINCT FROM n.{n}"
    for i, n in enumerate(schemas.FIELD_NAMES))


@check("n5_normalize_record", f"""
SELECT n.record_id, {', '.join('n.' + f for f in schemas.FIELD_NAMES)}, coalesce(o.originals, '') AS originals
FROM n_records n LEFT JOIN (SELECT record_id, string_agg(name || '=' || raw, '|' ORDER BY pos) AS originals FROM ({_CHANGED}) GROUP BY record_id) o USING (record_id)""",
       "n_records v_records")
def _(spark, d):
    kept = F.array_join(F.transform(F.map_entries("originals"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return v.normalized(spark, d).select("record_id", *schemas.FIELD_NAMES, kept.alias("originals"))


@check("n11_coerce_record_date", r"""
SELECT record_id, strftime(CASE WHEN regexp_full_match(record_date, '\d{4}-\d{2}-\d{2}') THEN try_strptime(record_date, '%Y-%m-%d') END, '%Y-%m-%d') AS stored,
  NOT regexp_full_match(record_date, '\d{4}-\d{2}-\d{2}') AS dropped FROM n_records""", "n_records")
def _(spark, d):
    s = nz.coerce_record_date(F.col("record_date"))
    return v.normalized(spark, d).select("record_id", s["value"].cast("string").alias("stored"), s["dropped"].alias("dropped"))


@check("n12_coerce_area", """
SELECT record_id, CAST(TRY_CAST(area AS DECIMAL(38,10)) AS DOUBLE) AS stored, TRY_CAST(area AS DECIMAL(38,10)) IS NULL AS dropped FROM n_records""", "n_records")
def _(spark, d):
    s = nz.coerce_area(F.col("area"))
    return v.normalized(spark, d).select("record_id", s["value"].cast("double").alias("stored"), s["dropped"].alias("dropped"))


@check("n13_coerce_typed_columns", r"""
SELECT record_id, CAST(TRY_CAST(area AS DECIMAL(38,10)) AS DOUBLE) AS area, CASE WHEN record_date <> '99/99/2024' THEN record_date END AS record_date,
  concat_ws('|', CASE WHEN record_date = '99/99/2024' THEN 'record_date=99/99/2024' END, CASE WHEN area = 'abc' THEN 'area=abc' END) AS dropped FROM n_records""", "n_records")
def _(spark, d):
    lost = F.array_join(F.transform(F.map_entries("dropped"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return nz.coerce_typed_columns(v.normalized(spark, d)).select(
        "record_id", F.col("area").cast("double").alias("area"), F.col("record_date").cast("string").alias("record_date"), lost.alias("dropped"))


@check("n14_match_keys", r"""
SELECT record_id, coalesce(lower(trim(owner_name)), '') AS rules_key, coalesce(lower(trim(regexp_replace(owner_name, '\s+', ' ', 'g'))), '') AS compare_key FROM v_records""", "v_records")
def _(spark, d):
    return v.records(spark, d).select(
        "record_id", tx.rules_key(F.col("owner_name")).alias("rules_key"), tx.compare_key(F.col("owner_name")).alias("compare_key"))


@check("n15_empty_to_null", "SELECT record_id, nullif(village, '') AS village FROM v_records", "v_records")
def _(spark, d):
    return v.records(spark, d).select("record_id", tx.empty_to_null(F.col("village")).alias("village"))


@check("f3_escape_like", r"""SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_')) AS escaped FROM documents""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(tx.escape_like(F.col("text"))).alias("escaped"))


@check("f13_to_long", "\nUNION ALL\n".join(f"SELECT record_id, '{n}' AS field_name, {n} AS value FROM v_records" for n in schemas.FIELD_NAMES), "v_records")
def _(spark, d):
    return joins.to_long(v.records(spark, d))


@check("f13_to_wide", "SELECT record_id, " + ", ".join(schemas.FIELD_NAMES) + " FROM v_records", "v_records")
def _(spark, d):
    return joins.to_wide(joins.to_long(v.records(spark, d)))


@check("n48_record_labels", """
SELECT record_id, coalesce(nullif(survey_number, ''), nullif(khasra_number, ''), nullif(khata_number, ''), 'Unidentified parcel') AS label,
  coalesce(nullif(mutation_number, ''), 'none') AS mutation,
  coalesce('Mutation ' || nullif(mutation_number, ''), 'Cadastral record') AS kind, concat_ws(' · ', nullif(village, ''), nullif(tehsil, '')) AS location FROM v_records""", "v_records")
def _(spark, d):
    c = F.col
    return v.records(spark, d).select(
        "record_id", labels.record_label(c("survey_number"), c("khasra_number"), c("khata_number")).alias("label"),
        F.coalesce("mutation_number", F.lit("none")).alias("mutation"),
        labels.record_type(F.lit(""), c("mutation_number")).alias("kind"), labels.record_location(c("village"), c("tehsil")).alias("location"))


@check("a31_populated_attributes", """
SELECT record_id, (owner_name IS NOT NULL AND owner_name <> '')::INT + (area <> '')::INT + (land_classification <> '')::INT AS populated FROM v_records""", "v_records")
def _(spark, d):
    c = F.col
    return v.records(spark, d).select(
        "record_id", labels.populated_attributes(c("owner_name"), c("area"), c("land_classification")).alias("populated"))


# Reference ----------------------------------------------------------------------------------------------------------

@check("f7_active_reference", "SELECT id, name FROM v_reference WHERE status = 'active'", "v_reference")
def _(spark, d):
    return rf.active_reference(v.reference_rows(spark, d)).select("id", "name")


@check("j4_reference_membership", """
SELECT record_id, EXISTS (SELECT 1 FROM v_reference f WHERE f.reference_type = 'village' AND f.status = 'active' AND lower(f.name) = lower(n.village)) AS village_known,
  EXISTS (SELECT 1 FROM v_reference f WHERE f.reference_type = 'tehsil' AND f.status = 'active' AND lower(f.name) = lower(n.tehsil)) AS tehsil_known,
  EXISTS (SELECT 1 FROM v_reference f WHERE f.reference_type = 'district' AND f.status = 'active' AND lower(f.name) = lower(n.district)) AS district_known
FROM n_records n""", "n_records v_reference")
def _(spark, d):
    return rf.with_reference(v.normalized(spark, d), v.reference(spark, d)).select(
        "record_id", "village_known", "tehsil_known", "district_known")


@check("j5_build_reference", """
SELECT c.reference_type AS level, lower(c.name) AS key, lower(p.name) AS parent FROM v_reference c
LEFT JOIN v_reference p ON p.id = c.parent_id WHERE c.status = 'active'""", "v_reference")
def _(spark, d):
    ref = v.reference(spark, d)
    out = None
    for level, lookup in ref.levels.items():
        part = lookup.select(F.lit(level).alias("level"), "key", "parent")
        out = part if out is None else out.unionByName(part)
    return out


@check("j5_ambiguous_names", """
SELECT 'village' AS reference_type, 'plot ' || CAST(c_custkey % 40 AS VARCHAR) AS key, count(DISTINCT c_nationkey) AS parents
FROM customer GROUP BY ALL HAVING count(DISTINCT c_nationkey) > 1""")
def _(spark, d):
    rows = v.table(spark, d, "customer").select(
        F.lit("village").alias("reference_type"), F.concat(F.lit("Plot "), F.col("c_custkey") % 40).alias("name"),
        F.col("c_nationkey").cast("string").alias("parent_id"), F.lit("active").alias("status"))
    return rf.ambiguous_names(rows)


@check("j6_geo_chain", """
SELECT n.record_id, coalesce(bool_or(r.rule_id = 'REF_GEO_CHAIN_001'), false) AS tehsil_conflict, coalesce(bool_or(r.rule_id = 'REF_GEO_CHAIN_002'), false) AS district_conflict
FROM n_records n LEFT JOIN r_issues r USING (record_id) GROUP BY n.record_id""", "n_records r_issues")
def _(spark, d):
    return rf.check_geo_chain(v.normalized(spark, d), v.reference(spark, d)).select("record_id", "tehsil_conflict", "district_conflict")


# Duplicates ---------------------------------------------------------------------------------------------------------

@check("j7_find_duplicates", """
SELECT record_id, match_count, CASE WHEN match_count > 0 THEN 'POSSIBLE_DUPLICATE' ELSE 'NO_MATCH' END AS duplicate_check FROM d_records""", "d_records")
def _(spark, d):
    return dup.find_duplicates(v.normalized(spark, d)).select("record_id", "match_count", "duplicate_check")


@check("j7_hot_keys", """
SELECT record_id, CASE WHEN coalesce(land_classification, '') <> '' AND coalesce(district, '') <> '' THEN count(*) OVER (PARTITION BY lower(land_classification), lower(district)) - 1 END AS match_count FROM n_records""", "n_records")
def _(spark, d):
    # A few keys that each hold a large share of all rows: every group takes the path for hot keys.
    coarse = v.normalized(spark, d).withColumns({"survey_number": F.col("land_classification"), "village": F.col("district")})
    return dup.find_duplicates(coarse, hot_rows=50).select("record_id", "match_count")


@check("j8_incremental", """
SELECT b.record_id, CAST((SELECT count(*) FROM n_records e WHERE e.k % 4 <> 1 AND e.record_id <> b.record_id AND lower(e.survey_number) = lower(b.survey_number)
  AND lower(e.village) = lower(b.village) AND b.village <> '') AS BIGINT) AS match_count FROM n_records b WHERE b.k % 4 IN (0, 1)""", "n_records")
def _(spark, d):
    rows = v.normalized(spark, d)
    k = F.col("record_id").cast("long") % 4
    # Half of the batch is new, half was stored before.
    return dup.find_duplicates_incremental(rows.filter(k.isin(0, 1)), rows.filter(k != 1)).select("record_id", "match_count")


@check("j8_incremental_within_batch", """
SELECT b.record_id, CAST(CASE WHEN coalesce(village, '') <> '' THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS BIGINT) AS match_count
FROM n_records b QUALIFY b.k % 4 IN (0, 1)""", "n_records")
def _(spark, d):
    rows = v.normalized(spark, d)
    k = F.col("record_id").cast("long") % 4
    return dup.find_duplicates_incremental(rows.filter(k.isin(0, 1)), rows.filter(k != 1), within_batch=True, hot_rows=2).select("record_id", "match_count")


@check("a19_duplicate_counts", """
SELECT lower(survey_number) || chr(31) || lower(village) AS duplicate_key, count(*) AS records FROM n_records
WHERE coalesce(village, '') <> '' GROUP BY 1 HAVING count(*) > 1""", "n_records")
def _(spark, d):
    return dup.duplicate_counts(v.normalized(spark, d))


@check("wn3_key_group_size", "SELECT record_id, count(*) OVER (PARTITION BY tehsil) AS group_size FROM n_records", "n_records")
def _(spark, d):
    return dup.key_group_size(v.normalized(spark, d), "tehsil", "record_id", hot_rows=300).select("record_id", "group_size")


# Constraints --------------------------------------------------------------------------------------------------------

@check("c1_domains", """
SELECT id, 'priority' AS column_name, priority AS value FROM v_tasks WHERE priority NOT IN ('LOW', 'MEDIUM', 'HIGH', 'URGENT')""", "v_tasks")
def _(spark, d):
    return cs.check_domains(v.tasks(spark, d), cs.DOMAINS["review_tasks"], "id")


@check("c1_ranges", """
SELECT record_id, 'severity' AS column_name, severity AS value FROM v_issues WHERE severity IS NULL
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_quantity < 2 OR l_quantity > 48""", "v_issues")
def _(spark, d):
    line = v.table(spark, d, "lineitem").withColumn("record_id", F.col("l_orderkey").cast("string"))
    return cs.check_domains(v.issues(spark, d), cs.DOMAINS["validation_results"], "record_id").unionByName(
        cs.check_domains(line, {"l_quantity": cs.in_range(2, 48)}, "record_id"))


@check("c2_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return cs.check_unique(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@check("c3_rows", "SELECT id, 'job_time_order' AS rule FROM v_jobs WHERE completed_us < started_us", "v_jobs")
def _(spark, d):
    return cs.check_rows(v.jobs(spark, d), cs.job_time_order(), "id")


@check("c4_orphan_keys", """
SELECT land_record_id, count(*) AS rows FROM v_tasks WHERE land_record_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY 1""", "v_tasks")
def _(spark, d):
    parent = v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return cs.orphan_keys(v.tasks(spark, d), parent, ("land_record_id", "id"))


@check("j16_orphans", """
SELECT id, land_record_id FROM v_tasks WHERE land_record_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""", "v_tasks")
def _(spark, d):
    parent = v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return cs.orphans(v.tasks(spark, d), parent, ("land_record_id", "id")).select("id", "land_record_id")


@check("u4_failing_rules", """
SELECT record_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS failing FROM v_issues WHERE status = 'FAIL' OR severity IN ('ERROR', 'CRITICAL') GROUP BY record_id""", "v_issues")
def _(spark, d):
    # Line items repeat (record, rule), so the distinct findings are grouped.
    rows = v.issues(spark, d).select("record_id", "rule_id", "status", "severity").distinct()
    arrays = rows.groupBy("record_id").agg(F.collect_list(F.struct("rule_id", "status", "severity")).alias("issues"))
    failing = rules.failing_rules(F.col("issues"))
    return arrays.filter(F.size(failing) > 0).select("record_id", F.array_join(failing, ",").alias("failing"))


@check("a6_verdict_by_record", """
SELECT record_id, CASE WHEN bool_or(status = 'FAIL' OR coalesce(severity IN ('ERROR', 'CRITICAL'), false)) THEN 'BLOCKED'
  WHEN bool_or(coalesce(severity = 'WARNING', false) OR status = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS verdict
FROM v_issues GROUP BY record_id""", "v_issues")
def _(spark, d):
    return rules.verdict_by_record(v.issues(spark, d), "record_id")


@check("a11_severity_histogram", "SELECT severity, count(*) AS n FROM r_all GROUP BY severity", "r_all")
def _(spark, d):
    return rules.severities_of(*with_bits(spark, d))


@check("a13_review_rate", "SELECT avg(CASE WHEN verdict <> 'READY_FOR_APPROVAL' THEN 1.0 ELSE 0.0 END) AS review_rate FROM verdicts", "verdicts")
def _(spark, d):
    return agg.review_rate(with_bits(spark, d)[0])


@check("a29_verdict_summary", """
SELECT count(*) FILTER (verdict = 'READY_FOR_APPROVAL') AS ready, count(*) FILTER (verdict = 'REVIEW_REQUIRED') AS review,
  count(*) FILTER (verdict = 'BLOCKED') AS blocked FROM verdicts""", "verdicts")
def _(spark, d):
    return agg.verdict_summary(with_bits(spark, d)[0])
