"""Stand-in tables derived from the driver tables, in Spark and as SQL text.

``key`` below is the order key. The modulus rules plant blanks, bad numbers, wrong parents and duplicates so that every
operator has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.normalize import normalize_record
from recordlake.functions.text import compare_key
from recordlake.operators.reference import Reference, build_reference
from recordlake.operators.rules import validate
from recordlake.sources.readers import spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(c: Column) -> Column:
    return c.cast("string")


def records(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = spread(table(spark, d, "orders")), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    price = text(F.col("o_totalprice"))

    def every(n: int) -> Column:
        return k % n == 0

    area = (
        F.when(every(19), "abc").when(every(23), "0")
        .when(every(5), F.regexp_replace(price, r"^(\d+)(\d{3})\.", "$1,$2.")).otherwise(price)
    )
    unit = (
        F.when(k % 6 == 0, "hectare").when(k % 6 == 1, "Ha").when(k % 6 == 2, "acres")
        .when(k % 6 == 3, "sq  meter").when(k % 6 == 4, "bigha")
    )
    date = (
        F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(k % 5 == 2, F.date_format(day, "dd/MM/yyyy")).when(k % 5 == 3, F.date_format(day, "dd.MM.yyyy"))
        .otherwise("99/99/2024")
    )
    other_nation = F.concat(F.lit("NATION_"), text((F.col("n_nationkey") + 1) % 25))
    return joined.select(
        text(k).alias("record_id"), text(k).alias("document_id"),
        F.when(every(13), F.lit(None)).when(every(11), F.concat(F.lit("  "), F.col("c_name"), F.lit("  ")))
        .otherwise(F.col("c_name")).alias("owner_name"),
        F.col("c_mktsegment").alias("father_or_spouse_name"),
        F.concat(text(F.col("o_custkey") % 50), F.lit("/"), text(k % 7)).alias("survey_number"),
        text(k % 1000).alias("khasra_number"), text(F.col("o_custkey")).alias("khata_number"),
        area.alias("area"), unit.alias("area_unit"),
        F.when(every(31), "").otherwise(F.col("c_name")).alias("village"),
        F.when(every(17), other_nation).otherwise(F.col("n_name")).alias("tehsil"),
        F.when(every(37), "ASIA").otherwise(F.col("r_name")).alias("district"),
        F.col("c_mktsegment").alias("land_classification"),
        F.when(~every(3), F.concat(F.lit("M-"), text(k))).alias("mutation_number"),
        F.when(every(2), F.concat(F.lit("R"), text(k))).alias("registration_number"),
        date.alias("record_date"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED")
        .otherwise("READY_FOR_APPROVAL").alias("status"),
        day.alias("updated_at"),
    )


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    def level(name: str, kind: str, prefix: str, key: str, label: str, parent: Column) -> DataFrame:
        code = F.concat(F.lit(prefix), text(F.col(key)))
        return table(spark, d, name).select(
            code.alias("id"), F.lit(kind).alias("reference_type"), code.alias("code"), F.col(label).alias("name"),
            parent.cast("string").alias("parent_id"), F.lit("v1").alias("version"),
            F.when(F.col(key) % 29 == 0, "inactive").otherwise("active").alias("status"),
        )

    return (
        level("region", "district", "D", "r_regionkey", "r_name", F.lit(None))
        .unionByName(level("nation", "tehsil", "T", "n_nationkey", "n_name", F.concat(F.lit("D"), text(F.col("n_regionkey")))))
        .unionByName(level("customer", "village", "V", "c_custkey", "c_name", F.concat(F.lit("T"), text(F.col("c_nationkey")))))
    )


def reference(spark: SparkSession, d: str) -> Reference:
    return build_reference(reference_rows(spark, d), "reference_data")


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalize_record(records(spark, d))


def validated(spark: SparkSession, d: str, messages: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    return validate(normalized(spark, d), reference(spark, d), messages=messages, only=only)


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Extracted fields in long form: one row per order and line number."""
    line = table(spark, d, "lineitem")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"), F.min("l_partkey").alias("p"),
        F.min("l_suppkey").alias("s"),
    )
    names = ["owner_name", "survey_number", "area", "village", "tehsil", "district", "record_date"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    return one.select(
        text(F.col("l_orderkey")).alias("record_id"), name.alias("field_name"),
        F.when(F.col("p") % 17 != 0, text(F.col("q"))).alias("value"),
        F.when(F.col("p") % 31 != 0, 1 - F.col("disc") * 4).alias("confidence"),
        F.when(F.col("s") % 3 == 0, F.lit(1)).alias("source_page"),
        F.when(F.col("s") % 5 == 0, F.lit("seen")).when(F.col("s") % 7 == 0, F.lit("")).alias("source_text"),
        F.when(F.col("s") % 11 == 0, F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("bounding_box"),
        F.when(F.col("p") % 17 == 0, "MISSING").otherwise("EXTRACTED").alias("extraction_status"),
    )


def issues(spark: SparkSession, d: str) -> DataFrame:
    """An issue table straight from line items, with statuses and severities the rules do not produce."""
    flag, status, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        text(F.col("l_orderkey")).alias("record_id"),
        F.concat(F.lit("RULE_"), text(n)).alias("rule_id"),
        F.when(n == 7, F.lit(None)).when(n == 1, "owner_name").when(n == 2, "survey_number").otherwise("area").alias("field_name"),
        F.when((n == 6) & (status == "F"), "NOT_CHECKED").when(status == "F", "PASS").when(n <= 2, "FAIL")
        .when(n <= 4, "WARNING").otherwise("REVIEW_REQUIRED").alias("status"),
        F.when(status == "F", "INFO").when(flag == "R", "ERROR").when(flag == "A", "WARNING")
        .when(n == 5, F.lit(None)).otherwise("INFO").alias("severity"),
        F.concat(F.lit("quantity "), text(F.col("l_quantity").cast("int"))).alias("message"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return o.select(
        F.concat(F.lit("K"), text(k)).alias("id"), text(k % 5000).alias("land_record_id"),
        F.when(F.col("o_custkey") % 10 != 0, text(F.col("o_custkey") % 10)).alias("assigned_to"),
        F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "IN_REVIEW").when(k % 4 == 2, "COMPLETED").otherwise("CANCELLED").alias("status"),
        F.when(p == "1-URGENT", "URGENT").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM")
        .when(p == "5-LOW", "LOW").otherwise("NOT SPECIFIED").alias("priority"),
        F.concat(F.lit("Reason "), text(k % 100)).alias("reason"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(k % 4 == 2, (F.col("o_orderdate") + F.expr("interval 36 hours")).cast("timestamp")).alias("completed_at"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind, start = F.col("event_type"), F.col("ts").cast("timestamp")
    micros = F.unix_micros(start)
    status = (
        F.when(kind == "view", "SUCCEEDED").when(kind == "purchase", "RUNNING").when(kind == "signup", "PENDING")
        .when(kind == "error", "FAILED").otherwise("CANCELLED")
    )
    # A few jobs end before they start, and pending ones have not started.
    seconds = F.when(F.col("event_id") % 41 == 0, -F.col("value")).otherwise(F.col("value"))
    return e.select(
        text(F.col("event_id")).alias("id"), text(F.col("user_id")).alias("document_id"), status.alias("status"),
        F.lit("v1").alias("pipeline_version"),
        F.when(kind != "signup", start).alias("started_at"),
        F.when(kind.isin("view", "error", "click"), F.timestamp_micros(micros + F.round(seconds * 1000000).cast("long"))).alias("completed_at"),
        F.when(kind == "error", F.element_at(
            F.array(*[F.lit(c) for c in ("OCR_FAILED", "PROVIDER_TIMEOUT", "PROVIDER_AUTH_ERROR", "RENDER_FAILED", "PERSIST_FAILED")]),
            (F.col("event_id") % 5 + 1).cast("int"))).alias("error_code"),
        F.lit(None).cast("string").alias("error_message"), start.alias("created_at"),
    )


ACTIONS = ("PROCESSING_STARTED", "FIELD_CORRECTED", "RECORD_APPROVED", "RECORD_REJECTED", "REVIEW_CREATED", "EXPORTED")


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (n % 6 + 1).cast("int"))
    number = F.get_json_object("props", "$.k")
    return e.select(
        F.lpad(text(n), 12, "0").alias("id"),
        F.when(n % 3 != 0, F.concat(F.lit("officer-"), text(F.col("user_id")))).alias("user_id"),
        F.lit("land_record").alias("entity_type"), text(F.col("user_id")).alias("entity_id"), action.alias("action"),
        F.when(n % 6 == 1, F.concat(F.lit('{"area":"'), number, F.lit('"}'))).alias("old_value"),
        F.when(n % 6 == 1, F.concat(F.lit('{"area":"'), text(n), F.lit('","unit":"ha"}'))).alias("new_value"),
        F.when(n % 2 == 1, F.concat(F.lit('{"reason":"note '), number, F.lit('"}'))).otherwise("{}").alias("metadata"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections out of events: one of three fields of a record, sometimes to no value."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    field = F.element_at(F.array(F.lit("owner_name"), F.lit("area"), F.lit("village")), (n % 3 + 1).cast("int"))
    return e.select(
        text(F.col("user_id")).alias("land_record_id"), field.alias("field_name"), F.lit(None).cast("string").alias("old_value"),
        F.when(n % 7 != 0, F.concat(F.lit("new "), text(n))).alias("new_value"), F.lit("checked").alias("reason"),
        F.lit("u1").alias("changed_by"), F.col("ts").cast("timestamp").alias("changed_at"),
    )


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A text and a copy with known damage: every word 'that' is lost, every 'j' is read as a sign the text lacks.

    Lost and unreadable tokens cannot be matched, so the edit distance is their number, whatever the text.
    """
    docs = spread(table(spark, d, "documents")).select(
        text(F.col("doc_id")).alias("id"), F.col("text").alias("reference"), "lang", "source", "n_chars",
        compare_key(F.col("text")).alias("ref"))
    kept = F.array_join(F.filter(F.split("ref", " ", -1), lambda w: w != "that"), " ")
    return docs.withColumn("hypothesis", F.translate(kept, "j", "§"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(
        text(F.col("conv_id")).alias("document_id"), F.col("turn").cast("int").alias("turn"),
        F.col("text"), ((F.col("turn") * 13 + F.col("conv_id")) % 121 / 100.0).alias("confidence"),
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    """Word rows of the kind a recogniser emits: each turn is a line, each blank-separated token a word."""
    c = table(spark, d, "conversations")
    exploded = c.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    spot = F.col("i") + F.col("turn") * 1000
    return exploded.select(
        text(F.col("conv_id")).alias("document_id"), spot.cast("long").alias("pos"),
        F.when(F.col("i") % 50 == 49, 4).otherwise(5).alias("level"), F.lit(1).alias("page_num"),
        F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("turn").cast("int").alias("line_num"),
        (F.col("i") * 10.0).alias("left"), (F.col("turn") * 20.0).alias("top"), (F.length("word") * 5.0).alias("width"),
        F.lit(18.0).alias("height"),
        F.when(F.col("i") % 37 == 36, "-1").when(F.col("i") % 41 == 40, "n/a").otherwise(text(F.col("i") % 100)).alias("conf"),
        F.col("word").alias("text"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as uploaded files: the name comes from the address, the content from the page."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".jpeg", ".tiff", ".html", "")]), (k % 6 + 1).cast("int"))
    body = F.when(k % 6 == 0, F.concat(F.lit("%PDF-"), F.col("html"))).otherwise(F.col("html"))
    content = F.when(k % 25 == 24, F.lit("")).otherwise(body).cast("binary")
    declared = (
        F.when(k % 10 == 0, "application/pdf").when(k % 10 == 3, "image/tiff; q=1").when(k % 10 == 4, "text/html")
    )
    return p.select(
        F.concat(F.lit("in/"), text(k)).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"),
        F.concat(F.regexp_replace(F.col("url"), r"[?#].*$", ""), F.when(k % 9 == 8, F.lit(" .")).otherwise(F.lit("")), suffix).alias("filename"),
        declared.alias("declared_mime"),
    )


def outputs(spark: SparkSession, d: str) -> DataFrame:
    return outputs_of(normalized(spark, d))


def outputs_of(n: DataFrame) -> DataFrame:
    """Extraction outputs out of normalised records: some failed, two models, two prompt versions."""
    k = F.col("record_id").cast("long")
    names = ["owner_name", "survey_number", "area", "village", "tehsil", "district", "record_date"]
    return n.select(
        F.col("record_id").alias("id"), (k % 43 == 0).alias("failed"),
        F.when(k % 43 == 0, "PROVIDER_TIMEOUT").alias("error_code"), F.lit("p1").alias("provider"),
        F.when(k % 3 == 0, "m-old").otherwise("m-new").alias("model"), F.when(k % 8 == 0, "v0").otherwise("v1").alias("prompt_version"),
        (k % 50 / 10.0).alias("elapsed_seconds"),
        F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.col(x) for x in names])).alias("values"),
    )


# SQL text ----------------------------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _norm(c: str) -> str:
    return _NORM.format(c)


_REQUIRED = "\nUNION ALL\n".join(
    f"""SELECT record_id, {i} AS pos, 'REQ_{n.upper()}_001' AS rule_id, '{n}' AS field_name, 'REVIEW_REQUIRED' AS status,
    'WARNING' AS severity, '{n}: empty, but every record needs it' AS message
    FROM n_records WHERE coalesce(trim({n}), '') = ''"""
    for i, n in enumerate(("owner_name", "survey_number", "area", "village", "tehsil", "district"))
)
_UNKNOWN = "\nUNION ALL\n".join(
    f"""SELECT record_id, {20 + i}, 'REF_{n.upper()}_001', '{n}', 'REVIEW_REQUIRED', 'WARNING',
    '{n}: ''' || {n} || ''' does not occur in reference_data v1'
    FROM n_records r WHERE coalesce({n}, '') <> '' AND NOT EXISTS (SELECT 1 FROM v_reference v
      WHERE v.reference_type = '{n}' AND v.status = 'active' AND lower(v.name) = lower(r.{n}))"""
    for i, n in enumerate(("village", "tehsil", "district"))
)


def _chain(pos: int, rule: str, child: str, parent: str) -> str:
    return f"""SELECT r.record_id, {pos}, '{rule}', '{parent}', 'REVIEW_REQUIRED', 'WARNING',
    '{parent}: ''' || r.{parent} || ''' here, but the reference puts {child} ''' || r.{child} || ''' in ''' || lower(p.name) || ''''
    FROM n_records r JOIN v_reference c ON c.reference_type = '{child}' AND c.status = 'active' AND lower(c.name) = lower(r.{child})
    JOIN v_reference p ON p.id = c.parent_id AND p.reference_type = '{parent}'
    WHERE coalesce(r.{parent}, '') <> '' AND lower(p.name) <> lower(r.{parent})"""


_FIELD_ARRAY = "['owner_name','survey_number','area','village','tehsil','district','record_date']"

# name -> (views it reads, SQL)
SQL_VIEWS: dict[str, tuple[str, str]] = {
    "v_records": ("", r"""
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_orderkey AS VARCHAR) AS document_id, o_orderkey AS k,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' || c_name || '  ' ELSE c_name END AS owner_name,
  c_mktsegment AS father_or_spouse_name,
  CAST(o_custkey % 50 AS VARCHAR) || '/' || CAST(o_orderkey % 7 AS VARCHAR) AS survey_number,
  CAST(o_orderkey % 1000 AS VARCHAR) AS khasra_number, CAST(o_custkey AS VARCHAR) AS khata_number,
  CASE WHEN o_orderkey % 19 = 0 THEN 'abc' WHEN o_orderkey % 23 = 0 THEN '0'
    WHEN o_orderkey % 5 = 0 THEN regexp_replace(CAST(o_totalprice AS VARCHAR), '^(\d+)(\d{3})\.', '\1,\2.')
    ELSE CAST(o_totalprice AS VARCHAR) END AS area,
  CASE o_orderkey % 6 WHEN 0 THEN 'hectare' WHEN 1 THEN 'Ha' WHEN 2 THEN 'acres' WHEN 3 THEN 'sq  meter' WHEN 4 THEN 'bigha' END AS area_unit,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE c_name END AS village,
  CASE WHEN o_orderkey % 17 = 0 THEN 'NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) ELSE n_name END AS tehsil,
  CASE WHEN o_orderkey % 37 = 0 THEN 'ASIA' ELSE r_name END AS district,
  c_mktsegment AS land_classification,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'M-' || CAST(o_orderkey AS VARCHAR) END AS mutation_number,
  CASE WHEN o_orderkey % 2 = 0 THEN 'R' || CAST(o_orderkey AS VARCHAR) END AS registration_number,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '99/99/2024' END AS record_date,
  CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS status,
  o_orderdate AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "v_reference": ("", """
SELECT 'D' || CAST(r_regionkey AS VARCHAR) AS id, 'district' AS reference_type, 'D' || CAST(r_regionkey AS VARCHAR) AS code, r_name AS name,
  CAST(NULL AS VARCHAR) AS parent_id, 'v1' AS version, CASE WHEN r_regionkey % 29 = 0 THEN 'inactive' ELSE 'active' END AS status FROM region
UNION ALL SELECT 'T' || CAST(n_nationkey AS VARCHAR), 'tehsil', 'T' || CAST(n_nationkey AS VARCHAR), n_name, 'D' || CAST(n_regionkey AS VARCHAR), 'v1',
  CASE WHEN n_nationkey % 29 = 0 THEN 'inactive' ELSE 'active' END FROM nation
UNION ALL SELECT 'V' || CAST(c_custkey AS VARCHAR), 'village', 'V' || CAST(c_custkey AS VARCHAR), c_name, 'T' || CAST(c_nationkey AS VARCHAR), 'v1',
  CASE WHEN c_custkey % 29 = 0 THEN 'inactive' ELSE 'active' END FROM customer"""),
    "n_records": ("v_records", rf"""
SELECT record_id, document_id, k, status, updated_at,
  {_norm('owner_name')} AS owner_name, {_norm('father_or_spouse_name')} AS father_or_spouse_name,
  {_norm('survey_number')} AS survey_number, {_norm('khasra_number')} AS khasra_number, {_norm('khata_number')} AS khata_number,
  CASE WHEN regexp_full_match(regexp_replace(area, '\s+', '', 'g'), '-?\d[\d,]*(\.\d+)?') THEN replace(regexp_replace(area, '\s+', '', 'g'), ',', '')
    ELSE nullif(trim(area), '') END AS area,
  CASE {_norm('lower(area_unit)')} WHEN 'hectare' THEN 'hectare' WHEN 'hectares' THEN 'hectare' WHEN 'ha' THEN 'hectare' WHEN 'acre' THEN 'acre'
    WHEN 'acres' THEN 'acre' WHEN 'sqm' THEN 'sqm' WHEN 'sq.m.' THEN 'sqm' WHEN 'sq meter' THEN 'sqm' WHEN 'sq meters' THEN 'sqm'
    WHEN 'sq metre' THEN 'sqm' WHEN 'sq metres' THEN 'sqm' ELSE trim(area_unit) END AS area_unit,
  {_norm('village')} AS village, {_norm('tehsil')} AS tehsil, {_norm('district')} AS district,
  {_norm('land_classification')} AS land_classification, {_norm('mutation_number')} AS mutation_number,
  {_norm('registration_number')} AS registration_number,
  coalesce(strftime(CASE WHEN regexp_full_match(record_date, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime(record_date, '%Y-%m-%d')
    WHEN regexp_full_match(record_date, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime(record_date, '%d-%m-%Y')
    WHEN regexp_full_match(record_date, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime(record_date, '%d/%m/%Y')
    WHEN regexp_full_match(record_date, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}') THEN try_strptime(record_date, '%d.%m.%Y') END, '%Y-%m-%d'), record_date) AS record_date
FROM v_records"""),
    "r_issues": ("n_records v_reference", rf"""
{_REQUIRED}
UNION ALL SELECT record_id, 6, 'REQ_AREA_UNIT_001', 'area_unit', 'REVIEW_REQUIRED', 'WARNING',
  'area_unit: the area stands without a unit'
  FROM n_records WHERE coalesce(area, '') <> '' AND coalesce(area_unit, '') = ''
UNION ALL SELECT record_id, 10, 'FMT_AREA_001', 'area', 'FAIL', 'ERROR',
  'area: ''' || area || ''' cannot be read as a decimal number'
  FROM n_records WHERE coalesce(area, '') <> '' AND NOT regexp_full_match(area, '-?\d[\d,]*(\.\d+)?')
UNION ALL SELECT record_id, 11, 'FMT_AREA_002', 'area', 'FAIL', 'ERROR',
  'area: ' || area || ' is not above zero'
  FROM n_records WHERE TRY_CAST(area AS DOUBLE) <= 0
UNION ALL SELECT record_id, 12, 'FMT_UNIT_001', 'area_unit', 'WARNING', 'WARNING',
  'area_unit: ''' || area_unit || ''' is neither hectare nor acre nor sqm; it may be a local unit'
  FROM n_records WHERE coalesce(area_unit, '') <> '' AND area_unit NOT IN ('hectare', 'acre', 'sqm')
UNION ALL SELECT record_id, 13, 'FMT_DATE_001', 'record_date', 'WARNING', 'WARNING',
  'record_date: ''' || record_date || ''' has no known form and was left as it is'
  FROM n_records WHERE coalesce(record_date, '') <> '' AND NOT regexp_full_match(record_date, '\d{{4}}-\d{{2}}-\d{{2}}')
UNION ALL {_UNKNOWN}
UNION ALL {_chain(23, 'REF_GEO_CHAIN_001', 'village', 'tehsil')}
UNION ALL {_chain(24, 'REF_GEO_CHAIN_002', 'tehsil', 'district')}"""),
    "d_records": ("n_records", """
SELECT *, CASE WHEN coalesce(survey_number, '') <> '' AND coalesce(village, '') <> ''
  THEN count(*) OVER (PARTITION BY lower(survey_number), lower(village)) - 1 ELSE 0 END AS match_count FROM n_records"""),
    "r_all": ("r_issues d_records", """
SELECT record_id, pos, rule_id, field_name, status, severity, message FROM r_issues
UNION ALL SELECT record_id, 30, 'DUP_CANDIDATE_001', 'survey_number', 'REVIEW_REQUIRED', 'WARNING',
  'survey_number: ''' || survey_number || ''' of ''' || village || ''' is also in ' || CAST(match_count AS VARCHAR) || ' other record(s); a parcel can be recorded twice for good reasons, so look at them before approval'
  FROM d_records WHERE match_count > 0"""),
    "verdicts": ("n_records r_all", """
SELECT n.record_id, n.k, n.district, n.tehsil, n.status, coalesce(i.issues, 0) AS issues, coalesce(i.rules, '') AS rules,
  CASE WHEN i.blocking > 0 THEN 'BLOCKED' WHEN i.review > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_APPROVAL' END AS verdict
FROM n_records n LEFT JOIN (SELECT record_id, count(*) AS issues, string_agg(rule_id, ',' ORDER BY pos) AS rules,
  sum(CASE WHEN status = 'FAIL' OR severity IN ('ERROR', 'CRITICAL') THEN 1 ELSE 0 END) AS blocking,
  sum(CASE WHEN severity = 'WARNING' OR status = 'REVIEW_REQUIRED' THEN 1 ELSE 0 END) AS review FROM r_all GROUP BY record_id) i USING (record_id)"""),
    "v_fields": ("", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, {_FIELD_ARRAY}[l_linenumber] AS field_name,
  CASE WHEN p % 17 <> 0 THEN CAST(q AS VARCHAR) END AS value, CASE WHEN p % 31 <> 0 THEN 1 - disc * 4 END AS confidence,
  CASE WHEN s % 3 = 0 THEN 1 END AS source_page, CASE WHEN s % 5 = 0 THEN 'seen' WHEN s % 7 = 0 THEN '' END AS source_text,
  s % 11 = 0 AS has_box, CASE WHEN p % 17 = 0 THEN 'MISSING' ELSE 'EXTRACTED' END AS extraction_status
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_discount) AS disc, min(l_partkey) AS p, min(l_suppkey) AS s
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""),
    "v_issues": ("", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, 'RULE_' || CAST(l_linenumber AS VARCHAR) AS rule_id,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 1 THEN 'owner_name' WHEN l_linenumber = 2 THEN 'survey_number' ELSE 'area' END AS field_name,
  CASE WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN 'NOT_CHECKED' WHEN l_linestatus = 'F' THEN 'PASS' WHEN l_linenumber <= 2 THEN 'FAIL'
    WHEN l_linenumber <= 4 THEN 'WARNING' ELSE 'REVIEW_REQUIRED' END AS status,
  CASE WHEN l_linestatus = 'F' THEN 'INFO' WHEN l_returnflag = 'R' THEN 'ERROR' WHEN l_returnflag = 'A' THEN 'WARNING'
    WHEN l_linenumber = 5 THEN NULL ELSE 'INFO' END AS severity,
  'quantity ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS message
FROM lineitem"""),
    "v_tasks": ("", """
SELECT 'K' || CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(o_orderkey % 5000 AS VARCHAR) AS land_record_id,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 10 AS VARCHAR) END AS assigned_to,
  CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_REVIEW' WHEN 2 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'NOT SPECIFIED' END AS priority,
  'Reason ' || CAST(o_orderkey % 100 AS VARCHAR) AS reason, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 4 = 2 THEN o_orderdate + INTERVAL 36 HOUR END AS completed_at
FROM orders"""),
    "v_jobs": ("", """
SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, CAST(user_id AS VARCHAR) AS document_id,
  CASE event_type WHEN 'view' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'RUNNING' WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  CASE WHEN event_type <> 'signup' THEN epoch_us(ts) END AS started_us,
  CASE WHEN event_type IN ('view', 'error', 'click') THEN epoch_us(ts) + CAST(round((CASE WHEN event_id % 41 = 0 THEN -value ELSE value END) * 1000000) AS BIGINT) END AS completed_us,
  CASE WHEN event_type = 'error' THEN ['OCR_FAILED', 'PROVIDER_TIMEOUT', 'PROVIDER_AUTH_ERROR', 'RENDER_FAILED', 'PERSIST_FAILED'][event_id % 5 + 1] END AS error_code,
  epoch_us(ts) AS created_us
FROM events"""),
    "v_audit": ("", """
SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_id AS n, CASE WHEN event_id % 3 <> 0 THEN 'officer-' || CAST(user_id AS VARCHAR) END AS user_id,
  CAST(user_id AS VARCHAR) AS entity_id,
  ['PROCESSING_STARTED', 'FIELD_CORRECTED', 'RECORD_APPROVED', 'RECORD_REJECTED', 'REVIEW_CREATED', 'EXPORTED'][event_id % 6 + 1] AS action,
  json_extract_string(props, '$.k') AS number, epoch_us(ts) AS at_us
FROM events"""),
    "v_corrections": ("", """
SELECT CAST(user_id AS VARCHAR) AS land_record_id, ['owner_name', 'area', 'village'][event_id % 3 + 1] AS field_name,
  CASE WHEN event_id % 7 <> 0 THEN 'new ' || CAST(event_id AS VARCHAR) END AS new_value, epoch_us(ts) AS at_us FROM events"""),
    "v_lines": ("", """
SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS turn, text, (turn * 13 + conv_id) % 121 / 100.0 AS confidence FROM conversations"""),
    "v_words": ("", """
SELECT CAST(conv_id AS VARCHAR) AS document_id, i + turn * 1000 AS pos, CASE WHEN i % 50 = 49 THEN 4 ELSE 5 END AS level, turn AS line_num,
  i * 10.0 AS "left", turn * 20.0 AS top, length(word) * 5.0 AS width, 18.0 AS height,
  CASE WHEN i % 37 = 36 THEN -1.0 WHEN i % 41 = 40 THEN NULL ELSE i % 100 END AS conf, word AS text
FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations)"""),
    "w_lines": ("v_words", r"""
SELECT document_id, line_num, string_agg(w, ' ' ORDER BY pos) AS text, avg(conf / 100.0) AS confidence, min("left") AS x1, min(top) AS y1,
  max("left" + width) AS x2, max(top + height) AS y2
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS w FROM v_words) WHERE level = 5 AND w <> '' AND conf >= 0 GROUP BY document_id, line_num"""),
    "v_files": ("", """
SELECT page_id, 'in/' || CAST(page_id AS VARCHAR) AS path,
  CASE WHEN page_id % 25 = 24 THEN '' WHEN page_id % 6 = 0 THEN '%PDF-' || html ELSE html END AS body,
  regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 9 = 8 THEN ' .' ELSE '' END || ['.pdf', '.PNG', '.jpeg', '.tiff', '.html', ''][page_id % 6 + 1] AS filename,
  CASE page_id % 10 WHEN 0 THEN 'application/pdf' WHEN 3 THEN 'image/tiff; q=1' WHEN 4 THEN 'text/html' END AS declared
FROM pages"""),
    "f_files": ("v_files", r"""
SELECT *, octet_length(encode(body)) AS length, base AS file_name, CASE WHEN regexp_matches(base, '[^.].*\.[^.]*$') THEN lower(regexp_extract(base, '\.([^.]*)$', 1)) ELSE '' END AS ext,
  lower(trim(split_part(coalesce(declared, ''), ';', 1))) AS said
FROM (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(trim(filename), '^.*/', ''), '^[ .]+|[ .]+$', '', 'g'), ''), 'upload') AS base FROM v_files)"""),
    "m_files": ("f_files", """
SELECT *, CASE WHEN expected IS NOT NULL AND coalesce(said_mime, expected) <> expected THEN 'FILE_TYPE_MISMATCH'
    WHEN coalesce(said_mime, expected) IS NULL THEN 'UNSUPPORTED_FILE_TYPE' END AS mime_error, coalesce(said_mime, expected) AS any_mime
FROM (SELECT *, CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
    WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' END AS expected,
  CASE WHEN said IN ('application/pdf', 'image/png', 'image/jpeg', 'image/tiff') THEN said END AS said_mime FROM f_files)"""),
    "v_outputs": ("n_records", """
SELECT *, record_id AS id, k % 43 = 0 AS failed, CASE WHEN k % 3 = 0 THEN 'm-old' ELSE 'm-new' END AS model,
  CASE WHEN k % 8 = 0 THEN 'v0' ELSE 'v1' END AS prompt_version, k % 50 / 10.0 AS elapsed_seconds FROM n_records"""),
    "v_pairs": ("", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, n_chars, ref, translate(array_to_string(list_filter(string_split(ref, ' '), lambda w: w <> 'that'), ' '), 'j', '§') AS hyp
FROM (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS ref FROM documents)"""),
}
