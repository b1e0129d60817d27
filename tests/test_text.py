"""Distances, verdicts, confidence, responses, scripts, files."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from recordlake.functions import confidence as conf
from recordlake.functions import distance as ds
from recordlake.functions import files, labels, responses, scripts
from recordlake.schemas import FIELD_NAMES


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_sequence_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40)))
        assert ds.sequence_distance(a, b) == brute(a, b)


def test_diagonals_and_columns_agree():
    rng = random.Random(11)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(30))) for _ in range(2))
        assert ds.near_distance(a, b, 10 ** 6) == ds.column_distance(a, b) == brute(a, b)
    assert ds.near_distance("a" * 50, "b" * 50, 20) is None


def test_long_texts_with_few_edits():
    rng = random.Random(12)
    a = [rng.choice("abcdefgh ") for _ in range(100_000)]
    b = list(a)
    for at in rng.sample(range(0, 100_000, 10), 20):
        b[at] = "§"
    start = time.perf_counter()
    assert ds.sequence_distance("".join(a), "".join(b)) == 20
    assert time.perf_counter() - start < 0.5


def test_far_texts_go_by_diagonals(monkeypatch):
    rng = random.Random(11)
    a = [rng.choice("abcdefghij") for _ in range(30000)]
    b = list(a)
    for at in sorted(rng.sample(range(30000), 300), reverse=True):
        b[at:at + 1] = rng.choice([[], ["§"], [b[at], "§"]])
    want = ds.column_distance(a, b)
    monkeypatch.setattr(ds, "column_distance", None)
    assert ds.sequence_distance("".join(a), "".join(b)) == ds.sequence_distance(a, b) == want > 200


@pytest.mark.parametrize("few", [0, 1, 4])
def test_diagonals_in_arrays_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(ds, "FEW_EDITS", few)
    rng = random.Random(few)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(2))
        assert ds.near_distance(a, b, 10 ** 6) == ds.near_distance(list(a), list(b), 10 ** 6) == brute(a, b)
    assert ds.near_distance("a" * 500, "b" * 500, 2000) is None


def test_word_distance_on_both_sides_of_the_limit(spark):
    rng, rows = random.Random(13), [(None, "a"), ("a", None), (None, None), ("", ""), ("", "a"), ("a  b", "a b")]
    for i in range(150):
        a = [rng.choice(["x", "y", "zz", "É", ""]) if i % 2 else "w%d" % rng.randrange(40) for _ in range(rng.choice([1, 3, 10, 60, 128, 129, 200]))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = rng.choice(["q", "x", ""])
            b.insert(rng.randrange(len(b) + 1), rng.choice(["q", "x", ""]))
            del b[rng.randrange(len(b))]
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", ds.word_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == (None if r.a is None or r.b is None else brute(r.a.split(" "), r.b.split(" ")))


def test_error_rates(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("ab cd") for _ in range(700)) for _ in range(4)]
    pairs = [("kitten", "sitting"), ("abc", ""), ("a b c", "a x c"), ("", "x"), ("", ""), ("गाँव", "गाव"), (" A  B", "a b"),
             (long[0], long[1]), (long[2], long[3])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, reference string, hypothesis string")
    for r in ds.with_error_rates(df).collect():
        a, b = (" ".join(x.lower().split()) for x in (r.reference, r.hypothesis))
        cer = brute(a, b) / len(a) if a else float(bool(b))
        words = brute(a.split(" "), b.split(" ")) / len(a.split(" "))
        assert r.cer == pytest.approx(cer) and r.wer == pytest.approx(words)


@pytest.mark.parametrize("expected,got,field,verdict", [
    ("Ramesh Kumar", "  ramesh   KUMAR ", "owner_name", "CORRECT"), ("2.45", "2.450", "area", "CORRECT"),
    ("Demo Village", None, "village", "MISSING"), (None, None, "registration_number", "CORRECT"),
    (None, "XYZ-1", "registration_number", "HALLUCINATED"), ("145/2", "145/3", "survey_number", "INCORRECT"),
    ("Agricultural", "Agriculture", "land_classification", "PARTIALLY_CORRECT"), ("M-2024-0091", "M-2024", "mutation_number", "INCORRECT"),
    ("Ramesh Kumar", "Ramesh Kumer", "owner_name", "PARTIALLY_CORRECT"), ("Ramesh", "Suresh Patel", "owner_name", "INCORRECT"),
])
def test_verdicts(spark, expected, got, field, verdict):
    df = spark.createDataFrame([(field, expected, got)], "field_name string, expected string, got string")
    assert [r.verdict for r in ds.classify_fields(df).collect()] == [verdict]


def test_ratio_shortcut_never_changes_a_verdict(spark):
    rng = random.Random(3)
    rows = [("owner_name", "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "field_name string, expected string, got string")
    for r in ds.classify_fields(df).collect():
        e, g = r.expected, r.got
        want = "CORRECT" if e == g else "PARTIALLY_CORRECT" if e in g or g in e or difflib.SequenceMatcher(None, e, g).ratio() >= 0.8 else "INCORRECT"
        assert r.verdict == want


ISSUE = "array<struct<rule_id:string,field_name:string,status:string,severity:string,message:string>>"


@pytest.mark.parametrize("value,ext,line,issue,score,band,review", [
    ("Ramesh Kumar", 0.95, ("Owner Name: Ramesh Kumar", 0.95), None, 0.95, "HIGH", False),
    ("2.45", 0.85, ("Area: 2.45", 0.25), None, 0.55, "LOW", True),
    ("2.45", None, ("Area: 2.45", 0.95), None, 0.95, "HIGH", False),
    ("x", 0.95, ("x", 0.95), ("R", "f", "FAIL", "ERROR", "m"), 0.39, "LOW", True),
    ("x", 0.95, ("x", 0.95), ("R", "f", "REVIEW_REQUIRED", "WARNING", "m"), 0.69, "MEDIUM", True),
    (None, 0.95, ("x", 0.95), None, None, "REVIEW_REQUIRED", True),
    ("x", None, ("y", 0.95), None, None, "REVIEW_REQUIRED", True),
    ("x", 0.8, ("x", 1.5), None, 0.8, "HIGH", False),
])
def test_confidence(spark, value, ext, line, issue, score, band, review):
    df = spark.createDataFrame([(value, ext, [line], [issue] if issue else [])], f"v string, e double, l array<struct<text:string,confidence:double>>, i {ISSUE}")
    r = df.select(conf.score_field(F.lit("f"), F.col("v"), F.col("e"), conf.prepare_lines(F.col("l")), F.col("i")).alias("s")).first().s
    assert (r.score if r.score is None else round(r.score, 6), r.band, r.review_required) == (score, band, review)


def test_bands(spark):
    got = spark.createDataFrame([(0.8,), (0.6,), (0.599,), (None,)], "s double").select(conf.band(F.col("s"))).collect()
    assert [r[0] for r in got] == ["HIGH", "MEDIUM", "LOW", "REVIEW_REQUIRED"]


def test_responses(spark):
    body = '{"fields": {"owner_name": {"value": " A ", "confidence": "0.9"}, "area": {"value": 12.50, "confidence": 7}, "village": {"value": true, "confidence": "x"},' \
           '"tehsil": {"value": ["a"], "confidence": -1}, "district": {"value": null}, "khata_number": 5, "other": {"value": "z"}}}'
    rows = [("a", body), ("b", f"```json\n{body}\n```"), ("c", "not json"), ("d", '{"x": 1}'), ("e", '{"fields": []}'), ("f", "[1]")]
    out = {r.id: r for r in responses.parse_model_responses(spark.createDataFrame(rows, "id string, raw_text string")).collect()}
    for key in "ab":
        f = out[key].fields
        assert set(f) == set(FIELD_NAMES) and not out[key].failed
        assert tuple(f["owner_name"]) == ("A", 0.9, "EXTRACTED") and tuple(f["area"]) == ("12.5", 1.0, "EXTRACTED")
        assert tuple(f["village"]) == ("true", None, "EXTRACTED") and tuple(f["tehsil"]) == (None, 0.0, "UNCERTAIN")
        assert tuple(f["district"]) == (None, None, "MISSING") and tuple(f["khata_number"]) == (None, None, "MISSING")
    assert all(out[k].error_code == "PROVIDER_BAD_RESPONSE" and out[k].failed for k in "cdef")


@pytest.mark.parametrize("counts,language", [
    ((200, 0, 0), "eng"), ((0, 150, 0), "hin"), ((0, 0, 150), "guj"), ((155, 46, 0), "hin+eng"), ((156, 0, 45), "guj+eng"), ((300, 2, 0), "eng"), ((0, 0, 0), None)])
def test_language(spark, counts, language):
    text = "a" * counts[0] + "क" * counts[1] + "ગ" * counts[2] + " 12 -"
    row = spark.createDataFrame([(text,)], "t string").select(scripts.language_config(scripts.count_scripts(F.col("t")))).first()
    assert row[0] == language


@pytest.mark.parametrize("name,clean,ext", [
    ("../a/b.PDF", "b.PDF", "pdf"), (" .. ", "upload", ""), (None, "upload", ""), ("x\u0007y.png.", "xy.png", "png"), (".pdf", "pdf", ""), ("a" * 300, "a" * 255, "")])
def test_file_names(spark, name, clean, ext):
    c = files.sanitize_filename(F.col("n"))
    assert tuple(spark.createDataFrame([(name,)], "n string").select(c, files.extension(c)).first()) == (clean, ext)


def test_content(spark):
    rows = [(bytearray(b"%PDF-1.4"), "application/pdf", True), (bytearray(b"\x89PNG\r\n\x1a\nrest"), "image/png", True), (bytearray(b"\xff\xd8\xff\xe0"), "image/jpeg", True),
            (bytearray(b"MM\x00*x"), "image/tiff", True), (bytearray(b"II*\x00"), "image/tiff", True), (bytearray(b"GIF8"), "image/png", False), (bytearray(b""), "application/pdf", False)]
    df = spark.createDataFrame(rows, "c binary, m string, want boolean")
    assert all(r[0] == r[1] for r in df.select(files.content_matches(F.col("c"), F.col("m")), "want").collect())


def test_errors(spark):
    rows = [("ERROR:  22008: out of range", 422), ("23505 duplicate key", 409), ("57P01 shutdown", 503), ("request timed out", 503), ("oops", 500)]
    df = spark.createDataFrame(rows, "m string, want int")
    assert all(r[0] == r[1] for r in df.select(labels.classify_error(labels.extract_sqlstate(F.col("m")), F.col("m"))["http_status"], "want").collect())


def slow_matched(a, b, popular):
    """Characters that Ratcliff/Obershelp matches, by the longest block of all pairs of places; a popular character only extends a block."""
    best = (0, 0, 0)
    run = {}
    for i, x in enumerate(a):
        run = {j: run.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y and y not in popular}
        for j, n in run.items():
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
    i, j, n = best
    while i and j and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n and n + slow_matched(a[:i], b[:j], popular) + slow_matched(a[i + n:], b[j + n:], popular)


def test_ratio_of_whole_conversations_equals_brute_force(spark):
    from checks.language import reversed_ratios

    small = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.ratio for r in reversed_ratios(spark, small).collect()}
    assert set(got) == set(texts) and len(texts) > 80
    for key, text in texts.items():
        a = " ".join((text or "").split()).lower()
        b = a[::-1]
        popular = {c for c in set(b) if len(b) >= 200 and b.count(c) > len(b) // 100 + 1}
        assert got[key] == pytest.approx(2 * slow_matched(a, b, popular) / (2 * len(a)) if a else 1.0)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_response_objects_are_read_once_per_response(spark):
    # A value that a lambda uses would be read once per name, and kinds are told only where the text leaves them open.
    body = ('{"fields": {"owner_name": {"value": "[1]", "confidence": "true"}, "area": {"value": [1], "confidence": true}, "village": 5, '
            '"tehsil": {"value": "{", "confidence": " 0.7"}, "district": {"value": " "}}}')
    out = responses.parse_model_responses(spark.createDataFrame([("a", body)], "id string, raw_text string"))
    fields = {n: tuple(f) for n, f in out.first().fields.items()}
    assert fields["owner_name"] == ("[1]", None, "EXTRACTED") and fields["area"] == (None, 1.0, "UNCERTAIN")
    assert fields["village"] == (None, None, "MISSING") and fields["tehsil"] == ("{", 0.7, "EXTRACTED") and fields["district"] == (None, None, "MISSING")
    plan = plan_of(out)
    assert plan.count("$.fields") == 1 and plan.lower().count("schemaofvariant(") <= 2, plan


def test_letters_of_a_text_are_counted_once(spark):
    rows = [(1, "abc क", "hi", "Gujarati", 1.0), (2, "12", "gu", None, None), (3, None, None, "Gujarati", 3.0), (4, "😀 ગગ", None, None, 9.0), (5, "--", None, None, None)]
    texts = spark.createDataFrame(rows, "id int, t string, said string, script string, sure double")
    counts = {r.id: tuple(r.c) for r in texts.select("id", scripts.count_scripts(F.col("t")).alias("c")).collect()}
    assert counts == {1: (3, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 2), 5: (0, 0, 0)}
    found = texts.select("id", scripts.detect_language(F.col("t"), F.col("said"), F.col("script"), F.col("sure")).alias("x"))
    assert {r.id: tuple(r.x) for r in found.collect()} == {
        1: ("hin+eng", "codepoints"), 2: ("guj+eng", "declared"), 3: ("guj+eng", "osd"), 4: ("guj", "codepoints"), 5: ("eng", "default")}
    assert plan_of(found).count("A-Za-z]") == 1


def test_normalising_compiles_into_short_methods(spark):
    # The JVM does not compile a method of more than 8,000 bytes, so one that is longer runs interpreted for every row.
    import re

    from recordlake.functions.normalize import normalize_record

    row = {n: f" x  {n} " for n in FIELD_NAMES} | {"area": "1,0 00.50", "area_unit": "Sq  Meter", "record_date": "\t1/2/2024 "}
    out = normalize_record(spark.range(3).select("id", *[F.concat(F.lit(v), F.when(F.col("id") > 5, F.lit("!")).otherwise(F.lit(""))).alias(n) for n, v in row.items()]))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", out._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) <= 8000
    got = out.first()
    assert (got.owner_name, got.area, got.area_unit, got.record_date) == ("x owner_name", "1000.50", "sqm", "2024-02-01")


def test_fences_of_long_texts(spark):
    from recordlake.functions.text import strip

    gap = "a" + " " * 300_000 + "b"
    start = time.time()
    assert spark.createDataFrame([(gap,)], "t string").select(responses.strip_fences(F.col("t"))).first()[0] == gap
    assert time.time() - start < 20  # searching the blanks for the end of the text takes the square of their number
    odd = [None, "", " ", " ", "a", " a", "a　", "\ta b\n", "```", " ```json\n{} \n``` ", "\U0001f600 ", "x\n```", "```\n \n```"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = strip(F.col("t"))
    body = F.regexp_replace(F.regexp_replace(plain, responses._FIRST_LINE, ""), responses._LAST_FENCE, "")
    want = F.when(F.startswith(plain, F.lit("```")), strip(body)).otherwise(plain)
    assert all(a == b for a, b in rows.select(responses.strip_fences(F.col("t")), want).collect())


def test_a_value_is_looked_for_on_the_page_once(spark):
    df = spark.createDataFrame([("a", 0.5, [("x A", 0.9)], [("R", "f", "WARNING", "WARNING", "m")])],
                               "v string, e double, l array<struct<text:string,confidence:double>>, i array<struct<rule_id:string,field_name:string,status:string,severity:string,message:string>>")
    out = df.select(conf.score_field(F.lit("f"), F.col("v"), F.col("e"), conf.prepare_lines(F.col("l")), F.col("i")).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().lower().count("contains(") == 1
    s = out.first().s
    assert (s.score, s.band, s.review_required, s.ocr_confidence) == (0.69, "MEDIUM", True, 0.9)
    assert s.reasons == ["line on the page: 0.90", "extraction: 0.50", "rule R WARNING: m", "a finding limits the score to 0.69",
                         "a finding asks for a look at the value"]


def test_phases_normalise_each_text_once(spark):
    """Above the join that brings the phases and the truth together no text is normalised any more."""
    from recordlake.plans.evaluate import compare_configs

    truth = spark.createDataFrame([("a", " The  Text", "english"), ("b", None, "other")], "id string, text string, family string")
    before = spark.createDataFrame([("a", "the test", 1.0), ("b", " ", 2.0)], "id string, text string, seconds double")
    after = spark.createDataFrame([("a", "THE TEXT", 3.0), ("b", "x", 4.0)], "id string, text string, seconds double")
    sides, means = compare_configs(truth, before, after)
    got = {r.id: (r.cer_before, r.wer_before, r.seconds_before, r.cer_after, r.wer_after, r.seconds_after) for r in sides.collect()}
    assert got == {"a": (0.125, 0.5, 1.0, 0.0, 0.0, 3.0), "b": (0.0, 0.0, 2.0, 1.0, 1.0, 4.0)}
    for df in (sides, means):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join ", 1)
        assert "regexp_replace" not in above and below.count("regexp_replace") == 3
