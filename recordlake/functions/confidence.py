"""Field confidence: evidence from the page and from extraction, limited by validation findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compare_key, let

# --- fixed values -----------------------------------------------------------
HIGH, MEDIUM = 0.80, 0.60
DISPLAY_HIGH, DISPLAY_MEDIUM = 0.90, 0.70
FAIL_CAP, WARNING_CAP = 0.39, 0.69
REASON_MESSAGE_LENGTH = 120
# ----------------------------------------------------------------------------


def prepare_lines(lines: Column) -> Column:
    """Normalise line text once per page instead of once per field; unusable confidences are dropped here."""
    usable = F.filter(lines, lambda l: l["confidence"].between(0.0, 1.0))
    return F.transform(
        usable,
        lambda l: F.struct(compare_key(l["text"]).alias("text"), l["confidence"].cast("double").alias("confidence")),
    )


def best_prepared_line(value: Column, prepared: Column) -> Column:
    """Highest confidence among prepared lines that contain the value."""
    def best(target: Column) -> Column:
        hits = F.filter(prepared, lambda l: F.contains(l["text"], target))
        return F.when(target != "", F.array_max(F.transform(hits, lambda l: l["confidence"])))

    return let(compare_key(value), best)


def best_line_confidence(value: Column, lines: Column) -> Column:
    return best_prepared_line(value, prepare_lines(lines))


def band(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return (
        F.when(score.isNull(), F.lit("REVIEW_REQUIRED"))
        .when(score >= high, F.lit("HIGH"))
        .when(score >= medium, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def is_blocking(status: Column, severity: Column) -> Column:
    return F.coalesce((status == "FAIL") | severity.isin("ERROR", "CRITICAL"), F.lit(False))


def is_actionable(status: Column, severity: Column) -> Column:
    """An issue somebody has to look at."""
    return F.coalesce(
        status.isin("FAIL", "REVIEW_REQUIRED") | severity.isin("WARNING", "ERROR", "CRITICAL"), F.lit(False)
    )


def any_blocking(issues: Column) -> Column:
    return F.exists(issues, lambda i: is_blocking(i["status"], i["severity"]))


def any_actionable(issues: Column) -> Column:
    return F.exists(issues, lambda i: is_actionable(i["status"], i["severity"]))


def capped_score(value: Column, ocr: Column, extraction: Column, blocking: Column, actionable: Column) -> Column:
    """Mean of the available signals, NULL without a value or a signal, limited by what the field's issues ask for."""
    mean = F.when(ocr.isNull(), extraction).when(extraction.isNull(), ocr).otherwise((ocr + extraction) / 2)
    cap = F.when(blocking, FAIL_CAP).when(actionable, WARNING_CAP)
    return let(F.when(value.isNotNull(), mean), lambda scored: F.when(scored.isNotNull(), F.least(scored, cap)))


def needs_review(score: Column, actionable: Column) -> Column:
    return score.isNull() | (score < MEDIUM) | actionable


def reasons(value: Column, ocr: Column, extraction: Column, issues: Column, blocking: Column, actionable: Column, score: Column) -> Column:
    """The explanation of a score, in a fixed order."""
    from_page = F.when(ocr.isNotNull(), F.format_string("line on the page: %.2f", ocr)).otherwise(
        F.when(value.isNotNull(), F.lit("no line on the page holds the value"))
        .otherwise(F.lit("nothing to look for on the page"))
    )
    from_extraction = F.when(extraction.isNotNull(), F.format_string("extraction: %.2f", extraction)).otherwise(
        F.lit("extraction: not stated")
    )
    from_issues = F.transform(
        issues,
        lambda i: F.concat(
            F.lit("rule "), F.coalesce(i["rule_id"], F.lit("None")), F.lit(" "),
            F.coalesce(i["status"], F.lit("None")), F.lit(": "),
            F.left(F.coalesce(i["message"], F.lit("")), F.lit(REASON_MESSAGE_LENGTH)),
        ),
    )
    cap = F.when(blocking, F.lit(f"a blocking finding limits the score to {FAIL_CAP}")).when(
        actionable, F.lit(f"a finding limits the score to {WARNING_CAP}")
    )
    flag = F.when(actionable & (score >= MEDIUM), F.lit("a finding asks for a look at the value"))
    missing = F.when(value.isNull(), F.lit("no value, no score"))
    return F.array_compact(
        F.concat(F.array(from_page, from_extraction, missing), from_issues, F.array(cap, flag))
    )


def score_field(name: Column, value: Column, extraction: Column, prepared: Column, issues: Column) -> Column:
    """One scored field; ``issues`` are those of the field, ``prepared`` comes from :func:`prepare_lines`."""
    # Nothing in a lambda is shared: the page is searched, the findings are looked through and the score is taken once per field.
    seen = F.struct(value.alias("value"), extraction.alias("extraction"), best_prepared_line(value, prepared).alias("ocr"),
                    issues.alias("issues"), any_blocking(issues).alias("blocking"), any_actionable(issues).alias("actionable"))

    def told(s: Column) -> Column:
        score = capped_score(s["value"], s["ocr"], s["extraction"], s["blocking"], s["actionable"])
        return let(score, lambda score: F.struct(
            name.alias("field_name"),
            score.alias("score"),
            band(score).alias("band"),
            needs_review(score, s["actionable"]).alias("review_required"),
            s["ocr"].alias("ocr_confidence"),
            s["extraction"].alias("extraction_confidence"),
            reasons(s["value"], s["ocr"], s["extraction"], s["issues"], s["blocking"], s["actionable"], score).alias("reasons"),
        ))

    return let(seen, told)
