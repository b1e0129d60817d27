"""Which script a text is written in, and the reading language that follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, literal_map, strip

# --- fixed values -----------------------------------------------------------
DECLARED_LANGUAGES = {
    "en": "eng", "eng": "eng", "english": "eng",
    "hi": "hin+eng", "hin": "hin+eng", "hindi": "hin+eng", "devanagari": "hin+eng",
    "gu": "guj+eng", "guj": "guj+eng", "gujarati": "guj+eng",
    "eng+hin": "hin+eng", "hin+eng": "hin+eng",
    "eng+guj": "guj+eng", "guj+eng": "guj+eng",
}
NON_LATIN_VERDICTS = {"Devanagari": "hin+eng", "Gujarati": "guj+eng"}
SCRIPT_RANGES = {"latin": "[A-Za-z]", "devanagari": r"[\x{0900}-\x{097F}]", "gujarati": r"[\x{0A80}-\x{0AFF}]"}
MIN_SHARE = 0.06
TRUSTED_VERDICT = 3.0
DEFAULT_LANGUAGE = "eng"
# ----------------------------------------------------------------------------


def count_scripts(text: Column) -> Column:
    """``struct(latin, devanagari, gujarati)`` letter counts; digits and punctuation count for nothing."""
    body = F.coalesce(text, F.lit(""))
    # What remains of a text without the other characters: they go in runs, while a count would match letter by letter.
    return F.struct(*[F.length(F.regexp_replace(body, p.replace("[", "[^", 1) + "+", "")).alias(n) for n, p in SCRIPT_RANGES.items()])


def language_config(counts: Column) -> Column:
    """Reading language from the counts, NULL when the text has no letters."""
    return let(counts, _config)


def _config(counts: Column) -> Column:
    total = counts["latin"] + counts["devanagari"] + counts["gujarati"]
    share = {n: F.try_divide(counts[n].cast("double"), total.cast("double")) for n in SCRIPT_RANGES}
    local = F.when((share["devanagari"] >= MIN_SHARE) & (share["devanagari"] >= share["gujarati"]), "hin").when(
        share["gujarati"] >= MIN_SHARE, "guj"
    )
    return (
        F.when(total == 0, F.lit(None).cast("string"))
        .when(local.isNull(), F.lit("eng"))
        .when(share["latin"] >= MIN_SHARE, F.concat(local, F.lit("+eng")))
        .otherwise(local)
    )


def normalize_declared(language: Column) -> Column:
    return F.element_at(literal_map(DECLARED_LANGUAGES), F.lower(strip(language)))


def detect_language(text: Column, declared: Column, verdict_script: Column | None = None,
                    verdict_confidence: Column | None = None) -> Column:
    """``struct(language, source)``: a confident non-Latin verdict, then the letters, then the declaration."""
    verdict = F.lit(None).cast("string")
    if verdict_script is not None and verdict_confidence is not None:
        verdict = F.when(
            verdict_confidence >= TRUSTED_VERDICT, F.element_at(literal_map(NON_LATIN_VERDICTS), verdict_script)
        )
    letters = language_config(count_scripts(text))
    said = normalize_declared(declared)

    def pick(value: Column, source: str) -> Column:
        return let(value, lambda x: F.when(x.isNotNull(), F.struct(x.alias("language"), F.lit(source).alias("source"))))

    return F.coalesce(
        pick(verdict, "osd"), pick(letters, "codepoints"), pick(said, "declared"),
        F.struct(F.lit(DEFAULT_LANGUAGE).alias("language"), F.lit("default").alias("source")),
    )
