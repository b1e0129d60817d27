"""Reading stored extraction responses: envelope, field mapping, error classes, prompt text, cache identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELD_NAMES
from .text import is_blank, let, strip, strip_long, text_key

# --- fixed values -----------------------------------------------------------
BAD_RESPONSE = "PROVIDER_BAD_RESPONSE"
PROVIDER_CODES = {
    "PROVIDER_NOT_CONFIGURED": False,
    "PROVIDER_AUTH_ERROR": False,
    "PROVIDER_BAD_REQUEST": False,
    "PROVIDER_BAD_RESPONSE": False,
    "PROVIDER_RATE_LIMITED": True,
    "PROVIDER_TIMEOUT": True,
    "PROVIDER_UNAVAILABLE": True,
}
# ----------------------------------------------------------------------------

_FIRST_LINE = r"^```[^\r\n]*(\r\n|\r|\n|\z)"
#: An object of known names as entries; what is not an object gives a NULL entry.
_ENTRIES = "map<string,struct<value:variant,confidence:variant>>"
_LAST_FENCE = r"(?U)(^|[\r\n])[^\S\r\n]*```[\s]*\z"


def strip_fences(c: Column) -> Column:
    """Drop a surrounding code fence; text without one is only trimmed."""
    def unfenced(text: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(text, _FIRST_LINE, ""), _LAST_FENCE, "")
        return F.when(F.startswith(text, F.lit("```")), strip(body)).otherwise(text)

    return let(strip_long(c), unfenced)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT"))


def _is_container(v: Column) -> Column:
    return F.regexp_like(_kind(v), F.lit("^(OBJECT|ARRAY)"))


def _as_text(v: Column) -> Column:
    return F.when(~_is_container(v), F.try_variant_get(v, "$", "string"))


def coerce_value(v: Column) -> Column:
    """``struct(value, status)`` of a VARIANT scalar: text, or NULL with MISSING or UNCERTAIN."""
    text = F.nullif(strip(_as_text(v)), F.lit(""))
    status = (
        F.when(_is_container(v), F.lit("UNCERTAIN")).when(text.isNull(), F.lit("MISSING")).otherwise(F.lit("EXTRACTED"))
    )
    return F.struct(text.alias("value"), status.alias("status"))


def clamp_confidence(number: Column) -> Column:
    """A double clamped to [0, 1]; NaN becomes NULL."""
    # greatest and least skip NULL, so NULL has to be kept out of them.
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def coerce_confidence(v: Column) -> Column:
    """Confidence out of a VARIANT: numbers, numeric text and booleans count, everything else is NULL."""
    text = _as_text(v)
    number = F.when(_kind(v) == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(
        strip(text).try_cast("double")
    )
    return clamp_confidence(number)


def confidence_from_text(c: Column) -> Column:
    """The same rule for a plain text column."""
    return clamp_confidence(strip(c).try_cast("double"))


def envelope_fields(body: Column) -> Column:
    """The ``fields`` object of a parsed response, NULL when there is none."""
    fields = F.try_variant_get(body, "$.fields", "variant")
    return F.when(_is_object(body) & _is_object(fields), fields)


def parse_envelope(raw_text: Column) -> Column:
    """``struct(fields VARIANT, error_code)`` of a response body; anything but {"fields": {...}} is an error."""
    fields = envelope_fields(F.try_parse_json(raw_text))
    return F.struct(fields.alias("fields"), F.when(fields.isNull(), F.lit(BAD_RESPONSE)).alias("error_code"))


def map_fields(fields: Column) -> Column:
    """``map<name, struct(value, confidence, status)>`` over the known names; unknown names are ignored."""
    return let(F.try_variant_get(fields, "$", _ENTRIES), _mapped)


def _mapped(objects: Column) -> Column:
    """The map out of ``objects``, which has to be a column or a bound value: a step of a chain sees it once per name.

    Written as a chain of small array steps, so that each intermediate value exists once. A value's kind is looked at only where its
    text can be that of a container or a boolean, since telling the kind costs more than everything else.
    """
    names = F.array(*[F.lit(n) for n in FIELD_NAMES])
    entries = F.transform(names, lambda n: F.element_at(objects, n))
    texts = F.transform(entries, lambda e: F.struct(
        e.isNotNull().alias("known"), e["value"].alias("value"), e["confidence"].alias("confidence"),
        F.try_variant_get(e["value"], "$", "string").alias("text"), F.try_variant_get(e["confidence"], "$", "string").alias("number"),
    ))
    judged = F.transform(texts, lambda t: F.struct(
        t["known"].alias("known"), strip(t["text"]).alias("text"),
        F.when(F.startswith(t["text"], F.lit("{")) | F.startswith(t["text"], F.lit("[")), _is_container(t["value"])).otherwise(F.lit(False)).alias("container"),
        F.when(t["number"].isin("true", "false"), F.when(_kind(t["confidence"]) == "BOOLEAN", (t["number"] == "true").cast("double")))
        .otherwise(strip(t["number"]).try_cast("double")).alias("number"),
    ))
    results = F.transform(judged, lambda j: F.struct(
        F.when(~j["container"] & (j["text"] != ""), j["text"]).alias("value"),
        clamp_confidence(j["number"]).alias("confidence"),
        F.when(~j["known"], F.lit("MISSING")).when(j["container"], F.lit("UNCERTAIN")).when(j["text"] != "", F.lit("EXTRACTED")).otherwise(F.lit("MISSING")).alias("status"),
    ))
    return F.map_from_arrays(names, results)


def parse_model_responses(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``failed``, ``error_code``, ``fields`` and ``values`` to a table of raw responses.

    The steps are separate flat columns: a struct that is only taken apart again would be copied into every use, and a value that a
    lambda uses would be computed once per element.
    """
    body = F.try_parse_json(strip_fences(F.col(text)))
    enveloped = df.withColumn("_entries", F.try_variant_get(body, "$.fields", _ENTRIES))  # NULL unless both are objects
    bad = F.col("_entries").isNull()
    mapped = enveloped.select(
        *df.columns, bad.alias("failed"), F.when(bad, F.lit(BAD_RESPONSE)).alias("error_code"),
        F.when(~bad, _mapped(F.col("_entries"))).alias("fields"),
    )
    return mapped.withColumn("values", F.transform_values("fields", lambda _, f: f["value"]))


def response_text(raw: Column, shape: str) -> Column:
    """``struct(text, error_code)`` of a stored HTTP body; ``shape`` is 'candidates' or 'choices'."""
    body = F.try_parse_json(raw)
    if shape == "candidates":
        parts = F.try_variant_get(body, "$.candidates[0].content.parts", "array<variant>")
        # A part that is not an object is skipped; an object without text adds nothing.
        pieces = F.transform(
            F.filter(parts, _is_object), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
        )
        text = F.array_join(pieces, "")
    elif shape == "choices":
        content = F.try_variant_get(body, "$.choices[0].message.content", "variant")
        text = F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string"))
    else:
        raise ValueError(f"unknown response shape: {shape}")
    clean = F.nullif(strip_fences(text), F.lit(""))
    return F.struct(clean.alias("text"), F.when(clean.isNull(), F.lit(BAD_RESPONSE)).alias("error_code"))


def classify_status(http_status: Column, embedded_error: Column | None = None) -> Column:
    """Provider error code of a response, NULL when it is usable."""
    status = http_status
    if embedded_error is not None:
        status = F.when((http_status == 200) & (embedded_error != 0), embedded_error).otherwise(http_status)
    return (
        F.when(status == 200, F.lit(None).cast("string"))
        .when(status == 429, F.lit("PROVIDER_RATE_LIMITED"))
        .when(status.isin(401, 403), F.lit("PROVIDER_AUTH_ERROR"))
        .when(status == 400, F.lit("PROVIDER_BAD_REQUEST"))
        .otherwise(F.lit("PROVIDER_UNAVAILABLE"))
    )


def embedded_error_code(raw: Column) -> Column:
    """The error number inside a 200 body that carries an ``error`` object and no ``choices``; else NULL."""
    body = F.try_parse_json(raw)
    error = F.try_variant_get(body, "$.error", "variant")
    code = F.try_variant_get(error, "$.code", "string").try_cast("int")
    # A key that is present with a JSON null still yields a VARIANT, so NULL here means the key is absent.
    no_choices = F.try_variant_get(body, "$.choices", "variant").isNull()
    return F.when(_is_object(error) & no_choices, F.nullif(code, F.lit(0)))


def is_transient(code: Column) -> Column:
    """Whether a later try may succeed; unknown codes are terminal."""
    return code.isin(*[c for c, transient in PROVIDER_CODES.items() if transient])


def source_key(checksum: Column, ocr_text: Column) -> Column:
    """Identity of the extraction input: the file checksum, or a hash of the text when there is none."""
    return F.when(~is_blank(checksum), F.concat(F.lit("checksum:"), strip(checksum))).otherwise(
        F.concat(F.lit("text-sha256:"), F.sha2(ocr_text, 256))
    )


def cache_key(source: Column, pipeline_version: Column, route_chain: Column, prompt_version: Column,
              schema_version: Column) -> Column:
    """Hash of everything that must agree before a stored extraction may be reused."""
    return F.sha2(text_key("|", source, pipeline_version, route_chain, prompt_version, schema_version), 256)


def prompt_text(ocr_text: Column, instructions: str, document_type: Column | None = None,
                language: Column | None = None) -> Column:
    """Fill a prompt: instructions, optional context lines, then the document between fixed markers."""
    context = []
    if document_type is not None:
        context.append(F.when(document_type != "", F.concat(F.lit("Document type: "), document_type)))
    if language is not None:
        context.append(F.when(language != "", F.concat(F.lit("Language/script: "), language)))
    return F.concat_ws("\n", F.lit(instructions), *context, F.lit("<<<"), F.coalesce(ocr_text, F.lit("")), F.lit(">>>"))


def route_statistics(df: DataFrame, routes: str = "attempted_routes") -> DataFrame:
    """How often each provider and model was tried, with what outcome, and in how many attempts."""
    return (
        df.select(F.explode(routes).alias("r"))
        .groupBy(F.col("r.provider").alias("provider"), F.col("r.model").alias("model"),
                 F.col("r.outcome").alias("outcome"))
        .agg(F.count("*").alias("routes"), F.sum("r.attempts").alias("attempts"))
    )
