"""Value normalisation and typed coercion (one Column in, one Column out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELD_NAMES
from .text import SPACE, WHITESPACE, empty_to_null, is_blank, let, literal_map, normalize_text, strip

# --- fixed values -----------------------------------------------------------
UNIT_SYNONYMS = {
    "hectare": "hectare",
    "hectares": "hectare",
    "ha": "hectare",
    "acre": "acre",
    "acres": "acre",
    "sqm": "sqm",
    "sq.m.": "sqm",
    "sq meter": "sqm",
    "sq meters": "sqm",
    "sq metre": "sqm",
    "sq metres": "sqm",
}
KNOWN_UNITS = ("hectare", "acre", "sqm")
AREA_PATTERN = (
    rf"(?U)^[{WHITESPACE}]*-?[{WHITESPACE}]*\d[\d,{WHITESPACE}]*(\.[{WHITESPACE}]*\d[\d{WHITESPACE}]*)?\z"
)
YEAR_FIRST = r"^((?!0000)\d{4}-\d{1,2}-\d{1,2})\z"
YEAR_LAST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})\z"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}\z"
# ----------------------------------------------------------------------------

AREA_TYPE = "decimal(38,10)"


def parse_area(c: Column) -> Column:
    """``struct(value, numeric)``: grouping commas and whitespace go from a number; other text stays as written."""
    numeric = F.coalesce(F.regexp_like(c, F.lit(AREA_PATTERN)), F.lit(False))
    value = F.when(numeric, F.regexp_replace(c, f",|{SPACE}", "")).otherwise(empty_to_null(strip(c)))
    return F.struct(value.alias("value"), numeric.alias("numeric"))


def is_positive_number(c: Column) -> Column:
    """For text of digits, sign and point: true when the number is above zero."""
    has_digit = F.regexp_like(c, F.lit(r"(?U)[\d&&[^0\x{0660}\x{06F0}\x{0966}\x{0AE6}]]"))
    return ~F.startswith(c, F.lit("-")) & has_digit


def normalize_unit(c: Column) -> Column:
    """Map known spellings to hectare, acre or sqm; keep unknown units trimmed."""
    known = F.element_at(literal_map(UNIT_SYNONYMS), F.lower(normalize_text(c)))
    return F.coalesce(known, empty_to_null(strip(c)), c)


def parse_date(c: Column) -> Column:
    """DATE for year-month-day and for day-month-year with dashes, slashes or dots; NULL otherwise."""
    return stripped_date(strip(c))


def stripped_date(stripped: Column) -> Column:
    year_first = F.regexp_replace(stripped, YEAR_LAST, "$4-$3-$1")
    return F.regexp_extract(year_first, YEAR_FIRST, 1).try_cast("date")


def normalize_date(c: Column) -> Column:
    """ISO text for a recognised date, the trimmed text otherwise."""
    # A bound value: stripped once, and a projection with a lambda is not compiled into one method too long for the JVM's compiler.
    return let(strip(c), lambda text: F.coalesce(stripped_date(text).cast("string"), empty_to_null(text), c))


def looks_iso(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(ISO_SHAPE)), F.lit(False))


def normalized_field(name: str, c: Column) -> Column:
    if name == "area":
        return parse_area(c)["value"]
    if name == "area_unit":
        return normalize_unit(c)
    if name == "record_date":
        return normalize_date(c)
    return normalize_text(c)


def normalize_record(df: DataFrame) -> DataFrame:
    """Normalise the record columns of ``df`` and add ``originals``, the raw text of every changed field."""
    names = [n for n in FIELD_NAMES if n in df.columns]
    raw = {n: F.col(n).cast("string") for n in names}
    # Two projections, so that a normalised value is computed once and then compared.
    staged = df.select(
        *[normalized_field(c, raw[c]).alias(c) if c in raw else F.col(c) for c in df.columns if c != "originals"],
        *[raw[n].alias(f"_raw_{n}") for n in names],
    )
    changed = [F.when(~F.col(f"_raw_{n}").eqNullSafe(F.col(n)), F.col(f"_raw_{n}")) for n in names]
    originals = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*changed)), lambda _, v: v.isNotNull()
    )
    return staged.select(*[c for c in df.columns if c != "originals"], originals.alias("originals"))


def coerce_record_date(c: Column) -> Column:
    """``struct(value DATE, dropped)``: only the extended ISO form is storable; blanks are not a loss."""
    text = strip(c)
    value = F.when(looks_iso(text), F.try_to_date(text, "yyyy-MM-dd"))
    return F.struct(value.alias("value"), (~is_blank(c) & value.isNull()).alias("dropped"))


def coerce_area(c: Column) -> Column:
    """``struct(value DECIMAL(38,10), dropped)``: finite decimals only; blanks are not a loss."""
    value = strip(c).try_cast(AREA_TYPE)
    return F.struct(value.alias("value"), (~is_blank(c) & value.isNull()).alias("dropped"))


def coerce_typed_columns(df: DataFrame) -> DataFrame:
    """Store ``area`` and ``record_date`` typed; what cannot be stored becomes NULL and is kept in ``dropped``."""
    typed = {"record_date": coerce_record_date(F.col("record_date").cast("string")),
             "area": coerce_area(F.col("area").cast("string"))}
    dropped = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in typed]),
            F.array(*[F.when(s["dropped"], F.col(n).cast("string")) for n, s in typed.items()]),
        ),
        lambda _, v: v.isNotNull(),
    )
    return df.select(
        *[typed[c]["value"].alias(c) if c in typed else F.col(c) for c in df.columns if c != "dropped"],
        dropped.alias("dropped"),
    )
