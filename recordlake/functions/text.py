r"""Text helpers every other module builds on.

Whitespace here is Unicode whitespace plus the four ASCII separators, so a no-break space or a tab counts
the same as a blank. Plain ``trim`` and the default ``\s`` of the regex engine would miss both. The characters are
listed, because a listed class is matched much faster than a Unicode property. Every helper uses its argument as few
times as it can: these expressions are nested, and a repeated argument multiplies the whole tree below it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"\t-\r\x1c-\x1f \x85\xa0  -     　"
# Visible ASCII is ruled out by two ranges before the long list is looked at.
SPACE = rf"[\x00-\x20\x7f-￿&&[{WHITESPACE}]]"
_ODD_SPACE = rf"[\x00-\x1f\x7f-￿&&[{WHITESPACE}]]"
_RUN = f"{SPACE}+"
# Only runs that differ from a single blank, so that clean text is returned as it is.
_UNTIDY = f" {SPACE}+|{_ODD_SPACE}{SPACE}*"
_EDGES = rf"^{SPACE}+|{SPACE}+\z"
_INK = f"[!-~]|[^{WHITESPACE}]"


def strip(c: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def strip_long(c: Column) -> Column:
    """:func:`strip` for whole documents: a text that neither starts nor ends with whitespace is not searched."""
    def ends(text: Column) -> Column:
        return F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))

    return let(c, lambda text: F.when(F.regexp_like(ends(text), F.lit(SPACE)), strip(text)).otherwise(text))


def squash(c: Column) -> Column:
    """Remove all whitespace."""
    return F.regexp_replace(c, _RUN, "")


def normalize_text(c: Column) -> Column:
    """Trim and turn inner whitespace runs into one blank; case is kept."""
    return F.trim(F.regexp_replace(c, _UNTIDY, " "))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only strings."""
    return ~F.coalesce(F.regexp_like(c, F.lit(_INK)), F.lit(False))


def rules_key(c: Column) -> Column:
    """Key for reference lookups: trimmed and lower-cased, '' for NULL."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def compare_key(c: Column) -> Column:
    """Key for duplicate checks and text comparison: whitespace collapsed, lower-cased, '' for NULL."""
    return F.coalesce(F.lower(normalize_text(c)), F.lit(""))


def empty_to_null(c: Column) -> Column:
    """An empty correction value means 'no value'."""
    return F.nullif(c, F.lit(""))


def escape_like(c: Column) -> Column:
    """Escape ``\\``, ``%`` and ``_`` so that text matches literally inside LIKE."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def quoted(c: Column) -> Column:
    """Quote a value for a message: single quotes, or double ones when the text holds only single quotes."""
    body = F.regexp_replace(c, r"\\", r"\\\\")
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(~has_single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~has_double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def text_key(separator: str, *cols: Column) -> Column:
    """Join identity parts into one string, keeping NULL parts as empty text."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def literal_map(values: dict[str, str]) -> Column:
    """A constant string-to-string lookup."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it and however far the optimizer moves the whole."""
    return F.transform(F.array(value), body)[0]
