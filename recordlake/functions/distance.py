"""Edit distance, error rates and field verdicts.

Short texts use the built-in ``levenshtein``, short word sequences as well once each word is a character of its own. Its time grows
with the product of the lengths, and its bounded form is hardly faster on long texts, so longer pairs go through an Arrow function.
That follows the diagonals of the distance table, which takes length + distance^2 steps, and turns to whole columns of the table
held as bits where two texts have little in common. Texts are compared whole.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .text import compare_key

SHORT_TEXT = 512
SHORT_WORDS = 128
#: Edits up to which diagonals are followed one by one, items that all diagonals of an edit compare together, and diagonals below
#: which they no longer do.
FEW_EDITS, SHORT_RUN, FEW_RUNS = 24, 6, 3

# --- fixed values -----------------------------------------------------------
STRICT_FIELDS = (
    "survey_number",
    "khasra_number",
    "khata_number",
    "mutation_number",
    "registration_number",
    "record_date",
)
SIMILAR_ENOUGH = 0.8
NUMBER_TOLERANCE = 1e-9
# ----------------------------------------------------------------------------


def shared_start(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many items both sequences start with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_run(a: Sequence[Hashable], b: Sequence[Hashable], i: int, j: int) -> int:
    """How many items ``a`` from ``i`` and ``b`` from ``j`` have in common, compared in blocks that grow."""
    most = min(len(a) - i, len(b) - j)
    if most <= 0 or a[i] != b[j]:
        return 0
    done, block = 1, 16
    while done < most:
        block = min(block, most - done)
        if a[i + done:i + done + block] != b[j + done:j + done + block]:
            return done + shared_start(a[i + done:i + done + block], b[j + done:j + done + block])
        done, block = done + block, block * 4
    return done


def near_distance(a: Sequence[Hashable], b: Sequence[Hashable], steps: float) -> int | None:
    """Levenshtein distance by furthest places on diagonals (Ukkonen 1985), None once ``steps`` places did not reach the end.

    ``front`` holds, for each difference of places, how far in ``a`` the edits so far get. One more edit goes on from the same
    diagonal or from a neighbour, then along the items that agree. From ``FEW_EDITS`` on all diagonals take the step at once.
    """
    rows, columns = len(a), len(b)
    goal, edits = rows - columns, 0
    front = {0: shared_run(a, b, 0, 0)}
    while front.get(goal, -1) < rows:
        if edits == FEW_EDITS:
            return wide_distance(a, b, front, edits, steps)
        edits += 1
        steps -= 2 * edits + 1
        if steps < 0:
            return None
        further = {}
        for diagonal in range(-min(edits, columns), min(edits, rows) + 1):
            at = max(front.get(diagonal, -2) + 1, front.get(diagonal - 1, -2) + 1, front.get(diagonal + 1, -1))
            at = min(at, rows, columns + diagonal)
            further[diagonal] = at + shared_run(a, b, at, at - diagonal)
        front = further
    return edits


def numbered(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal ones for equal items; each ends with one that the other lacks."""
    known: dict[Hashable, int] = {}
    one, two = (np.fromiter((known.setdefault(x, len(known)) for x in s), np.int64, len(s)) for s in (a, b))
    return np.append(one, -1), np.append(two, -2)


def wide_distance(a: Sequence[Hashable], b: Sequence[Hashable], front: dict[int, int], edits: int, steps: float) -> int | None:
    """:func:`near_distance` from ``edits`` on with the diagonals of an edit in one array."""
    rows, columns = len(a), len(b)
    goal = rows - columns
    one, two = numbered(a, b)
    places = np.full(2 * edits + 3, -2, np.int64)  # one unused diagonal at each end
    for diagonal, at in front.items():
        places[diagonal + edits + 1] = at
    while True:
        edits += 1
        before = np.concatenate(([-2], places, [-2]))
        diagonals = np.arange(-edits - 1, edits + 2)
        at = np.maximum(before + 1, before)
        at[1:] = np.maximum(at[1:], before[:-1] + 1)
        at[:-1] = np.maximum(at[:-1], before[1:])
        at = np.minimum(at, np.minimum(rows, columns + diagonals))
        inside = (np.abs(diagonals) <= edits) & (diagonals >= -columns) & (diagonals <= rows)
        at[~inside] = -2
        going = np.flatnonzero(inside)
        for _ in range(SHORT_RUN):
            going = going[one[at[going]] == two[at[going] - diagonals[going]]]
            if len(going) <= FEW_RUNS:
                break
            at[going] += 1
        for k in going.tolist():
            at[k] += shared_run(a, b, int(at[k]), int(at[k] - diagonals[k]))
        if abs(goal) <= edits and at[goal + edits + 1] >= rows:
            return edits
        # An edit costs about as much as 60 places in plain Python, a place in the array a fiftieth of one.
        steps -= 60 + edits / 25 + 2 * len(going)
        if steps < 0:
            return None
        places = at


def sequence_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences. What both start or end with is left out first."""
    start = shared_start(a, b)
    a, b = a[start:], b[start:]
    end = shared_start(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    # A column costs as much as a step along diagonals, and as much again for every 4,000 rows; so a pair that has to be done over
    # costs about twice at most.
    found = near_distance(a, b, len(b) * (2 + len(a) / 4000))
    return column_distance(a, b) if found is None else found


def column_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance with one column of the distance table per step held as bits (Myers 1999, Hyyrö 2003).

    ``up`` and ``down`` mark the rows of the column where the distance rises or falls by one from the row above.
    """
    rows = len(a)
    if rows == 0:
        return len(b)
    places: dict[Hashable, list[int]] = {}
    for i, item in enumerate(a):
        places.setdefault(item, []).append(i)
    width = (rows + 7) // 8
    match = {}
    for item, at in places.items():
        bits = np.zeros(width * 8, dtype=np.uint8)
        bits[at] = 1
        match[item] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, last = (1 << rows) - 1, 1 << (rows - 1)
    up, down, distance = full, 0, rows
    for item in b:
        same = match.get(item, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return distance


@F.pandas_udf(IntegerType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(IntegerType())
def _long_word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else sequence_distance(x.split(" "), y.split(" ")) for x, y in zip(a, b)],
        dtype="Int32",
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _as_characters(words: Column, known: Column) -> Column:
    """One character per word: the one at U+0100 plus the word's place among the ``known`` words."""
    codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFF), 4, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def _short_word_distance(a: Column, b: Column) -> Column:
    words = F.struct(F.split(a, " ", -1).alias("a"), F.split(b, " ", -1).alias("b"))
    known = _let(words, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.array_distinct(F.concat(w["a"], w["b"])).alias("known")))
    return _let(known, lambda w: F.levenshtein(_as_characters(w["a"], w["known"]), _as_characters(w["b"], w["known"])))


def word_distance(a: Column, b: Column) -> Column:
    """Exact edit distance over blank-separated words; the empty text is one empty word."""
    blanks = F.greatest(*[F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) for c in (a, b)])
    long = (blanks >= SHORT_WORDS) & (a != b)
    return (
        F.when(a == b, F.lit(0)).when(long, _long_word_distance(F.when(long, a), F.when(long, b)))
        .when(a.isNotNull() & b.isNotNull(), _short_word_distance(a, b))
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Exact character edit distance."""
    long = (F.greatest(F.length(a), F.length(b)) > SHORT_TEXT) & (a != b)
    # A Python function runs for every row it is planned for; short and equal pairs reach it as NULL.
    return F.when(a == b, F.lit(0)).when(long, _long_distance(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b))


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Error rate of normalised texts by characters; an empty reference gives 0 or 1."""
    length = F.length(ref)
    return F.when(length == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(
        edit_distance(ref, hyp) / F.greatest(length, F.lit(1))
    )


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Error rate of normalised texts by words; the empty text is one empty word."""
    return word_distance(ref, hyp) / F.size(F.split(ref, " ", -1))


def error_rate(reference: Column, hypothesis: Column, unit: str) -> Column:
    """Error rate of ``hypothesis`` against ``reference``; unit 'char' or 'word'.

    For whole tables use :func:`with_error_rates`, which normalises each text once.
    """
    rates = {"char": char_error_rate, "word": word_error_rate}
    if unit not in rates:
        raise ValueError(f"unknown unit: {unit}")
    return rates[unit](compare_key(reference), compare_key(hypothesis))


def with_error_rates(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Add ``cer`` and ``wer``."""
    keyed = df.withColumns({"_ref": compare_key(F.col(reference)), "_hyp": compare_key(F.col(hypothesis))})
    return with_rates_of_keys(keyed, "_ref", "_hyp").drop("_ref", "_hyp")


def with_rates_of_keys(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add ``cer`` and ``wer`` of texts that are normalised already."""
    ref, hyp = F.col(reference), F.col(hypothesis)
    return df.select(*df.columns, char_error_rate(ref, hyp).alias("cer"), word_error_rate(ref, hyp).alias("wer"))


def numbers_equal(a: Column, b: Column) -> Column:
    x, y = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    return F.coalesce(F.abs(x - y) < NUMBER_TOLERANCE, F.lit(False))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio, NULL for a NULL; Spark has no such built-in."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _cheap_verdict(expected: Column, got: Column, field: Column) -> Column:
    """Verdict where built-in comparisons settle it, NULL where the similarity ratio has to decide."""
    exp, act = compare_key(expected), compare_key(got)
    inside = (exp != "") & (act != "") & (F.contains(act, exp) | F.contains(exp, act))
    return (
        F.when(expected.isNull() & got.isNull(), F.lit("CORRECT"))
        .when(expected.isNull(), F.lit("HALLUCINATED"))
        .when(got.isNull(), F.lit("MISSING"))
        .when((field == "area") & numbers_equal(expected, got), F.lit("CORRECT"))
        .when(exp == act, F.lit("CORRECT"))
        .when(field.isin(*STRICT_FIELDS), F.lit("INCORRECT"))
        .when(inside, F.lit("PARTIALLY_CORRECT"))
        # The ratio is 2*m/(len a + len b) with m at most the shorter length, so a large gap settles it too.
        .when(
            F.try_divide(2.0 * F.least(F.length(exp), F.length(act)), (F.length(exp) + F.length(act)).cast("double"))
            < SIMILAR_ENOUGH,
            F.lit("INCORRECT"),
        )
    )


def classify_fields(df: DataFrame, expected: str = "expected", got: str = "got",
                    field: str = "field_name") -> DataFrame:
    """Add ``verdict`` to rows of (field, expected, got).

    The similarity ratio is only computed for rows that the built-in comparisons leave open; the others reach it as NULL.
    """
    staged = df.withColumn("_settled", _cheap_verdict(F.col(expected), F.col(got), F.col(field)))
    is_open = F.col("_settled").isNull()
    ratio = similarity(F.when(is_open, compare_key(F.col(expected))), F.when(is_open, compare_key(F.col(got))))
    close = F.when(F.col("_ratio") >= SIMILAR_ENOUGH, F.lit("PARTIALLY_CORRECT")).otherwise(F.lit("INCORRECT"))
    return staged.withColumn("_ratio", ratio).select(*df.columns, F.coalesce("_settled", close).alias("verdict"))
