"""Document fingerprints by winnowing.

Every ``k`` code points get a 32-bit hash; of every ``window`` consecutive hashes the smallest is selected, the rightmost one if
several are. Two texts that share at least ``k + window - 1`` code points in a row share a selected hash, and selected places are at
most ``window`` apart. A fingerprint is the base64 form of all selected places (one byte each: the distance from the one before)
followed by their hashes (four bytes each), so the whole text is covered and nothing is capped.

A text shorter than ``k`` has one hash of all of it, an empty or null text none. Likeness is the share of distinct hashes two
fingerprints have in common; two without hashes are alike.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pieces, rolled, sliding_min

#: Code points hashed at once; blocks overlap, so the selection does not depend on it.
BLOCK = 1 << 18
OUT_BYTES = 4 << 20


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all ``k``-grams."""
    return rolled(points.astype(np.uint64) + np.uint64(1), k) >> np.uint64(32)


def select(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing selects."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    k = min(k, len(points))
    total = len(points) - k + 1
    window = min(window, total)
    found = []
    for at in range(0, total - window + 1, BLOCK):
        end = min(at + BLOCK, total - window + 1) + window - 1
        hashes = gram_hashes(points[at:end + k - 1], k)
        # Hash above, place from the right below: the smallest is the rightmost smallest hash.
        low = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(at, end, dtype=np.uint64))
        low = sliding_min(low, window)
        found.append(low[np.concatenate(([True], low[1:] != low[:-1]))])
    low = np.concatenate(found)
    low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64), (low >> np.uint64(32)).astype(np.uint32)


def encode(places: np.ndarray, hashes: np.ndarray) -> str:
    gaps = np.diff(places, prepend=0).astype(np.uint8)
    return base64.b64encode(gaps.tobytes() + hashes.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a fingerprint."""
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 5
    return np.cumsum(np.frombuffer(raw[:n], np.uint8).astype(np.int64)), np.frombuffer(raw[n:], "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = 12, window: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    def run(batches):
        for piece in pieces(batches):
            made = [encode(*select(t.decode(), k, window)) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    assert 1 <= window <= 255
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` partitions by ascending doc_id and sorted in each, then a row of the next partition (``ahead``).

    The partitions are cut at ids of the table, one quantile each, so the first id of a partition is known and its rows are dealt to
    the partition before as well. The last partition gets the first rows of all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.0))
    known = rows.agg(F.percentile_approx("doc_id", shares, F.lit(20 * max(500, parts))).alias("cuts"), F.min("doc_id").alias("least"),
                     F.max(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    cuts = sorted({c for c in known.cuts or [] if c > known.least}) if parts > 1 else []
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right").astype(np.int32))

    starts = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    first = F.col("doc_id").isNull() if known.nulls else F.col("doc_id") == F.lit(known.least)
    to = F.array_compact(F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("ahead")),
                                 F.when(starts, F.struct((F.col("own") - 1).alias("part"), F.lit(1).alias("ahead"))),
                                 F.when(first, F.struct(F.lit(len(cuts)).alias("part"), F.lit(1).alias("ahead")))))
    dealt = rows.withColumn("own", bucket("doc_id")).select("doc_id", "text", F.inline(to))
    order = [F.col("ahead"), F.col("doc_id").asc_nulls_first(), F.col("text")]
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(*order)


def edited_fingerprints(docs: DataFrame, k: int = 12, window: int = 32, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter gives way to the start of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Documents follow each other
    by ascending doc_id, null ids first and rows of one id by their texts; the first follows the last, so a single row follows
    itself. An empty table gives an empty one.
    """
    assert 1 <= window <= 255
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
        rows, size, last = [], 0, None
        for piece in pieces(batches):
            for i, text, ahead in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if last is not None and last[3]:
                    break  # the rows ahead after the first are not needed
                places, hashes = select(text, k, window)
                own = np.unique(hashes)
                if last is not None:
                    was_id, was, was_print, _, was_own = last
                    cut = len(was) // 4
                    edited = was[:len(was) - cut] + text[:cut]
                    e_places, e_hashes = select(edited, k, window)
                    rows.append((was_id, len(was), hashlib.sha256(edited.encode()).hexdigest(), was_print, encode(e_places, e_hashes),
                                 likeness(was_own, np.unique(e_hashes)), likeness(was_own, own)))
                    size += len(was)
                last = (i, text, "" if ahead else encode(places, hashes), ahead, own)
                if size > OUT_BYTES:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return in_order(docs, parts).select("doc_id", "text", "ahead").mapInArrow(run, schema)
