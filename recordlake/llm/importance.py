"""Importance resampling towards a target: documents drawn by how much more likely their word runs are in the target's texts.

1. A feature is a run of one to ``RUN`` consecutive words (A-Z lowered, words of ASCII letters, digits and characters beyond ASCII,
   joined by one space); its bucket is its crc32 modulo ``BUCKETS``. Both corpora are counted by bucket, a small array per task.
2. A bucket's gain is the logarithm of the smoothed ratio of its two shares. A document's weight is the sum over its features, looked
   up in the array of gains; its score adds noise that depends on seed and id alone, so the highest scores are a weighted draw.
3. Ranks come from parallel sorting by regular sampling: the scores lie in a bounded number of locally sorted runs, every ``gap``-th
   row of a run is a sample, and every so many samples are a splitter. Exact counts by segment say which segments can hold drawn
   rows; only those are exchanged, sorted locally and numbered from the count of all earlier segments.

A null text has no words, a null id counts as an empty one in the noise and as larger than all ids in ties. Repeated rows are drawn
like any others; rows equal in score and id are told apart by their place in the stored scores. Other columns are not read. An empty
table gives an empty one, an empty target only changes the gains. Words are cut in blocks, so a long text needs no more memory than
its own bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import TO_WORDS, id_and_text, per_text, pieces, stored

BUCKETS = 10_000
RUN = 3
#: Bytes of a text whose words are taken at once.
BLOCK_BYTES = 1 << 20
#: Sorted runs, samples that come to the driver, and segments: all fixed, whatever the tables hold.
MAX_RUNS, MAX_SAMPLES, MAX_SEGMENTS = 512, 1 << 18, 512


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of one block of the text after the other."""
    text = text.translate(TO_WORDS)
    at, before = 0, []
    while at < len(text):
        end = text.find(b" ", at + BLOCK_BYTES)
        end = len(text) if end < 0 else end
        words = before + text[at:end].split()
        sums = list(map(crc32, words))
        found = sums[len(before):]
        spaced = [b" " + w for w in words]
        for longer in range(1, RUN):
            # A checksum goes on from that of the run one word shorter.
            sums = list(map(crc32, spaced[longer:], sums))
            found += sums[max(0, len(before) - longer):]
        yield len(words) - len(before), np.array(found, np.uint32) % BUCKETS
        at, before = end, words[1 - RUN:]


def bucket_counts(texts: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most ``BUCKETS`` rows leave a task and come to the driver."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches):
            for text in piece.column("text").to_pylist():
                for _, buckets in features(text):
                    total += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = id_and_text(texts, id_col, text_col).select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, in thousandths rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of the id, in thousandths rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score) of every row; ``text_hash`` is xxhash64 of the text."""
    def of(text: bytes) -> tuple[int, int, int]:
        words = count = weight = 0
        for n, buckets in features(text):
            words, count, weight = words + n, count + len(buckets), weight + int(gain[buckets].sum())
        return words, count, weight

    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    out = texts.mapInArrow(per_text(of, "n_words long, n_features long, weight long", ("doc_id", "text_hash")),
                           "doc_id long, text_hash long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise("doc_id", seed))


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    """What rows are ordered by: the negative score, and (negative score, no id, id, row)."""
    negative = -batch.column("score").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id").to_pylist()
    return negative, [(s, i is None, i or 0, r) for s, i, r in zip(negative.tolist(), ids, batch.column("row").to_pylist())]


def ranked(scores: DataFrame, drawn: int, segment_rows: int = 1024, least_gap: int = 64, max_runs: int = MAX_RUNS) -> DataFrame:
    """``scores(doc_id, score, row, ...)``, ``row`` unique, with ``rank`` 1, 2, 3, ... of the ``drawn`` highest scores, null for all others.

    Ties go to the smaller doc_id. A segment holds at most ``segment_rows`` (or drawn / MAX_SEGMENTS) rows and ``runs`` * ``gap`` more.
    """
    if drawn <= 0:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    runs = stored(scores.coalesce(max_runs).sortWithinPartitions(*order))
    n = runs.count()
    gap = max(least_gap, -(-n // MAX_SAMPLES))
    step = max(segment_rows, -(-drawn // MAX_SEGMENTS), gap)

    def regular(batches):
        seen = 0
        for batch in batches:
            at = np.arange((gap - 1 - seen) % gap, batch.num_rows, gap)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    samples = runs.select("score", "doc_id", "row").mapInArrow(regular, "score long, doc_id long, row long").toArrow().combine_chunks()
    keys = sorted(k for batch in samples.to_batches() for k in _keys(batch)[1])
    # A sample at place q has between q * gap and (q + runs) * gap rows before it, so the last splitter lies behind all drawn rows.
    last = drawn // gap + 1
    splitters = keys[step // gap:last:step // gap] + keys[last:last + 1]
    bounds = np.array([k[0] for k in splitters], np.int64)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in scores.schema)}, segment int"

    def dealt(batches):
        for batch in batches:
            negative, keys = _keys(batch)
            segment = np.searchsorted(bounds, negative, side="left")
            for i in np.flatnonzero(segment != np.searchsorted(bounds, negative, side="right")).tolist():
                segment[i] = bisect_right(splitters, keys[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment.astype(np.int32))], [*batch.schema.names, "segment"])

    parts = runs.mapInArrow(dealt, schema)
    sizes = {r["segment"]: r["n"] for r in parts.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([sizes.get(i, 0) for i in range(len(splitters) + 1)]))).tolist()
    some = sum(b < drawn for b in before[:-1])
    at = F.row_number().over(W.partitionBy("segment").orderBy(*order)) + F.element_at(F.array(*[F.lit(b) for b in before]), F.col("segment") + 1)
    exchanged = parts.filter(F.col("segment") < some).withColumn("rank", F.when(at <= drawn, at.cast("long")))
    rest = parts.filter(F.col("segment") >= some).withColumn("rank", F.lit(None).cast("long"))
    return exchanged.unionByName(rest).drop("segment")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", **sorting) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) for every row of ``docs``.

    Of the documents with at least ``min_words`` words the ``percent`` of a hundred (rounded down) with the highest scores are drawn;
    ``rank`` numbers them and is null for all others.
    """
    gain = gains(bucket_counts(docs, id_col, text_col), bucket_counts(target.withColumn("_", F.lit(0)), "_", target_text))
    rows = stored(scored(docs, gain, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    drawn = rows.filter(able).count() * percent // 100
    out = ranked(rows.filter(able), drawn, **sorting).unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.drop("row")


def drawn_documents(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; of rows equal in id and text all stay if one is drawn."""
    keep = resampled.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) == F.col("_hash")
    return docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & same, "left_semi")
