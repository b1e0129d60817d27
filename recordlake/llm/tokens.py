"""Encoded lengths of documents and the exact histogram that answers questions about every context limit."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_and_text, pieces, stored

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(path: str | None = None) -> str:
    """The tokenizer file as this machine sees it."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from text to uint32 ids, for a byte-level BPE file whose ids follow the order of its merges.

    The file is one of the tokenizers library; its vocabulary runs in tiktoken here, which gives the same ids several times faster.
    A special token's string in a text becomes that token, as tokenizers does without further settings.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary_path(path), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length) for every row, over whole texts; a null or empty text has 0 tokens."""
    def run(batches):
        encode = encoder(path)
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(encode(t.decode())) for t in piece.column("text").to_pylist()], pa.int64())],
                                             ["doc_id", "length"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, length long")


def length_histogram(counts: DataFrame, chunk: int = 1024) -> DataFrame:
    """One row per occurring ``length``, exact over all rows of ``counts(length)``.

    ``docs`` and ``tokens`` are those of the length itself, ``docs_from`` and ``tokens_from`` those of this length or more,
    ``docs_to`` those of this length or less, so the quantile of share q is the first length with docs_to >= q * all_docs.
    ``truncated_tokens`` is what stays of all documents cut to this length. Sums run from the longest length down in two steps, within
    chunks of lengths and over the chunks, so no step sees more than ``chunk`` lengths or one row per chunk. An empty table gives an
    empty one; null lengths are left out.
    """
    # Stored, one row per length, since the sums read it twice and texts are encoded once.
    lengths = stored(counts.filter("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("docs")))
    lengths = lengths.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("chunk", F.floor(F.col("length") / chunk).cast("long"))
    chunks = lengths.groupBy("chunk").agg(F.sum("docs").alias("chunk_docs"), F.sum("tokens").alias("chunk_tokens"))
    longer = W.orderBy(F.col("chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("one").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    chunks = chunks.withColumn("one", F.lit(1)).select(
        "chunk", F.coalesce(F.sum("chunk_docs").over(longer), F.lit(0)).alias("longer_docs"), F.coalesce(F.sum("chunk_tokens").over(longer), F.lit(0)).alias("longer_tokens"),
        F.sum("chunk_docs").over(whole).alias("all_docs"), F.sum("chunk_tokens").over(whole).alias("all_tokens"))
    down = W.partitionBy("chunk").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = lengths.withColumn("d", F.sum("docs").over(down)).withColumn("t", F.sum("tokens").over(down)).join(chunks, "chunk")
    docs_from, tokens_from = F.col("longer_docs") + F.col("d"), F.col("longer_tokens") + F.col("t")
    return summed.select("length", "docs", "tokens", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
                         (F.col("all_docs") - docs_from + F.col("docs")).alias("docs_to"),
                         (F.col("all_tokens") - tokens_from + F.col("tokens") + F.col("length") * (docs_from - F.col("docs"))).alias("truncated_tokens"),
                         "all_docs", "all_tokens")


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """(tokens) that stay of all documents cut to ``limit``, for any limit, from the histogram alone."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """(length): the least length that at least ``share`` of the documents do not exceed."""
    return histogram.filter(F.col("docs_to") >= F.lit(share) * F.col("all_docs")).agg(F.min("length").alias("length"))
