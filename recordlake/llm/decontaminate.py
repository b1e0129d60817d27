"""Benchmark passages in documents, found by spaced seeds that tolerate substituted words.

A document holds a passage of an item if ``window`` words in a row agree with ``window`` words in a row of the item in all but
``max_errors`` places. An item with fewer words, but at least ``min_words``, must stand whole, with up to ``short_errors``
substituted words. Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered, so case and punctuation do not
matter.

Items of fewer than ``min_words`` words are too common as running text to give a document up for. They are looked for as a whole line
or a whole sentence with the same words and reported apart, in ``short_item_id`` and ``n_short`` of ``flagged``; ``clean`` keeps such
documents. An item without a word is found nowhere.

Seeds. The places of a window are dealt in turn to ``errors + 2`` classes. A mask ignores the places of ``errors`` classes
and hashes the words at the others; whatever places are substituted, one mask ignores them all, so each such window shares the hash
of some mask with the item. Hashes of the items and of the documents are joined, and the words of both windows are compared.

Only document windows whose hash may be an item's are sent to the join. That is looked up in a bitmap whose size is fixed by
``log_bits`` whatever the number of items; a bit set by chance costs a row, never a wrong result. Item windows with the same words
count once, under their smallest item.

Rows are told apart by id and text; null ids are allowed, a null text has no words, equal rows get equal results. An item without
id still counts. Empty tables give empty results, and an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, bitmap_of, fresh, id_and_text, in_bitmap, mixed, pieces, plain_words, segments, stored


def masks(window: int, max_errors: int) -> list[tuple[int, ...]]:
    """The places that each mask looks at."""
    classes = max_errors + 2
    return [tuple(i for i in range(window) if i % classes not in ignored) for ignored in combinations(range(classes), max_errors)]


def shapes_of(window: int, max_errors: int, min_words: int, short_errors: int) -> dict[int, list[tuple[int, ...]]]:
    """The masks of every size of window that is looked for."""
    return {size: masks(size, max_errors if size == window else short_errors) for size in range(min(min_words, window), window + 1)}


def mask_hashes(words: np.ndarray, window: int, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """For every mask the hashes of all windows of the word hashes."""
    powers = [pow(MULTIPLIER, i + 1, 1 << 64) for i in range(window)]
    n = len(words) - window + 1
    out = []
    for number, places in enumerate(shapes, 1):
        total = np.full(n, number * MULTIPLIER % (1 << 64), np.uint64)
        for i in places:
            total += words[i:i + n] * np.uint64(powers[i])
        out.append(mixed(total))
    return out


def window_words(words: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The word hashes of the windows at ``at`` as lists of longs."""
    taken = words[at[:, None] + np.arange(size)].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(taken.ravel()))


def windows(texts: list[bytes], size: int, shapes: list[tuple[int, ...]], keep=None):
    """(text number, word place, hash, word hashes) of all windows of ``size`` words under every mask; ``keep`` chooses by hash."""
    for seg in segments(texts, plain_words, size):
        at = seg.windows(size)
        for hashes in mask_hashes(seg.hashes, size, shapes) if len(at) else ():
            own = hashes[at]
            chosen = slice(None) if keep is None else keep(own)
            if len(at[chosen]):
                yield *seg.places(at[chosen]), own[chosen], window_words(seg.hashes, at[chosen], size)


def item_seeds(benchmark: DataFrame, window: int, max_errors: int, min_words: int, short_errors: int, id_col: str, text_col: str) -> DataFrame:
    """(seed, size, words, item_id): distinct windows of the items under every mask, and whole short items under theirs."""
    shapes = shapes_of(window, max_errors, min_words, short_errors)

    def run(batches):
        for piece in pieces(batches):
            ids, texts = piece.column("doc_id"), piece.column("text").to_pylist()
            counts = np.array([len(plain_words(t)) for t in texts])
            for size in [window, *range(min_words, window)]:
                chosen = np.flatnonzero(counts >= window if size == window else counts == size)
                if not len(chosen):
                    continue
                for text, _, seeds, words in windows([texts[i] for i in chosen], size, shapes[size]):
                    yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), size, np.int32)), words,
                                                      ids.take(pa.array(chosen[text]))], ["seed", "size", "words", "item_id"])

    found = id_and_text(benchmark, id_col, text_col).mapInArrow(run, "seed long, size int, words array<long>, item_id long")
    return found.groupBy("seed", "size", "words").agg(F.min("item_id").alias("item_id"))


def passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_errors: int = 2, min_words: int = 8, short_errors: int = 1, log_bits: int = 25,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, first_word, last_word) of the rows that hold a passage.

    item_id is the smallest of the items found, n_windows the number of verified windows, and the words are those of the first and
    the last of them.
    """
    seeds = stored(item_seeds(benchmark, window, max_errors, min_words, short_errors, item_col, item_text))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(seeds, "seed", log_bits))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most window - min_words + 1
    shapes = shapes_of(window, max_errors, min_words, short_errors)

    def run(batches):
        for piece in pieces(batches):
            ids, hashes, texts = piece.column("doc_id"), piece.column("text_hash"), piece.column("text").to_pylist()
            for size in sizes:
                for text, place, seed, words in windows(texts, size, shapes[size], lambda h: in_bitmap(bits.value, h)):
                    who = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), size, np.int32)), words, ids.take(who), hashes.take(who),
                                                      pa.array(place)], ["seed", "size", "doc_words", "doc_id", "text_hash", "place"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    hits = rows.mapInArrow(run, "seed long, size int, doc_words array<long>, doc_id long, text_hash long, place long").distinct()
    errors = F.aggregate(F.zip_with("doc_words", "words", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    allowed = F.when(F.col("size") == window, F.lit(max_errors)).otherwise(F.lit(short_errors))
    verified = hits.join(seeds, ["seed", "size"]).filter(errors <= allowed)
    # A window can be hit under several masks and items; it counts once.
    return (verified.groupBy("doc_id", "text_hash", "place", "size").agg(F.min("item_id").alias("item_id"))
            .groupBy("doc_id", "text_hash").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_windows"), F.min("place").alias("first_word"),
                                                F.max(F.col("place") + F.col("size") - 1).alias("last_word")))


def joined_words(text: Column) -> Column:
    """The words of a string joined by one space."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_join(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1), " ")


def short_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, short_item_id, n_short) of the rows with a line or sentence that has the words of an item of fewer than ``min_words``.

    A sentence ends at a line end, or at full stops, exclamation or question marks that whitespace follows. n_short counts items with
    different words, short_item_id is the smallest of them.
    """
    def size(words: Column) -> Column:
        return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1)

    items = id_and_text(benchmark, item_col, item_text).select(F.col("doc_id").alias("item_id"), joined_words(F.col("text").cast("string")).alias("words"))
    items = items.filter(size(F.col("words")).between(1, min_words - 1)).groupBy("words").agg(F.min("item_id").alias("item_id"))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    units = F.concat(F.array("line"), F.split("line", r"[.!?\u3002\uff01\uff1f]+(?=\s|$)"))
    found = rows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform(units, joined_words))).alias("words"))
    found = found.filter(size(F.col("words")).between(1, min_words - 1)).join(items, "words")
    # Counted once per item before rows meet, so that a line that is everywhere costs one row per text.
    return (found.groupBy("doc_id", "text_hash", "words").agg(F.min("item_id").alias("item_id"))
            .groupBy("doc_id", "text_hash").agg(F.min("item_id").alias("short_item_id"), F.count("*").alias("n_short")))


def flagged(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, **how) -> DataFrame:
    """(doc_id, contaminated, item_id, n_windows, first_word, last_word, short_item_id, n_short) for every row of ``docs``.

    Nulls and 0 where it is clean; an item of fewer than ``min_words`` words does not make a row contaminated.
    """
    rows = id_and_text(docs).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    both = passages(docs, benchmark, min_words=min_words, **how).unionByName(short_matches(docs, benchmark, min_words), allowMissingColumns=True)
    found = both.groupBy("doc_id", "text_hash").agg(*[F.max(c).alias(c) for c in both.columns[2:]])
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n_windows").isNotNull().alias("contaminated"), "item_id",
                         F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "first_word", "last_word", "short_item_id", F.coalesce("n_short", F.lit(0)).alias("n_short"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of the benchmark."""
    names = [fresh(docs.columns, n) for n in ("leak_id", "leak_hash")]
    found = passages(docs, benchmark, **how).select("doc_id", "text_hash").toDF(*names)
    same_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")) == F.col(names[1])
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & same_text, "left_anti")
