"""Passages repeated across documents, found as the repeated part of a de Bruijn graph.

Edges are the windows of ``k`` words; consecutive windows of a text share the k-1 words of the node between them. Only edges that
occur in several documents matter, so the graph is never built whole:

1. A window's minimizer is the least hash of the runs of ``m`` words in it. Equal windows have equal minimizers, and neighbouring
   windows mostly share theirs, so a text has about 2 / (k - m + 2) of them per word. Minimizers seen in several documents are
   marked in a bitmap of fixed size. A window whose minimizer is not marked occurs in one document only.
2. The other windows, the candidate edges, are gathered over all documents: each belongs to the document with the least id that has
   it, its owner, and keeps its place there. Tasks send an edge once, so an edge that is everywhere costs one row per task.
3. Edges that follow each other in their owner compact into paths with the owner's coordinates. Asked for the repeated passages
   themselves, a path also ends where edges that other documents share give way to others.
4. Paths are joined to the documents by owner. In a document, candidate edges that none of its own paths holds start in an earlier
   document too; runs of them are the spans whose words go.

The bitmap only saves work: marks that are set by chance make a window a candidate, which its one document then owns. Windows are
told apart by 64-bit hashes.

Documents are compared by id; a null id is one document before all others, and rows of one id are one document. A null text has no
words. Equal rows get equal results. An empty table gives an empty one.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, id_and_text, in_bitmap, mixed, pieces, rolled, segments, sliding_min

NO_ID = -(1 << 63)


def minimizers(hashes: np.ndarray, k: int, m: int) -> np.ndarray:
    """The minimizer of every window, ready to be looked up."""
    return sliding_min(rolled(hashes, m), k - m + 1)


def marked_minimizers(rows: DataFrame, k: int, m: int, log_bits: int) -> np.ndarray:
    """The bitmap of minimizers that occur in several documents of ``rows(doc_id, text)``."""
    def run(batches):
        for piece in pieces(batches):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            for seg in segments(piece.column("text").to_pylist(), bytes.split, k):
                at = seg.windows(k)
                low, of = minimizers(seg.hashes, k, m)[at], ids[seg.places(at)[0]]
                new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (of[1:] != of[:-1]))))
                low, of = low[new], of[new]
                order = np.argsort(low, kind="stable")
                low, of = low[order], of[order]
                first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                several = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
                # Mixed anew: minimizers are small numbers.
                yield pa.RecordBatch.from_arrays([pa.array(mixed(low[first]).view(np.int64)), pa.array(several)], ["low", "several"])

    seen = rows.mapInArrow(run, "low long, several boolean").groupBy("low").agg(F.count("*").alias("n"), F.max("several").alias("several"))
    return bitmap_of(seen.filter("n > 1 OR several"), "low", log_bits)


def candidates(hashes: np.ndarray, at: np.ndarray, k: int, m: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at ``at``: which are candidate edges, and the edges."""
    which = in_bitmap(bits, mixed(minimizers(hashes, k, m)[at]))
    return which, rolled(hashes, k)[at[which]]


def edges(rows: DataFrame, k: int, m: int, bits, shared: bool = False) -> DataFrame:
    """(edge, owner, place[, repeated]): the candidate edges of ``rows(doc_id, text)``, each with the first document it starts in.

    With ``shared`` also whether another document has it.
    """
    def run(batches):
        for piece in pieces(batches):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            for seg in segments(piece.column("text").to_pylist(), bytes.split, k):
                at = seg.windows(k)
                which, found = candidates(seg.hashes, at, k, m, bits.value)
                text, place = seg.places(at[which])
                of = ids[text]
                order = np.lexsort((place, of, found))
                found, of, place = found[order], of[order], place[order]
                new = found[1:] != found[:-1]
                first, last = np.flatnonzero(np.concatenate(([True], new))[:len(found)]), np.flatnonzero(np.concatenate((new, [True]))[:len(found)])
                yield pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), pa.array(of[first]), pa.array(of[first] < of[last]), pa.array(place[first].astype(np.int32))],
                                                 ["edge", "doc", "several", "place"])

    sent = rows.mapInArrow(run, "edge long, doc long, several boolean, place int")
    repeated = [(F.max("several") | (F.min("doc") < F.max("doc"))).alias("repeated")] if shared else []
    return sent.groupBy("edge").agg(F.min("doc").alias("owner"), F.min_by("place", "doc").alias("place"), *repeated)


def paths(found: DataFrame) -> DataFrame:
    """(owner, start, edges[, repeated]): maximal runs of ``edges`` that follow each other in their owner, all repeated or all not."""
    along = Window.partitionBy("owner").orderBy("place")
    follows = F.col("place") - F.lag("place").over(along) <= 1
    kind = [c for c in ("repeated",) if c in found.columns]
    for c in kind:
        follows = follows & (F.col(c) == F.lag(c).over(along))
    # Rows of one id with different texts can have two edges at one place; both stay.
    number = F.sum(F.when(F.coalesce(F.col("follows"), F.lit(False)), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = found.withColumn("follows", follows).withColumn("path", number)
    return numbered.groupBy("owner", "path").agg(F.min("place").alias("start"), F.collect_list("edge").alias("edges"), *[F.first(c).alias(c) for c in kind]).drop("path")


def repeated_passages(docs: DataFrame, k: int = 13, m: int = 5, log_bits: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(owner, start, n_words): the compacted paths whose windows occur in several documents, at their place in the first of them."""
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    bits = docs.sparkSession.sparkContext.broadcast(marked_minimizers(rows, k, m, log_bits))
    found = paths(edges(rows, k, m, bits, shared=True)).filter("repeated")
    return found.select(real_id(F.col("owner")).alias("owner"), "start", (F.size("edges") + k - 1).alias("n_words"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with a number below all others for a null id."""
    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def real_id(key: Column) -> Column:
    return F.nullif(key, F.lit(NO_ID))


def removed_words(text: bytes, own: np.ndarray, k: int, m: int, bits: np.ndarray) -> tuple[list[bytes], np.ndarray, int]:
    """Words of a text, which of them lie in a span of foreign edges, and the number of such spans."""
    words = text.split()
    foreign = np.zeros(max(0, len(words) - k + 1), bool)
    for seg in segments([text], bytes.split, k):
        at = seg.windows(k)
        which, found = candidates(seg.hashes, at, k, m, bits)
        _, place = seg.places(at[which])
        foreign[place] = ~np.isin(found, own)
    # A span is a run of consecutive foreign edges; it covers k - 1 words more than it has edges.
    ends = np.flatnonzero(np.diff(np.concatenate(([0], foreign.view(np.int8), [0]))))
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, ends[::2], 1)
    np.add.at(gone, np.minimum(ends[1::2] + k - 1, len(words)), -1)
    return words, np.cumsum(gone)[:-1] > 0, len(ends) // 2


def without_repeats(docs: DataFrame, k: int = 13, m: int = 5, log_bits: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, n_spans) for every row: the kept words joined by one space, and counts."""
    rows = keyed(docs, id_col, text_col)
    bits = docs.sparkSession.sparkContext.broadcast(marked_minimizers(rows, k, m, log_bits))
    owned = paths(edges(rows, k, m, bits)).groupBy("owner").agg(F.collect_list("edges").alias("own"))

    def run(batches):
        none = np.zeros(0, np.uint64)
        for piece in pieces(batches):
            kept, counts = [], []
            for text, own in zip(piece.column("text").to_pylist(), piece.column("own")):
                own = own.values.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if own.is_valid else none
                words, gone, n = removed_words(text, own, k, m, bits.value)
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n else b" ".join(words))
                counts.append((len(words), int(gone.sum()), n))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*counts))],
                                             ["doc_id", "kept", "n_words", "n_removed", "n_spans"])

    done = (rows.join(owned, rows["doc_id"] == owned["owner"], "left").select("doc_id", "text", "own")
            .mapInArrow(run, "doc_id long, kept binary, n_words long, n_removed long, n_spans long"))
    return done.withColumn("doc_id", real_id(F.col("doc_id")))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")
