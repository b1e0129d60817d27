"""Lines repeated over documents, found by sorted hashes and returned as keep bitmaps.

A line's key is the line without white space [\\x20\\x09-\\x0D] at its ends and with A-Z lowered. A key of at least ``min_chars`` code
points that occurs in at least ``min_docs`` documents keeps its lines only in the largest doc_id holding it.

Only built-in functions run here. (hash, doc_id, position) rows are range-partitioned by hash and document and sorted by position,
so the rows of a hot line spread over as many partitions as they need. The first occurrence of a line in each document is streamed
from that order without another exchange; counts and the last document of a hash are then combined from one row per partition.
What to drop comes back as bitmaps: for each document the 64-line words that lose a line, with a set bit for each line to keep.

A null text is one empty line. Rows are told apart by doc_id and text: rows of one id count as one document, equal rows lose the
same lines, and a null id is one document below all others. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() changes letters beyond A-Z too, so it serves lines of ASCII characters only.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, bitmap map<int, long>, n_dropped) for the rows that lose a line."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    lines = rows.select("doc_id", "text_hash", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    # The key is never shorter than asked if the line itself is not, so most short lines need no key.
    keyed = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    hashed = (keyed.filter(F.char_length("key") >= min_chars)
              .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "text_hash", "pos")
    first = F.row_number().over(W.partitionBy("h1", "h2", "doc_id").orderBy("text_hash", "pos")) == 1
    firsts = ranged.select("h1", "h2", "doc_id", first.alias("is_first")).filter("is_first")
    often = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    # The keys of the join differ from those of the counts, so both sides are dealt anew by it and the rows of a hot line can be
    # split over several tasks; the side of the counts has a row for each frequent line only.
    other = {"k1": F.bitwise_not("h1"), "k2": F.bitwise_not("h2")}
    often = often.select(*[c.alias(n) for n, c in other.items()], "last")
    lost = ranged.withColumns(other).join(often, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    words = (lost.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone")))
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone")))).alias("bitmap"),
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines whose bit is set, joined again; the text itself where there is no bitmap."""
    def keep(line, i):
        word = F.element_at(bitmap, F.shiftright(i, 6))
        return word.isNull() | (F.bit_get(word, i % 64) == 1)

    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(text_lines(text), keep), "\n"))


def with_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, Column, Column]:
    """``docs`` with two more columns; the bitmap and the number of dropped lines of each row as Columns."""
    names = [fresh(docs.columns, n) for n in ("lines_doc", "lines_hash", "lines_bitmap", "lines_dropped")]
    found = keep_bitmaps(docs, min_chars, min_docs).toDF(*names)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1]))
    return docs.join(found, on, "left"), F.col(names[2]), F.coalesce(F.col(names[3]), F.lit(0)).cast("long")


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs``, all columns, with the kept lines as ``text``, and ``n_chars``, if there, counted anew."""
    joined, bitmap, _ = with_bitmaps(docs, min_chars, min_docs)
    kept = joined.withColumn("text", kept_text(F.col("text"), bitmap))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""
    joined, bitmap, dropped = with_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    return joined.select("doc_id", F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"), dropped.alias("n_dropped"),
                         F.sha2(kept_text(F.col("text"), bitmap).cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
      FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""
