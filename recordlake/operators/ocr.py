"""From recognised words to lines, pages and document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

WORD_LEVEL = 5
LINE_KEY = ["document_id", "page_num", "block_num", "par_num", "line_num"]


def usable_words(words: DataFrame) -> DataFrame:
    """Word rows with text and a non-negative numeric confidence, scaled to 0..1."""
    confidence = F.col("conf").cast("string").try_cast("double") / 100.0
    staged = words.filter(F.col("level") == WORD_LEVEL).withColumns(
        {"text": strip(F.col("text")), "_confidence": confidence}
    )
    return staged.filter((F.col("text") != "") & (F.col("_confidence") >= 0) & ~F.isnan("_confidence"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Join the words of a line in input order; mean confidence and enclosing box."""
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return usable_words(words).groupBy(*LINE_KEY).agg(
        _ordered_text("pos", F.col("text"), " ").alias("text"),
        F.avg("_confidence").alias("confidence"),
        F.array(F.min("left"), F.min("top"), F.max(right), F.max(bottom)).alias("box"),
    )


def _ordered_text(position: str | Column, text: Column, separator: str) -> Column:
    place = F.col(position) if isinstance(position, str) else position
    items = F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t"))))
    return F.array_join(F.transform(items, lambda i: F.coalesce(i["t"], F.lit(""))), separator)


def assemble_pages(lines: DataFrame) -> DataFrame:
    """Page text and mean line confidence from lines in block, paragraph and line order."""
    place = F.struct("block_num", "par_num", "line_num")
    return lines.groupBy("document_id", F.col("page_num").alias("page_number")).agg(
        _ordered_text(place, F.col("text"), "\n").alias("text"),
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("lines"),
    )


def assemble_text(pages: DataFrame) -> DataFrame:
    """Document text: its pages in order, one line break between them."""
    return pages.groupBy("document_id").agg(
        _ordered_text("page_number", F.col("text"), "\n").alias("text"), F.count("*").alias("pages")
    )


def pages_text(pages: Column) -> Column:
    """The same for a page array inside a row."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def page_lines(pages: Column) -> Column:
    """All lines of a page array, in page order."""
    return F.flatten(F.transform(pages, lambda p: F.coalesce(p["lines"], F.array().cast("array<struct<text:string,confidence:double,box:array<double>>>"))))


def flatten_lines(ocr: DataFrame) -> DataFrame:
    """One row per line with its page number and its place on the page."""
    paged = ocr.select("document_id", F.posexplode("pages").alias("page_index", "page"))
    return paged.select(
        "document_id", "page_index", F.col("page.page_number").alias("page_number"),
        F.posexplode("page.lines").alias("line_index", "line"),
    ).select("document_id", "page_index", "page_number", "line_index", "line.text", "line.confidence", "line.box")


def best_line(lines: DataFrame) -> DataFrame:
    """Highest line confidence per document, ignoring values outside 0..1."""
    good = F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence"))
    return lines.groupBy("document_id").agg(F.max(good).alias("confidence"))
