"""Parquet tables laid out in one fixed order, with a directory of positions, so that page n is read without the pages before it.

A table is range-partitioned by its order, each range is sorted, and every row is stored with its place in its range. The directory
beside it holds for each range the exact number of rows and the number of rows before it. A page's first and last position lead to
its ranges and to places in them, so a page reads some row groups of one range, mostly, and nothing is sorted but its own rows.

The columns of the order together should tell rows apart; rows equal in all of them lie in one range, in any order. NULLs come last.
Rows that change or come later show up when the layout is built again. What comes to the driver are directory rows, at most ``ranges``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window

RANGE, PLACE = "page_range", "page_place"

RECORD_ORDER = (("updated_at", False), ("record_id", True))
TASK_ORDER = (("created_at", False), ("id", False))
AUDIT_ORDER = (("timestamp", True), ("id", True))


class PagedTable:
    """``order`` names the columns and whether they ascend."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[tuple[str, bool]], ranges: int = 256):
        self.spark, self.path, self.order, self.ranges = spark, path, tuple(order), ranges

    def _ordering(self) -> list[Column]:
        return [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in self.order]

    def create(self, rows: DataFrame) -> PagedTable:
        """Lay out all rows and write the directory last, so a layout that broke off has none."""
        # The id counts the rows of a partition in their order and has the partition's number above bit 33.
        numbered = rows.repartitionByRange(self.ranges, *self._ordering()).sortWithinPartitions(*self._ordering()).withColumn(
            PLACE, F.monotonically_increasing_id())
        placed = numbered.withColumns({RANGE: F.shiftright(PLACE, 33).cast("int"), PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))})
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")  # partitioned files tell no columns where there are no rows
        placed.write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.path}/rows")
        sizes = self._stored().groupBy(RANGE).agg(F.count("*").alias("rows"))
        earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # over at most ``ranges`` rows
        sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).write.mode("overwrite").parquet(f"{self.path}/directory")
        return self

    def _stored(self, ranges: Sequence[int] | None = None) -> DataFrame:
        """The rows of some ranges; no other folder is listed or read."""
        columns = self.spark.read.parquet(f"{self.path}/columns").schema.add(PLACE, LongType()).add(RANGE, IntegerType())
        paths = [f"{self.path}/rows"] if ranges is None else [f"{self.path}/rows/{RANGE}={r}" for r in ranges]
        return self.spark.read.schema(columns).option("basePath", f"{self.path}/rows").parquet(*paths)

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def total(self) -> int:
        """The number of rows, read from the directory."""
        return self.directory().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]

    def page(self, number: int, limit: int) -> DataFrame:
        """The rows of a 1-based page; a page past the end is empty."""
        if number < 1 or limit < 1:
            raise ValueError("page and limit start at 1")
        first, end = (number - 1) * limit, number * limit
        inside = self.directory().filter((F.col("before") < end) & (F.col("before") + F.col("rows") > first)).collect()
        if not inside:
            return self._stored().limit(0).drop(RANGE, PLACE)
        found = self._stored([r[RANGE] for r in inside])
        # Only the first and the last range are cut.
        start, stop = min(inside, key=lambda r: r["before"]), max(inside, key=lambda r: r["before"])
        if start[RANGE] == stop[RANGE]:
            found = found.filter(F.col(PLACE).between(first - start["before"], end - start["before"] - 1))
        else:
            found = found.filter(((F.col(RANGE) != start[RANGE]) | (F.col(PLACE) >= first - start["before"]))
                                 & ((F.col(RANGE) != stop[RANGE]) | (F.col(PLACE) < end - stop["before"])))
        return found.orderBy(*self._ordering()).drop(RANGE, PLACE)
