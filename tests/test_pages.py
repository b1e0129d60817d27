"""Pages by number out of a layout by position."""

import pytest
from pyspark.sql import functions as F

from recordlake.sources.pages import PagedTable


def rows(spark, n):
    at = F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(50)))
    return spark.range(n).select(F.col("id").alias("row"), at.alias("at"), F.lit("x").alias("page"))


def expected(df):
    return sorted(((r.row, r.at) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


@pytest.mark.parametrize("ranges,limit", [(7, 10), (40, 100), (1, 33)])
def test_every_page(spark, tmp_path, ranges, limit):
    df = rows(spark, 1003)
    want = expected(df)
    table = PagedTable(spark, str(tmp_path), (("at", False), ("row", True)), ranges).create(df)
    assert table.total() == len(want)
    for number in (1, 2, 5, len(want) // limit, len(want) // limit + 1):
        got = table.page(number, limit)
        assert [(r.row, r.at) for r in got.collect()] == want[(number - 1) * limit:number * limit] and got.columns == df.columns
    assert table.page(len(want), limit).count() == 0
    with pytest.raises(ValueError):
        table.page(0, limit)


def test_a_deep_page_reads_its_range_only(spark, tmp_path):
    table = PagedTable(spark, str(tmp_path), (("row", True),), 20).create(rows(spark, 10_000))
    deep = table.page(4_700, 2)
    assert len({f.split("page_range=")[1].split("/")[0] for f in deep.inputFiles()}) == 1
    plan = deep._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "GreaterThanOrEqual(page_place" in plan
    assert [r.row for r in deep.collect()] == [9398, 9399]


def test_no_rows_and_equal_rows(spark, tmp_path):
    assert PagedTable(spark, f"{tmp_path}/a", (("row", True),), 4).create(rows(spark, 0)).page(1, 5).count() == 0
    same = spark.range(100).select(F.lit(1).alias("row"))
    table = PagedTable(spark, f"{tmp_path}/b", (("row", True),), 4).create(same)
    assert table.total() == 100 and sum(table.page(n, 30).count() for n in range(1, 5)) == 100
