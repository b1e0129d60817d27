"""Lookups above the broadcast limit: which rows are dealt to shares, and that none is lost."""

from pyspark.sql import functions as F

from recordlake.operators import skew


def test_only_hot_keys_are_dealt(spark):
    name = F.when(F.col("id") % 10 < 3, F.lit("hot")).when(F.col("id") % 10 == 3, F.lit(None)).otherwise(F.concat(F.lit("n"), F.col("id") % 2000))
    left = spark.range(20_000).select(name.cast("string").alias("name"), (F.col("id") % 5).alias("n"))
    right = spark.range(0, 2000, 3).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.col("id").alias("value")).unionByName(
        spark.createDataFrame([("hot", -1), (None, -2)], "name string, value long"))
    hot = skew.hot_keys(left, "name", 500)
    assert [k for k, _ in hot] == ["hot"] and 12 <= hot[0][1] <= 13
    plain = left.join(right, "name", "left").groupBy("name", "n", "value").count()
    joined = skew.lookup(left, right, "name", False, 500)
    assert joined.columns == ["name", "n", "value"]
    spread = joined.groupBy("name", "n", "value").count()
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    assert sorted(map(str, skew.lookup(left.limit(0), right, "name", False).collect())) == []


def test_no_hot_key(spark):
    left, right = spark.range(100).select(F.col("id").alias("k")), spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert skew.hot_keys(left, "k", 10) == []
    assert skew.lookup(left, right, "k", False, 10).filter("v = 'x'").count() == 50
