"""Joins and per-key orderings that stay balanced when one key holds a large share of the rows.

Three patterns are enough for the whole package:

* ``lookup``: the right side has one row per key. Below a checked row count it is broadcast. Above it both sides are shuffled; only
  keys that a sketch of fixed size finds hot are dealt to shares, as many as their rows need.
* ``attach``: the right side is an aggregate of the left side itself. Keys above ``hot_rows`` are few by
  arithmetic (at most rows / hot_rows), so they are broadcast and their rows never meet in one task.
* ``sliced windows``: an ordering within a key is computed per slice of about equal row counts, with the slice totals carried
  forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

BROADCAST_ROWS = 200_000
HOT_ROWS = 1_000_000
HOT_KEYS = 1_000
SKETCH_ITEMS = 20_000
NULL_SHARES = 1_024


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """(key, share count) of the keys with more than ``hot_rows`` rows: as many shares as keep them about that large.

    A frequent-items sketch of fixed size finds them in one pass, without a shuffle of keys. At most ``HOT_KEYS`` come to the driver:
    a key that is not among them has no more rows than ``hot_rows`` or one part in ``HOT_KEYS`` of all, whichever is larger.
    """
    found = df.filter(F.col(key).isNotNull()).agg(F.call_function("approx_top_k", F.col(key), F.lit(HOT_KEYS), F.lit(SKETCH_ITEMS)).alias("top")).first()["top"]
    return [(r["item"], -(-r["count"] // hot_rows)) for r in found or [] if r["count"] > hot_rows]


def lookup(left: DataFrame, right: DataFrame, key: str, small: bool, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to a table with one row per ``key``. ``small`` is the outcome of a size check on ``right``.

    A large table is joined by shuffling both sides. Rows of a hot key are dealt to shares, and only its row of ``right`` is copied, once
    per share. Rows without a key match nothing and are spread the same way. The share is a hash of the row, so that a task that runs again
    deals as before; rows equal in every column stay together.
    """
    if small:
        return left.join(F.broadcast(right), key, "left")
    spark, kind = left.sparkSession, left.schema[key].dataType.simpleString()
    hot = F.broadcast(spark.createDataFrame(hot_keys(left, key, hot_rows), f"{key} {kind}, _shares long"))  # at most HOT_KEYS rows
    row = F.xxhash64(*[F.col(c) for c in left.columns if _hashable(left, c)])
    shares = F.when(F.col(key).isNull(), F.lit(NULL_SHARES)).otherwise(F.coalesce("_shares", F.lit(1)))
    # Rows of one share only are not hashed, which costs as much as a row is wide.
    share = F.when(shares > 1, F.pmod(row, shares)).otherwise(F.lit(0).cast("long"))
    dealt = left.join(hot, key, "left").withColumn("_share", share).drop("_shares")
    copies = right.join(hot, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    return dealt.join(copies.drop("_shares"), [key, "_share"], "left").drop("_share")


def _hashable(df: DataFrame, name: str) -> bool:
    return not any(t in df.schema[name].dataType.simpleString() for t in ("map<", "variant"))


def attach(rows: DataFrame, per_key: DataFrame, key: str, size: str, row_id: Column,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``rows`` to ``per_key``, which has one row per key; ``size`` tells how many rows carry the key.

    Rows of a hot key get their values from the broadcast side and are then hashed by row id, like the rows
    without a key, so the shuffled join never sees a large group.
    """
    values = [c for c in per_key.columns if c != key]
    hot = per_key.filter(F.col(size) > hot_rows).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = per_key.filter(F.col(size) <= hot_rows).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    staged = rows.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("\x00"), F.xxhash64(row_id).cast("string"))
    own_key = F.when(F.col("_hot").isNull(), F.col(key).cast("string"))
    staged = staged.withColumn("_join_key", F.coalesce(own_key, spread))
    joined = staged.join(cold, F.col("_join_key") == F.col("_cold_key").cast("string"), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])


def settled(df: DataFrame) -> DataFrame:
    """The table written once to the folder of ``spark.checkpoint.dir``, for steps that have to see the same partitions twice."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` or, where the session names none, one beside its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def in_slices(df: DataFrame, key: str, order: list[Column], slices: int | None = None) -> DataFrame:
    """Rows with ``_key``, the ordering values ``_o0``, ``_o1``, ... and ``_slice``.

    Rows are range-partitioned by key and order, and a slice is what one partition holds of a key. So slices follow the number of
    rows, whatever the order values are, and a key with most of the rows has most of the slices. NULLs come first.
    """
    names = [f"_o{i}" for i in range(len(order))]
    # Plain non-null columns, so that the window and the join below share one shuffle.
    keyed = df.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("\x00")), **dict(zip(names, order))})
    by = ["_key", *names]
    dealt = keyed.repartitionByRange(slices, *by) if slices else keyed.repartitionByRange(*by)
    return settled(dealt.withColumn("_slice", F.spark_partition_id()))


def _in_order(df: DataFrame):
    names = sorted(c for c in df.columns if c.startswith("_o"))
    return Window.partitionBy("_key", "_slice").orderBy(*[F.col(n).asc_nulls_first() for n in names])


def running_position(df: DataFrame, key: str, at: str, tie: str, slices: int | None = None, name: str = "position") -> DataFrame:
    """1-based position of each row within ``key`` ordered by (``at``, ``tie``).

    Rows are numbered within their slice of the key; the number of rows in earlier slices is added. Rows without a time come first.
    """
    sliced = in_slices(df, key, [F.col(at), F.col(tie)], slices)
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_key", "_slice").agg(F.count("*").alias("_n"))
        .select("_key", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    numbered = sliced.withColumn("_in_slice", F.row_number().over(_in_order(sliced)))
    return numbered.join(offsets, ["_key", "_slice"]).select(
        *df.columns, (F.col("_before") + F.col("_in_slice")).cast("long").alias(name)
    )


def next_value(df: DataFrame, key: str, at: str, tie: str, slices: int | None = None, name: str = "next_at") -> DataFrame:
    """``at`` of the following row of the same key, ordered by (``at``, ``tie``); sliced like ``running_position``."""
    sliced = in_slices(df, key, [F.col(at), F.col(tie)], slices)
    order = Window.partitionBy("_key").orderBy("_slice")
    # The first row of a slice may have no time, so its value is kept in a struct.
    heads = (
        sliced.groupBy("_key", "_slice").agg(F.min(F.struct(F.col("_o0"), F.col("_o1"))).alias("_first"))
        .select("_key", "_slice", F.lead("_first").over(order).alias("_following"))
    )
    led = sliced.withColumn("_lead", F.lead(F.struct("_o0")).over(_in_order(sliced)))
    return led.join(heads, ["_key", "_slice"]).select(
        *df.columns, F.when(F.col("_lead").isNotNull(), F.col("_lead._o0")).otherwise(F.col("_following._o0")).alias(name)
    )


def last_before(df: DataFrame, key: str, order: list[Column], value: str, slices: int | None = None, name: str = "last") -> DataFrame:
    """The newest non-NULL ``value`` of the same key up to and with each row in the given order; sliced like ``running_position``."""
    sliced = in_slices(df, key, order, slices)
    ordering = F.struct(*[c for c in sliced.columns if c.startswith("_o")])
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("_key", "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), ordering)).alias("_tail"))
        .select("_key", "_slice", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    )
    so_far = _in_order(sliced).rowsBetween(Window.unboundedPreceding, 0)
    seen = sliced.withColumn("_seen", F.last(value, ignorenulls=True).over(so_far))
    return seen.join(carried, ["_key", "_slice"]).select(*df.columns, F.coalesce("_seen", "_carried").alias(name))


def previous_struct(df: DataFrame, key: str, order: str, value: Column, slice_rows: int = 10_000,
                    name: str = "previous") -> DataFrame:
    """``value`` of the preceding row of the same key in a numeric ``order``, NULL for the first one.

    Slices are ranges of the order number; the last value of each slice is carried into the next.
    """
    staged = df.withColumns({
        "_key": F.coalesce(F.col(key).cast("string"), F.lit("\x00")),
        "_slice": F.floor(F.col(order) / F.lit(slice_rows)).cast("long"), "_value": F.struct(value.alias("v")),
    })
    by_slice = Window.partitionBy("_key").orderBy("_slice")
    tails = (
        staged.groupBy("_key", "_slice").agg(F.max_by("_value", order).alias("_tail"))
        .select("_key", "_slice", F.lag("_tail").over(by_slice).alias("_carried"))
    )
    within = Window.partitionBy("_key", "_slice").orderBy(order)
    lagged = staged.withColumn("_lag", F.lag("_value").over(within))
    return lagged.join(tails, ["_key", "_slice"]).select(*df.columns, F.coalesce("_lag", "_carried").alias(name))


def several_parts(children: DataFrame, key: list[str], part_rows: int) -> DataFrame:
    """(key, _parts) of the keys with more than ``part_rows`` rows, few by arithmetic: at most rows / part_rows."""
    counts = children.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("_parts"))
    return counts.filter("_parts > 1")


def in_parts(children: DataFrame, key: list[str], part_rows: int, name: str = "part") -> DataFrame:
    """Children with a part number per ``key``: 0 up to ``part_rows`` rows, above that as many parts as keep them about that large.

    Keys with several parts are broadcast; their rows are dealt by a hash of the row and, for equal rows, of its place in the input, so
    no row is lost and none of the later groups grows with a key.
    """
    keys = {k: f"_{k}_of" for k in key}
    large = F.broadcast(several_parts(children, key, part_rows).withColumnsRenamed(keys))
    match = [F.col(k).eqNullSafe(F.col(v)) for k, v in keys.items()]
    at = F.pmod(F.xxhash64(*[F.col(c) for c in children.columns if _hashable(children, c)], F.monotonically_increasing_id()), F.col("_parts"))
    numbered = children.join(large, match, "left").withColumn(name, F.coalesce(at.cast("int"), F.lit(0)))
    return numbered.drop("_parts", *keys.values())
