"""Newest row per key, positions, and trailing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schemas import OPEN_TASK_STATUSES
from . import skew


def newest(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark keeps only the best row per key and partition before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def latest_job(jobs: DataFrame) -> DataFrame:
    return newest(jobs, "document_id", [F.desc("created_at"), F.desc("id")])


def latest_open_task(tasks: DataFrame) -> DataFrame:
    open_rows = tasks.filter(F.col("status").isin(*OPEN_TASK_STATUSES))
    return newest(open_rows, "land_record_id", [F.desc("created_at"), F.desc("id")])


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """Newest correction per record and field; its value may be NULL."""
    return newest(corrections, ["land_record_id", "field_name"], [F.desc("changed_at"), F.desc("new_value")])


def audit_positions(audit: DataFrame, slices: int | None = None) -> DataFrame:
    """Chronological position of every event of an entity."""
    return skew.running_position(audit, "entity_id", "timestamp", "id", slices)


def stage_durations(audit: DataFrame, slices: int | None = None) -> DataFrame:
    """Seconds until the next event of the same entity, NULL for its last event."""
    led = skew.next_value(audit, "entity_id", "timestamp", "id", slices)
    span = (F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1e6
    return led.withColumn("seconds", span)


def failed_attempt_rate(events: DataFrame, key: str, is_failure: Column, is_reset: Column, at: str = "ts",
                        row_id: str = "event_id", window_s: int = 300, limit: int = 10, slices: int | None = None) -> DataFrame:
    """Add ``recent_failures`` and ``blocked``: failures of a key less than ``window_s`` seconds old since its last reset.

    A failure also ends a window later, so counts come from three sums that only grow along a key: failures so far, failures that have
    ended, and failures before the last reset. The sums are taken within slices of about equal row counts (``slices`` of them over the
    whole table) and carried from slice to slice, so a burst of one key, even within a single window or a single moment, is spread like
    any other rows. Rows without a time come first and are counted among themselves only.
    """
    width, earliest = window_s * 1_000_000, -(1 << 62)
    staged = events.withColumns({
        "_t": F.unix_micros(F.col(at).cast("timestamp")), "_row": F.lit(1), "_gone": F.lit(0),
        "_fail": F.coalesce(is_failure, F.lit(False)).cast("int"), "_reset": F.coalesce(is_reset, F.lit(False)).cast("int"),
    })
    ends = staged.filter("_fail = 1").select(
        key, F.coalesce(F.col("_t") + width, F.lit(earliest)).alias("_t"), F.lit(0).alias("_row"), F.lit(1).alias("_gone"),
        F.lit(0).alias("_fail"), F.lit(0).alias("_reset"))
    sliced = skew.in_slices(staged.unionByName(ends, allowMissingColumns=True), key, [F.col("_t"), F.col("_row"), F.col(row_id)], slices)

    so_far = Window.partitionBy("_key", "_slice").orderBy(*[F.col(n).asc_nulls_first() for n in ("_o0", "_o1", "_o2")]).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({"_f": F.sum("_fail").over(so_far), "_g": F.sum("_gone").over(so_far), "_r": F.sum("_reset").over(so_far)})
    local = local.withColumn("_cleared", F.max(F.when(F.col("_reset") == 1, F.col("_f") - F.col("_fail"))).over(so_far))
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_key", "_slice").agg(
        F.sum("_fail").alias("f"), F.sum("_gone").alias("g"), F.sum("_reset").alias("r"), F.max("_cleared").alias("cleared"))
    carried = totals.select("_key", "_slice", "cleared", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}0") for c in "fgr"])
    carried = carried.withColumn("_cleared0", F.coalesce(F.max(F.col("cleared") + F.col("_f0")).over(earlier), F.lit(0))).drop("cleared")
    summed = local.join(carried, ["_key", "_slice"]).withColumns({
        "_failed": F.col("_f") + F.col("_f0"), "_ended": F.col("_g") + F.col("_g0"), "_run": F.col("_r") + F.col("_r0"),
        "_before": F.coalesce(F.col("_cleared") + F.col("_f0"), F.col("_cleared0")),
    })
    # Rows of one moment and run count each other, also those that the next slices begin with; only keys in several slices have such.
    begins = summed.groupBy("_key", "_slice").agg(F.min(F.struct("_o0", "_run")).alias("first"))
    moment = Window.partitionBy("_key", "_slice", "_o0", "_run")
    peers = summed.withColumn("_peers", F.max("_failed").over(moment))
    several = begins.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).filter("_n > 1").select("_key", "_slice", "first._o0", "first._run")
    tops = peers.join(F.broadcast(several), (peers["_key"] == several["_key"]) & (peers["_slice"] == several["_slice"])
                      & peers["_o0"].eqNullSafe(several["_o0"]) & (peers["_run"] == several["_run"]), "left_semi")
    later = tops.groupBy(F.col("_key").alias("_key1"), F.col("_o0").alias("_at1"), F.col("_run").alias("_run1")).agg(F.max("_peers").alias("_later"))
    joined = peers.filter("_row = 1").join(
        F.broadcast(later), (F.col("_key") == F.col("_key1")) & F.col("_o0").eqNullSafe(F.col("_at1")) & (F.col("_run") == F.col("_run1")), "left")
    count = F.greatest(F.col("_peers"), F.col("_later")) - F.greatest("_before", "_ended")
    return joined.withColumn("recent_failures", count.cast("long")).withColumn("blocked", F.col("recent_failures") >= limit).select(
        *events.columns, "recent_failures", "blocked")
