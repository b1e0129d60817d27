"""Possible duplicates: records that share survey number and village.

Groups are counted before anything is joined back, so a key shared by a third of all records costs one
partially aggregated shuffle and a broadcast row. No pairs are produced: the partners of a record are the other rows
with its ``duplicate_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compare_key, quoted, strip
from . import skew
from .rules import Rule
from .windows import newest


def duplicate_key(survey: Column, village: Column) -> Column:
    """Text key of the configured combination, NULL when either part is blank."""
    s, v = compare_key(survey), compare_key(village)
    return F.when((s != "") & (v != ""), F.concat_ws("\x1f", s, v))


def key_group_size(df: DataFrame, key: str, row_id: str, name: str = "group_size",
                   hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Add the number of rows that share ``key``; 0 where the key is NULL."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    out = skew.attach(df, counts, key, name, F.col(row_id), hot_rows)
    return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def _verdict(matches: Column) -> Column:
    return F.when(matches > 0, F.lit("POSSIBLE_DUPLICATE")).otherwise(F.lit("NO_MATCH"))


def find_duplicates(df: DataFrame, row_id: str = "record_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Add ``duplicate_key``, ``match_count`` and ``duplicate_check``; every record is compared with all others."""
    keyed = df.withColumn("duplicate_key", duplicate_key(F.col("survey_number"), F.col("village")))
    sized = key_group_size(keyed, "duplicate_key", row_id, "match_count", hot_rows)
    return sized.withColumn("match_count", F.greatest(F.col("match_count") - 1, F.lit(0))).withColumn(
        "duplicate_check", _verdict(F.col("match_count"))
    )


def find_duplicates_incremental(batch: DataFrame, existing: DataFrame, within_batch: bool = False,
                                hot_rows: int = skew.HOT_ROWS, version: Column | None = None) -> DataFrame:
    """Compare a batch, one row per document, with the stored records of other documents.

    Every stored document counts once per key. If ``existing`` keeps earlier versions of a document, ``version`` orders them and only
    the newest one counts, whatever key the others had. Stored rows of a document that is in the batch are its own earlier version and
    do not count. With ``within_batch`` the other documents of the batch count as well.

    ``existing`` may hold the ``duplicate_key`` instead of its parts. Only stored rows that a batch key leads to are counted: those with such a key and, where versions are kept, the other versions
    of their documents.
    """
    keyed = batch.withColumn("duplicate_key", duplicate_key(F.col("survey_number"), F.col("village")))
    known = F.col("duplicate_key") if "duplicate_key" in existing.columns else duplicate_key(F.col("survey_number"), F.col("village"))
    stored = existing.select("document_id", known.alias("duplicate_key"),
                             (F.lit(0) if version is None else version).alias("_version"))
    asked = keyed.select("duplicate_key").filter("duplicate_key is not null").distinct()
    reached = stored.join(asked, "duplicate_key", "left_semi")
    if version is not None:
        versions = stored.join(reached.select("document_id").distinct(), "document_id", "left_semi")
        reached = newest(versions, "document_id", [F.desc("_version"), F.desc_nulls_last("duplicate_key")])
    stored = reached.filter(F.col("duplicate_key").isNotNull()).select("document_id", "duplicate_key").distinct()
    if within_batch:
        # Every batch document replaces its stored row, so only the new row of it counts.
        stored = stored.join(batch.select("document_id").distinct(), "document_id", "left_anti")
        stored = stored.unionByName(keyed.select("document_id", "duplicate_key").filter("duplicate_key is not null").distinct())
    counts = stored.groupBy("duplicate_key").agg(F.count("*").alias("_all"))
    if not within_batch:
        # What must not meet in one task are the batch rows of a key, so those decide which keys are hot.
        sizes = keyed.filter("duplicate_key is not null").groupBy("duplicate_key").agg(F.count("*").alias("_size"))
        counts = sizes.join(counts, "duplicate_key")
    else:
        counts = counts.withColumn("_size", F.col("_all"))
    own = stored.groupBy("document_id", "duplicate_key").agg(F.count("*").alias("_own"))
    out = skew.attach(keyed, counts, "duplicate_key", "_size", F.col("document_id"), hot_rows)
    # (document, key) is at most one row per document, so this join has no large group.
    out = out.join(own, ["document_id", "duplicate_key"], "left")
    matches = F.coalesce(F.col("_all"), F.lit(0)) - F.coalesce(F.col("_own"), F.lit(0))
    return out.withColumn("match_count", matches.cast("long")).drop("_all", "_own", "_size").withColumn(
        "duplicate_check", _verdict(F.col("match_count"))
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row per duplicated key with its size: the compact form of all matches."""
    return (
        df.withColumn("duplicate_key", duplicate_key(F.col("survey_number"), F.col("village")))
        .filter(F.col("duplicate_key").isNotNull())
        .groupBy("duplicate_key")
        .agg(F.count("*").alias("records"))
        .filter("records > 1")
    )


def duplicate_message(survey: Column, village: Column, matches: Column) -> Column:
    def shown(c: Column) -> Column:
        return quoted(F.coalesce(strip(c), F.lit("")))

    return F.concat(
        F.lit("survey_number: "), shown(survey), F.lit(" of "), shown(village), F.lit(" is also in "), matches.cast("string"),
        F.lit(" other record(s); a parcel can be recorded twice for good reasons, so look at them before approval"),
    )


def duplicate_rule() -> Rule:
    """The rule for rows that went through one of the duplicate checks."""
    return Rule("DUP_CANDIDATE_001", "survey_number", "REVIEW_REQUIRED", "WARNING", F.col("match_count") > 0,
                duplicate_message(F.col("survey_number"), F.col("village"), F.col("match_count")))


def duplicate_issue(message: bool = True) -> Column:
    """The issue of a row that went through one of the duplicate checks, NULL when nothing matched."""
    return duplicate_rule().issue(message)


def add_duplicate_issue(df: DataFrame, message: bool = True) -> DataFrame:
    """Append the duplicate issue to ``issues``."""
    # A list of one or none is added, so that the message is built in compiled code and not inside array_compact's lambda.
    rule = duplicate_rule()
    own = F.when(rule.applies, F.array(rule.found(message))).otherwise(F.array())
    return df.withColumn("issues", F.concat(F.array_compact(F.col("issues")), own))
