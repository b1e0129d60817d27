"""The village, tehsil and district hierarchy, and checks of records against it."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, rules_key
from . import skew

LEVELS = ("village", "tehsil", "district")


@dataclass(frozen=True)
class Reference:
    """One lookup per level: ``key`` and, below the top, the ``parent`` it belongs to."""

    version: str
    source: str
    levels: dict[str, DataFrame]
    small: dict[str, bool]


def active_reference(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")


def reference_level(rows: DataFrame, level: str, parent_level: str | None) -> DataFrame:
    """Distinct active names of a level with their parent.

    Names that occur under several parents keep the one with the highest row id; see :func:`ambiguous_names`.
    """
    names = active_reference(rows).filter((F.col("reference_type") == level) & ~is_blank(F.col("name")))
    child = names.select(rules_key(F.col("name")).alias("key"), F.col("id").alias("row_id"), "parent_id")
    if parent_level is None:
        return child.groupBy("key").agg(F.lit(None).cast("string").alias("parent"))
    parents = rows.filter(F.col("reference_type") == parent_level).select(
        F.col("id").alias("parent_id"), rules_key(F.col("name")).alias("parent_key")
    )
    return (
        child.join(parents, "parent_id", "left")
        .groupBy("key")
        .agg(F.max_by("parent_key", F.when(F.col("parent_key").isNotNull(), F.col("row_id"))).alias("parent"))
    )


def build_reference(rows: DataFrame, source: str = "reference_data") -> Reference:
    """Lookups for :func:`recordlake.operators.rules.validate`.

    One small aggregate decides per level whether its lookup may be broadcast, and reads the version.
    """
    facts = rows.agg(
        F.min_by("version", F.when(F.col("version").isNotNull(), F.col("id"))).alias("version"),
        *[F.count_if(F.col("reference_type") == level).alias(level) for level in LEVELS],
    ).first()
    above = dict(zip(LEVELS, (*LEVELS[1:], None)))
    return Reference(
        version=facts["version"] or "unknown",
        source=source,
        levels={level: reference_level(rows, level, above[level]) for level in LEVELS},
        small={level: facts[level] <= skew.BROADCAST_ROWS for level in LEVELS},
    )


def reference_from_names(spark: SparkSession, chains: list[tuple[str, str, str]], version: str,
                         source: str) -> Reference:
    """A reference from (village, tehsil, district) tuples, for tests and small fixed lists."""
    def level(pairs: set) -> DataFrame:
        return spark.createDataFrame(sorted(pairs, key=str), "key string, parent string")

    return Reference(
        version, source,
        {
            "village": level({(v.lower(), t.lower()) for v, t, _ in chains}),
            "tehsil": level({(t.lower(), d.lower()) for _, t, d in chains}),
            "district": level({(d.lower(), None) for _, _, d in chains}),
        },
        dict.fromkeys(LEVELS, True),
    )


def ambiguous_names(rows: DataFrame) -> DataFrame:
    """Active names listed under more than one parent, with the number of parents."""
    return (
        active_reference(rows)
        .groupBy("reference_type", rules_key(F.col("name")).alias("key"))
        .agg(F.countDistinct("parent_id").alias("parents"))
        .filter("parents > 1")
    )


def reference_membership(df: DataFrame, ref: Reference, level: str) -> DataFrame:
    """Add ``<level>_known`` and ``<level>_parent`` (the parent on file) to records."""
    lookup = ref.levels[level].select(
        F.col("key").alias("_key"), F.col("parent").alias(f"{level}_parent"), F.lit(True).alias("_known")
    )
    keyed = df.withColumn("_key", F.when(~is_blank(F.col(level)), rules_key(F.col(level))))
    return (
        skew.lookup(keyed, lookup, "_key", ref.small[level])
        .withColumn(f"{level}_known", F.coalesce("_known", F.lit(False)))
        .drop("_key", "_known")
    )


def with_reference(df: DataFrame, ref: Reference, levels: Collection[str] = LEVELS) -> DataFrame:
    for level in LEVELS:
        if level in levels:
            df = reference_membership(df, ref, level)
    return df


def drop_reference_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[f"{level}_{part}" for level in LEVELS for part in ("known", "parent")])


def breaks_chain(child: str, parent: str) -> Column:
    """Whether a record contradicts the parent on file for its ``child`` level."""
    expected = F.col(f"{child}_parent")
    return (
        ~is_blank(F.col(child)) & ~is_blank(F.col(parent)) & F.col(f"{child}_known")
        & expected.isNotNull() & (expected != rules_key(F.col(parent)))
    )


def check_geo_chain(df: DataFrame, ref: Reference) -> DataFrame:
    """Add ``tehsil_conflict`` and ``district_conflict``."""
    checked = with_reference(df, ref, ("village", "tehsil")).withColumns(
        {"tehsil_conflict": breaks_chain("village", "tehsil"), "district_conflict": breaks_chain("tehsil", "district")}
    )
    return drop_reference_columns(checked)
