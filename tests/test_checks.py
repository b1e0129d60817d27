"""Every registered query against its SQL on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import difference, duck

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# One per module is enough here; ``python -m checks.compare`` runs all of them.
CHOSEN = ["v19_verdict_by_district", "n5_normalize_record", "j7_hot_keys", "j8_incremental_within_batch", "c1_domains", "s10_upsert",
          "s13_export_audit", "j13_reuse_cached", "wn4_failed_attempts", "wn6_audit_positions", "wn7_stage_durations", "n31_classify_fields",
          "a15_phase_means", "a16_words_to_lines", "n35_reasons", "l6_correction_log", "l9_reject"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, QUERIES[name], SQL.get(name), SMALL) is None


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    bare = {q for q in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", q)}
    assert not bare


def test_files_lie_in_one_folder(spark, tmp_path):
    """Files of a few hundred rows are written without a folder each, and hold every row once."""
    import os

    from checks import files

    rows = spark.range(3 * files.PER_FILE).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("string"), F.lit("end")).alias("lines"))
    path = f"{tmp_path}/files"
    files._write(rows, path, "id")
    parts = [e for e in os.scandir(path) if not e.name.startswith((".", "_"))]
    assert not [e for e in parts if e.is_dir()] and len([e for e in parts if e.stat().st_size]) == 3
    got = files.readers.read_ground_truth(spark, path).select("id", "text").collect()
    assert sorted((int(r.id), r.text) for r in got) == [(i, f"{i}\nend") for i in range(3 * files.PER_FILE)]
    none = f"{tmp_path}/none"
    files._write(rows.filter("id is null"), none, "id")
    assert files.readers.read_ground_truth(spark, none).count() == 0
