"""Readers with explicit schemas, and the checks files go through on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import files as checks
from ..functions.text import let, strip
from ..operators import skew


def spread(df: DataFrame) -> DataFrame:
    """Give a small input a partition per core; an input that already has as many is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _with_file_id(df: DataFrame, column: str) -> DataFrame:
    """Fill a missing id from the file name, which is how the files are addressed."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_record)?\.json$", 1)
    return df.withColumn(column, F.coalesce(F.col(column), name))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a dataset manifest."""
    return _json(spark, path, schemas.MANIFEST_FILE).select("version", F.inline("documents"))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """One row per recognised document, pages as an array."""
    return _with_file_id(_json(spark, path, schemas.OCR_FILE), "document_id")


def read_model_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Extraction outputs, failed ones included."""
    return _with_file_id(_json(spark, path, schemas.MODEL_OUTPUT_FILE), "id")


def read_ground_truth(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Expected text per document, or expected record values with ``kind='record'``."""
    if kind == "record":
        return _with_file_id(_json(spark, path, schemas.GROUND_TRUTH_RECORD_FILE), "id")
    if kind != "text":
        raise ValueError(f"unknown kind: {kind}")
    raw = _with_file_id(_json(spark, path, schemas.GROUND_TRUTH_TEXT_FILE), "id")
    return raw.withColumn("text", F.coalesce("text", F.array_join("lines", "\n")))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows; bytes are read by executors, and only where a later step uses them.

    Spark's file scan leaves out files without content, so EMPTY_FILE is only reported for tables of files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select(
        "path", "length", "content", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.lit(None).cast("string").alias("declared_mime"),
    )


def check_files(files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """Add ``file_name``, ``file_type`` and ``error_code``. Content is looked at only when the size is acceptable."""
    named = files.withColumn("file_name", checks.sanitize_filename(F.col("filename")))
    typed = named.withColumn("_mime", checks.resolve_mime(F.col("file_name"), F.col("declared_mime")))
    error = let(F.col("_mime"), lambda m: F.coalesce(
        m["error_code"], checks.size_error(F.col("length"), max_bytes),
        F.when(~checks.content_matches(F.col("content"), m["mime"]), F.lit("FILE_CONTENT_MISMATCH"))))
    return typed.select(*files.columns, "file_name", F.col("_mime.mime").alias("file_type"), error.alias("error_code"))


def ingest_files(files: DataFrame, max_bytes: int = 10 << 20, document_type: str | None = None, language: str | None = None,
                 uploaded_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, rejects with their code). Accepted files get a generated storage path; blank descriptions are NULL."""
    checked = check_files(files, max_bytes)

    def described(text: str | None, name: str):
        return F.lit((text or "").strip() or None).cast("string").alias(name)

    accepted = checked.filter("error_code is null").withColumn("checksum", checks.sha256_hex(F.col("content"))).select(
        F.sha2(F.col("path"), 256).alias("id"), "file_name", "file_type", F.col("length").alias("file_size"), "checksum",
        described(document_type, "document_type"), described(language, "language"),
        checks.storage_path(F.col("path"), F.col("checksum"), F.col("file_type")).alias("storage_path"),
        F.lit(uploaded_by).cast("string").alias("uploaded_by"), F.lit("UPLOADED").alias("processing_status"),
    )
    rejected = checked.filter("error_code is not null").select("path", "file_name", "length", "error_code")
    return accepted, rejected


def replay_known(documents: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the stored result of the same file, rejects with a code).

    ``known`` has a ``sha256`` column and whatever should be replayed.
    """
    digest = F.lower(strip(F.col("checksum")))
    keyed = documents.withColumn("_sha", F.when(F.length(digest) == 64, digest))
    rows = known.withColumn("_sha", F.lower(strip(F.col("sha256")))).drop("sha256")
    # Of several stored results of a file the first in the order of its columns counts. Results can be wide, so their bytes decide
    # how they are joined; a digest that many documents share is left to the adaptive join.
    kept = [c for c in rows.columns if c != "_sha"]
    listed = rows.groupBy("_sha").agg(F.min(F.struct(*kept)).alias("_known")).select("_sha", *[F.col(f"_known.{c}").alias(c) for c in kept])
    marked = keyed.join(listed.withColumn("_hit", F.lit(True)), "_sha", "left")
    hits = marked.filter("_hit").drop("_sha", "_hit")
    misses = marked.filter("_hit is null").select(
        *documents.columns, F.lit("DEMO_DOCUMENT_NOT_RECOGNISED").alias("error_code")
    )
    return hits, misses


def decode_payload(c, schema: str):
    """JSON text to a typed value: an object to a struct, an array of objects to rows after ``inline``."""
    return F.from_json(c, schema)
