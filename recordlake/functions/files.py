"""Checks on uploaded files, as column expressions over name, declared type, length and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, literal_map, strip

# --- fixed values -----------------------------------------------------------
MIME_TO_EXTENSION = {
    "application/pdf": "pdf",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/tiff": "tif",
}
EXTENSION_TO_MIME = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}
MAGIC_BYTES = {
    "application/pdf": (b"%PDF-",),
    "image/png": (b"\x89PNG\r\n\x1a\n",),
    "image/jpeg": (b"\xff\xd8\xff",),
    "image/tiff": (b"II*\x00", b"MM\x00*"),
}
MAX_FILENAME_LENGTH = 255
STORED_PATH = r"(?i)\Adocuments/[0-9a-f]{32}/[0-9a-f]{32}\.(?:pdf|png|jpg|tif)\z"
# ----------------------------------------------------------------------------


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def sanitize_filename(name: Column) -> Column:
    """Last path part without unprintable characters and outer blanks or dots; 'upload' when nothing is left."""
    base = F.regexp_replace(strip(name), r"(?s)^.*/", "")
    printable = F.regexp_replace(base, r"[\p{C}\p{Z}&&[^ ]]", "")
    clean = F.regexp_replace(printable, r"^[ .]+|[ .]+\z", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("upload")), F.lit(MAX_FILENAME_LENGTH))


def extension(filename: Column) -> Column:
    """Lower-case extension without the dot; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(filename, r"(?s)[^.].*?\.([^.]*)\z", 1))


def resolve_mime(filename: Column, declared: Column) -> Column:
    """``struct(mime, error_code)``: extension and declared type must agree when both are known."""
    said = F.lower(strip(F.coalesce(F.split_part(declared, F.lit(";"), F.lit(1)), F.lit(""))))

    def judge(known: Column) -> Column:
        expected = known["expected"]
        mime = F.coalesce(F.when(known["said"].isin(*MIME_TO_EXTENSION), known["said"]), expected)
        error = F.when(expected.isNotNull() & (mime != expected), F.lit("FILE_TYPE_MISMATCH")).when(mime.isNull(), F.lit("UNSUPPORTED_FILE_TYPE"))
        return F.struct(F.when(error.isNull(), mime).alias("mime"), error.alias("error_code"))

    by_name = F.element_at(literal_map(EXTENSION_TO_MIME), extension(filename))
    return let(F.struct(said.alias("said"), by_name.alias("expected")), judge)


def upload_check(filename: Column, size: Column, declared: Column, max_bytes: int) -> Column:
    """The check made before sending a file: by extension first, declared type only when given."""
    name_part = F.lower(F.substring_index(filename, ".", -1))
    expected = F.element_at(literal_map(EXTENSION_TO_MIME), name_part)
    return (
        F.when(expected.isNull(), F.lit("UNSUPPORTED_FILE_TYPE"))
        .when((F.coalesce(declared, F.lit("")) != "") & (declared != expected), F.lit("FILE_TYPE_MISMATCH"))
        .when(size > max_bytes, F.lit("FILE_TOO_LARGE"))
    )


def size_error(size: Column, max_bytes: int) -> Column:
    return F.when(size <= 0, F.lit("EMPTY_FILE")).when(size > max_bytes, F.lit("FILE_TOO_LARGE"))


def content_matches(content: Column, mime: Column) -> Column:
    """Whether the first bytes belong to the given type."""
    def judge(seen: Column) -> Column:
        out = F.lit(False)
        for name, markers in MAGIC_BYTES.items():
            hit = F.lit(False)
            for marker in markers:
                hit = hit | F.startswith(seen["head"], F.lit(marker.hex().upper()))
            out = F.when(seen["mime"] == name, hit).otherwise(out)
        return out

    return let(F.struct(F.hex(F.substring(content, 1, 8)).alias("head"), mime.alias("mime")), judge)


def storage_path(path: Column, checksum: Column, mime: Column) -> Column:
    """A place for an accepted file: it tells nothing of the name it came with, and a task that runs again makes the same one."""
    return F.concat(F.lit("documents/"), F.md5(path.cast("binary")), F.lit("/"), F.md5(F.concat(checksum, path).cast("binary")), F.lit("."),
                    F.element_at(literal_map(MIME_TO_EXTENSION), mime))


def is_stored_path(path: Column) -> Column:
    return F.coalesce(F.regexp_like(path, F.lit(STORED_PATH)), F.lit(False))
