"""What the corpus operators share: reading texts in bounded pieces, stable names, stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd, so that multiplying by it loses no bits.
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes to word bytes: A-Z lowered, every other ASCII character but a-z and 0-9 to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words hashed at once; a longer text is cut into overlapping segments.
WORDS_AT_ONCE = 1 << 16
#: Bytes of rows that reach a Python task in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Bytes of text that a Python task works on at once; one longer text makes a piece of its own.
PIECE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold few texts, so that an executor's memory does not depend on how long texts are on average."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes); a null text is an empty one. Other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that the table does not have yet, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column ``text`` of each piece has about ``size`` bytes."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column("text")).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def per_text(fn: Callable, schema: str, columns: tuple[str, ...] = ("doc_id",)) -> Callable:
    """For mapInArrow: a row per text, ``columns`` unchanged and then what ``fn(text)`` returns, a tuple in the order of ``schema``."""
    kinds = arrow_schema(schema)

    def run(batches):
        for piece in pieces(batches):
            rows = [fn(x) for x in piece.column("text").to_pylist()]
            out = [piece.column(c) for c in columns]
            out += [pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(out, [*columns, *(f.name for f in kinds)])

    return run


def arrow_schema(ddl: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session that names none, as in tests, gets one beside its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder, so that later steps survive lost executors; Spark removes it after use."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col.cast("string").cast("binary")) % n


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lowered."""
    return text.translate(TO_WORDS).split()


class Segments(NamedTuple):
    """Word hashes of some texts: of each segment the text's number, the place of its first word there, and its word count."""

    text: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    hashes: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """Where ``k`` words of one segment start in ``hashes``."""
        if len(self.hashes) < k:
            return np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(self.size)), self.size)
        return np.flatnonzero(of[:len(of) - k + 1] == of[k - 1:])

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and word place of indexes into ``hashes``."""
        begins = np.cumsum(self.size) - self.size
        of = np.searchsorted(begins, at, side="right") - 1
        return self.text[of], self.offset[of] + at - begins[of]


def segments(texts: list[bytes], split: Callable[[bytes], list[bytes]], k: int) -> Iterator[Segments]:
    """The texts' words hashed, some at a time; every window of ``k`` words lies in exactly one segment."""
    held: list[tuple[int, int, list[bytes]]] = []
    total = 0

    def made() -> Segments:
        size = np.array([len(w) for _, _, w in held], np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(w for _, _, w in held)), np.uint64, int(size.sum()))
        return Segments(np.array([i for i, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64), size, hashes)

    for i, text in enumerate(texts):
        words = split(text)
        for at in range(0, max(0, len(words) - k + 1), WORDS_AT_ONCE):
            held.append((i, at, words[at:at + WORDS_AT_ONCE + k - 1]))
            total += len(held[-1][2])
            if total >= WORDS_AT_ONCE:
                yield made()
                held, total = [], 0
    if held:
        yield made()


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values (uint64), rolled together from those of 1, 2, 4, ... values."""
    power, grams, n, done, length = MULTIPLIER, values, 1, None, 0
    while True:
        if k & n:
            # What is done covers the values before these.
            done = grams if done is None else done[:len(grams) - length] * np.uint64(power) + grams[length:][:len(done)]
            length += n
        n *= 2
        if n > k:
            break
        grams = grams[:-(n // 2)] * np.uint64(power) + grams[n // 2:]
        power = power * power % (1 << 64)
    return mixed(done[:max(0, len(values) - k + 1)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:-(width - n)], x[width - n:]) if n < width else x


def bitmap_of(hashes: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """A bitmap of ``2 ** log_bits`` bits in which the low bits of every hash of the column are set.

    It is built in Spark in pieces of 4 KB; its size is fixed by ``log_bits`` whatever the table holds, and only it comes to the driver.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1))
    parts = hashes.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for row in parts.collect():
        out[row["part"] * 4096:(row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame, column: str, log_bits: int = 26) -> DataFrame:
    """(part, bits): a bitmap of ``2 ** log_bits`` bits (8 MB) in pieces of 4 KB, with the low bits of every hash of the column set."""
    slot = F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1))
    parts = hashes.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    return stored(parts)


def may_be_in(df: DataFrame, bits: DataFrame, column: str, inside: bool = True, log_bits: int = 26) -> DataFrame:
    """The rows whose hash may be (or surely is not) among those of the bitmap, which is broadcast: its size is fixed."""
    part, held, slot = (fresh(df.columns, n) for n in ("bit_part", "bit_bits", "bit_slot"))
    placed = df.withColumn(slot, F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1)))
    both = placed.join(F.broadcast(bits.select(F.col("part").alias(part), F.col("bits").alias(held))), F.expr(f"`{slot}` div 32768") == F.col(part), "left")
    octet = F.conv(F.hex(F.substring(held, ((F.col(slot) % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.lit(1) == F.getbit(octet, (F.col(slot) % 8).cast("int")), F.lit(False))
    return both.filter(is_set if inside else ~is_set).select(*df.columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet below the folder of ``spark.checkpoint.dir`` and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
