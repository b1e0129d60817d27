"""Vectors compressed to a few bytes: each is cut into parts, and each part is replaced by the index of its nearest codebook entry.

Everything is computed in integers. A component x becomes floor(1024 * x). Dot products run as matrix products in float64: integers
are broken into limbs so short that every sum of a product stays below 2 ** 53, where float64 is exact, and the products of limbs are
put together in int64. So distances, ties and codebooks are exact and do not depend on how rows are dealt to tasks.

Rows with a null vector, or with a null or non-finite component, go. Vectors of unequal length count as filled with zeros up to the
longest one, rounded up to a multiple of the number of parts. Components are held within the bound beyond which a squared distance
would not fit into 64 bits (at 64 components: 185,000). A null id is the largest one and a row as any other, repeated rows and ids
stay; a label's error is null if it exceeds 64 bits. Other columns are not read. An empty table gives an empty one.

What comes to the driver are codebooks and their sums, whose size is that of ``entries`` vectors whatever the table holds.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Numbers of a block of distances that a task holds at once.
BLOCK = 1 << 20
#: A label with more than one in so many rows is hot; there are fewer such labels than this.
HOT_SHARE = 256


def limb_bits(width: int) -> int:
    """Bits of a limb, so that ``width`` products of two limbs add up to less than 2 ** 53."""
    return (53 - max(1, width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Arrays (float64) with x = sum of limb[i] << (bits * i); all but the last are in [0, 2 ** bits), the last is signed."""
    out = []
    while x.size and not (-(1 << bits) <= x.min() and x.max() <= 1 << bits):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T in int64 for integer matrices, through float64 products of limbs."""
    bits = bits or limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    of_b = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(of_b):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the least on ties; its squared distance) for every row of ``x``."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (entries * entries).sum(1)
    size = max(1, BLOCK // max(1, len(entries)))
    for at in range(0, len(x), size):
        some = x[at:at + size]
        far = norms - 2 * exact_products(some, entries, bits)
        code[at:at + size] = best = far.argmin(1)
        error[at:at + size] = far[np.arange(len(some)), best] + (some * some).sum(1)
    return code, error


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, vector as doubles) of the rows whose vector has finite components only."""
    vector = F.col(vector_col).cast("array<double>")
    largest = F.lit(float(np.finfo(np.float64).max))  # NaN is larger than every number here
    finite = F.forall(vector, lambda x: x.isNotNull() & (x >= -largest) & (x <= largest))
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    return vectors.filter(F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("vec_id"), label.alias("label"), vector.alias("vector"))


class Shape:
    """How vectors of a table are cut."""

    def __init__(self, longest: int, parts: int):
        self.parts = parts
        self.width = -(-longest // parts)
        self.bound = isqrt((1 << 63) // max(1, self.width * parts)) // 2

    def integers(self, column: pa.Array) -> np.ndarray:
        """The vectors as an array (rows, parts, width) of int64."""
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        values = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE), -self.bound, self.bound).astype(np.int64)
        out = np.zeros((len(lengths), self.parts * self.width), np.int64)
        out[np.arange(self.parts * self.width) < lengths[:, None]] = values
        return out.reshape(len(lengths), self.parts, self.width)


def slices(batches, size: int):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Shape, np.ndarray]:
    """(shape, codebooks as an array (parts, entries, width)) of ``rows(vec_id, vector)``.

    Codebooks start as the vectors with the smallest ids. In every round each part goes to its nearest entry, and each entry that has
    parts becomes their mean, rounded down; tasks send one sum per entry. A table with fewer rows than ``entries`` has fewer entries.
    """
    shape = Shape(rows.agg(F.max(F.size("vector"))).first()[0] or 0, parts)
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow().combine_chunks()
    start = [shape.integers(b.column("vector")) for b in first.to_batches() if b.num_rows]
    books = np.concatenate(start).transpose(1, 0, 2).copy() if start else np.zeros((parts, 0, shape.width), np.int64)
    size = max(1, BLOCK // max(1, parts * shape.width))

    for _ in range(rounds if books.size else 0):
        held = books  # the codebooks of this round travel with its tasks

        def sums(batches):
            total, count = np.zeros_like(held), np.zeros(held.shape[:2], np.int64)
            for batch in slices(batches, size):
                x = shape.integers(batch.column("vector"))
                for p in range(parts):
                    code, _ = nearest(x[:, p], held[p])
                    order = np.argsort(code, kind="stable")
                    used, begins = np.unique(code[order], return_index=True)
                    total[p][used] += np.add.reduceat(x[order, p], begins)
                    count[p] += np.bincount(code, minlength=held.shape[1])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                                             ["part", "entry", "n", "total"])

        found = rows.select("vector").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        by_place = found.select("part", "entry", "n", F.posexplode("total").alias("place", "total")).groupBy("part", "entry", "place").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in by_place.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return shape, books


def encode(rows: DataFrame, shape: Shape, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``rows(vec_id, label, vector)``; two hex digits of ``code`` for every part."""
    size = max(1, BLOCK // max(1, shape.parts * shape.width))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in slices(batches, size):
            x = shape.integers(batch.column("vector"))
            codes, error = np.zeros((len(x), shape.parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(shape.parts):
                code, far = nearest(x[:, p], books[p])
                codes[:, p] = code
                error += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over the rows with the same label; null labels are one label.

    Labels with more than one in ``HOT_SHARE`` rows are fewer than that and are broadcast, so their rows do not move; all other labels
    have few rows each and are joined by a shuffle.
    """
    n = coded.count()
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = stored(sums)
    hot, cold = sums.filter(F.col("n") * HOT_SHARE > n), sums.filter(F.col("n") * HOT_SHARE <= n)
    same: Column = F.col("label").eqNullSafe(F.col("of"))
    often = coded.join(F.broadcast(hot), same)
    seldom = coded.join(F.broadcast(hot.select("of")), same, "left_anti").join(cold, same)
    return often.unionByName(seldom).drop("of", "n")


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str | None = "label") -> tuple[DataFrame, Shape, np.ndarray]:
    """((vec_id, label, code, error, label_error) of every kept row, shape, codebooks)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has to fit into two hex digits")
    rows = kept(vectors, id_col, vector_col, label_col)
    shape, books = learn(rows, parts, entries, rounds)
    return with_label_error(stored(encode(rows, shape, books))), shape, books


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``restored``: the vector that a row's ``code`` stands for, with the zeros that fill short vectors."""
    taken = fresh(coded.columns, "restored")

    def run(batches):
        for batch in slices(batches, max(1, BLOCK // max(1, books[:, 0].size))):
            codes = [np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column("code").to_pylist()]
            vectors = [(books[np.arange(len(c)), c].ravel() / SCALE) for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, taken])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{kinds}, {taken} array<double>")


def digest(vectors: DataFrame) -> DataFrame:
    coded, _, books = compress(vectors)
    name = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
