"""Documents packed into sequences of a fixed number of tokens by a grouping genetic algorithm on islands.

Only documents longer than a sequence are cut; their whole pieces are sequences of their own. All other pieces are dealt at random
to blocks of bounded size. Each block is solved on several islands, one task each: a population starts from best-fit orders, and a
crossover injects well-filled bins of one parent into the other, drops the bins that hold the same pieces, and puts the displaced
pieces where they fit best. After an epoch the best solutions migrate to the block's next island; after the last one the best
island's solution stands. The pieces of the bins that blocks leave unfilled are pooled, dealt to fewer blocks and packed again,
until one block is left or nothing can be gained. An island ends when its bins reach the lower bound.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, pieces, stored
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids and then ``end_id``, cut only if longer than ``size``.

    Pieces have ``size`` tokens; the first one takes what remains. ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    def run(batches):
        encode = encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate((encode(text.decode()), end)).astype("<u4", copy=False)
                starts = [0, *range(len(ids) % size or size, len(ids), size)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    raw = ids[a:b].tobytes()
                    rows.append((doc, piece, a, b - a, zlib.crc32(raw), *((raw,) if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return id_and_text(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Bins found by the room left in them: ``stacks[room]`` holds bins, ``mask`` has a bit for each room that occurs."""

    def __init__(self, size: int):
        self.size, self.stacks, self.mask, self.count = size, [[] for _ in range(size + 1)], 0, 0

    def add(self, b: int, room: int) -> None:
        self.stacks[room].append(b)
        self.mask |= 1 << room

    def put(self, length: int) -> int:
        """Puts a piece into the fullest bin that has room, or into a new bin; returns the bin."""
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = self.stacks[room].pop()
            if not self.stacks[room]:
                self.mask &= ~(1 << room)
        else:
            room, b = self.size, self.count
            self.count += 1
        self.add(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    bins, out = Bins(size), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        out[i] = bins.put(int(lengths[i]))
    return out


def cost(lengths: np.ndarray, bin_of: np.ndarray, size: int) -> tuple[int, float]:
    """Bins used, then how unevenly they are filled: fewer is better, and of equals the one with fuller full bins."""
    fill = np.bincount(bin_of, lengths) / size
    fill = fill[fill > 0]
    return len(fill), -float((fill ** 2).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``b`` with well-filled bins of ``a``."""
    fill = np.bincount(a, lengths, minlength=a.max() + 1)
    well = (fill >= np.median(fill[fill > 0])) & (rng.random(len(fill)) < 0.5)
    injected = well[a]
    hit = np.zeros(b.max() + 1, bool)
    hit[b[injected]] = True
    # Besides the bins with injected pieces, a few of the emptiest are opened up.
    rest = np.bincount(b, lengths, minlength=len(hit))
    hit[np.argsort(np.where(rest > 0, rest, np.inf))[: max(1, len(hit) // 50)]] = True
    kept = ~injected & ~hit[b]
    child = np.full(len(lengths), -1, np.int64)
    named: dict[tuple[int, int], int] = {}
    for parent, chosen in ((0, a[injected]), (1, b[kept])):
        for x in np.unique(chosen).tolist():
            named[parent, x] = len(named)
    child[injected] = [named[0, x] for x in a[injected].tolist()]
    child[kept] = [named[1, x] for x in b[kept].tolist()]
    bins = Bins(size)
    bins.count = len(named)
    used = np.bincount(child[child >= 0], lengths[child >= 0], minlength=len(named)).astype(np.int64)
    for x, n in enumerate(used.tolist()):
        bins.add(x, size - n)
    displaced = np.flatnonzero(child < 0)
    for i in displaced[np.argsort(-lengths[displaced], kind="stable")].tolist():
        child[i] = bins.put(int(lengths[i]))
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], size: int, generations: int, population: int, seed: int) -> list[np.ndarray]:
    """The population after some generations, best first. ``seeds`` are solutions to start from."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // size)
    folk = [(cost(lengths, s, size), s) for s in seeds]
    decreasing = np.argsort(-lengths, kind="stable")
    while len(folk) < population and min((c[0] for c, _ in folk), default=bound + 1) > bound:
        # Decreasing order first, then orders that are disturbed more and more.
        order = decreasing if not folk else np.argsort(-lengths * rng.uniform(1 - 0.1 * len(folk), 1, len(lengths)), kind="stable")
        s = best_fit(lengths, order, size)
        folk.append((cost(lengths, s, size), s))
    folk.sort(key=lambda x: x[0])
    for _ in range(generations):
        if folk[0][0][0] <= bound or len(folk) < 2:
            break
        i, j = rng.choice(len(folk), 2, replace=False)
        child = crossover(lengths, folk[i][1], folk[j][1], size, rng)
        folk.append((cost(lengths, child, size), child))
        folk = sorted(folk, key=lambda x: x[0])[:population]
    return [s for _, s in folk]


def as_bytes(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def pack_blocks(items: DataFrame, size: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(uid, block, bin, offset, fill, length) for items (uid, length, block); a block's solution is the best of its islands."""
    spread = items.select("uid", "length", "block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    schema = "block long, island int, bins long, evenness double, solution binary"

    def epoch(last: bool):
        def run(key: tuple, mine: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            if not len(mine):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            mine = mine.sort_values("uid", kind="stable")
            lengths = mine["length"].to_numpy(np.int64)
            seeds = [np.frombuffer(s, "<i4").astype(np.int64) for s in elites["solution"]]
            seeds = sorted(seeds, key=lambda s: (cost(lengths, s, size), s.tobytes()))
            block, island = (int(k) for k in key)
            best = evolve(lengths, seeds, size, generations, population, zlib.crc32(f"{block} {island} {len(seeds)}".encode()))
            rows = [(block, island, *cost(lengths, s, size), as_bytes(s)) for s in best[: 1 if last else 2]]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        return run

    key = ["block", "island"]
    elites = items.sparkSession.createDataFrame([], schema)
    for e in range(epochs):
        # Each island keeps its best and sends its elite on to the next one.
        moved = elites.withColumn("island", F.explode(F.array_distinct(F.array("island", ((F.col("island") + 1) % islands).cast("int")))))
        elites = spread.groupBy(*key).cogroup(moved.groupBy(*key)).applyInPandas(epoch(e == epochs - 1), schema)
    best = elites.groupBy("block").agg(F.min_by("solution", F.struct("bins", "evenness", "island")).alias("solution"))

    def place(key: tuple, mine: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("uid", kind="stable").reset_index(drop=True)
        names = np.frombuffer(solved["solution"].iloc[0], "<i4")
        mine["bin"] = np.unique(names, return_inverse=True)[1].astype(np.int64)
        mine["fill"] = mine.groupby("bin")["length"].transform("sum")
        mine["offset"] = mine.groupby("bin")["length"].cumsum() - mine["length"]
        return mine[["uid", "block", "bin", "offset", "fill", "length"]]

    return items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, "uid long, block long, bin long, offset long, fill long, length long")


def pack(cut: DataFrame, size: int = 2048, block_items: int = 6000, islands: int = 2, epochs: int = 2, generations: int = 6, population: int = 4,
         full_enough: float = 0.995) -> DataFrame:
    """``cut`` with sequence_id and offset; rows of a sequence fill it gapless from 0.

    ``cut`` has ``length`` <= size and any other columns but these two.

    Repeated rows are pieces of their own. An empty table gives an empty one.
    """
    uid = fresh(cut.columns, "uid")
    named = stored(cut.withColumn(uid, F.monotonically_increasing_id()))
    whole = named.filter(F.col("length") >= size).withColumn("sequence_id", -1 - F.col(uid)).withColumn("offset", F.lit(0).cast("long"))
    pool, rounds, done = named.filter(F.col("length") < size).select(F.col(uid).alias("uid"), "length"), 0, []
    count = pool.count()
    while count:
        blocks = -(-count // block_items)
        dealt = pool.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(rounds)), F.lit(blocks)))
        placed = stored(pack_blocks(dealt, size, islands, epochs, generations, population))
        final = F.col("fill") >= int(full_enough * size) if blocks > 1 else F.lit(True)
        left = placed.filter(~final).select("uid", "length")
        rest = left.count() if blocks > 1 else 0
        if rest > 0.9 * count:  # pooling them again would gain nothing
            final, rest = F.lit(True), 0
        done.append(placed.filter(final).select("uid", (F.lit(rounds << 56) + F.shiftleft(F.col("block"), 24) + F.col("bin")).alias("sequence_id"), "offset"))
        pool, count, rounds = left, rest, rounds + 1
    for i, d in enumerate(done):
        done[0] = d if i == 0 else done[0].unionByName(d)
    out = [*cut.columns, "sequence_id", "offset"]
    if not done:
        return whole.select(*out)
    return named.join(done[0].withColumnRenamed("uid", uid), uid).select(*out).unionByName(whole.select(*out))


def packed_documents(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False, **how) -> DataFrame:
    """All documents packed: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row per piece.

    A null or empty text is one piece with ``end_id`` alone. Repeated rows and rows with null ids are packed each on its own.
    """
    return pack(token_pieces(docs, size, end_id, path, with_ids), size, **how)
