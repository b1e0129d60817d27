"""SimHash near-duplicates found with Golay-code keys.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes of its word shingles. Fingerprints that
differ in at most two bits are linked, and linked documents form components.

Candidates. The fingerprint is cut into three segments, each fitting a word of the perfect binary Golay code (23 bits). Two
differing bits leave one segment untouched, and what they change in another one is at most two bits. So the key of a fingerprint
is an untouched segment together with the index of a codeword near the next segment. Every word has one codeword within distance
three and, if it is at distance three, five more at distance four; two words that differ in up to two bits share at least one of
these. This gives 3 to 18 keys of about 34 bits for a fingerprint, and no pair within two bits is lost.

Copies share a fingerprint and are merged before any key is made. Buckets of up to ``max_bucket`` fingerprints are joined with
themselves and verified. The fingerprints of larger buckets are linked through the words at distance one instead: two
fingerprints are within two bits exactly if they share such a word, at most 65 fingerprints do, and all of those are linked.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, per_text, stored

#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the (23, 12) Golay code.
GENERATOR = 0b110001110101
WORDS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned number; 0 without words."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at [\x20\x09-\x0D]
    if not words:
        return 0
    k = min(shingle, len(words))

    def hashed():
        for at in range(0, len(words) - k + 1, WORDS_AT_ONCE):
            part = words[at:min(at + WORDS_AT_ONCE, len(words) - k + 1) + k - 1]
            joined = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[:len(part) - k + 1]
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())], np.uint64)

    return majority(hashed())


def majority(parts: Iterable[np.ndarray]) -> int:
    """The 64 bits of which each is set in over half of the hashes (uint64), as an unsigned number."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) for every row; ``fp`` holds the 64 bits as a signed long, ``text_hash`` equals Spark's xxhash64."""
    def run(text: bytes) -> tuple[int, int]:
        return tuple(v - (1 << 64) if v >> 63 else v for v in (fingerprint(text, shingle), xxhash.xxh64_intdigest(text, 42)))

    return id_and_text(docs, id_col, text_col).mapInArrow(per_text(run, "fp long, text_hash long"), "doc_id long, fp long, text_hash long")


def syndromes() -> np.ndarray:
    """The syndrome of each single bit of a 23-bit word."""
    out = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for j in range(i, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        out[i] = r
    return out


def near_codewords() -> np.ndarray:
    """For each syndrome the changes, up to six, that lead to the codewords within distance four; unused places hold -1."""
    single = syndromes()
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)

    def add(bits: tuple[int, ...]) -> None:
        s = 0
        for b in bits:
            s ^= int(single[b])
        # Distance four counts only where no codeword is nearer than three.
        if len(bits) < 4 or used[s] and bin(table[s, 0]).count("1") == 3:
            table[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1

    from itertools import combinations

    for weight in range(5):
        for bits in combinations(range(23), weight):
            add(bits)
    return table


def golay_keys(fp: np.ndarray, table: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): (index into ``fp``, key)."""
    cut = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(cut):
        word = cut[(i + 1) % 3]
        s = np.zeros(len(word), np.int64)
        for b in range(23):
            s ^= np.where(word >> b & 1, single[b], 0)
        for change in table[s].T:
            has = np.flatnonzero(change >= 0)
            index = (word[has] ^ change[has]) >> 11
            rows.append(has)
            keys.append((i << 34) | (exact[has] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def links(prints: DataFrame, max_bucket: int = 64) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of the distinct fingerprints ``prints(fp)`` within two bits."""
    def keyed(batches):
        table, single = near_codewords(), syndromes()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = golay_keys(fp, table, single)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["key", "fp"])

    keys = stored(prints.select("fp").mapInArrow(keyed, "key long, fp long"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    small = sizes.filter(F.col("n") <= max_bucket).select("key")
    close = keys.join(small, "key", "left_semi")
    a, b = close.select("key", F.col("fp").alias("a")), close.select("key", F.col("fp").alias("b"))
    found = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = keys.join(sizes.filter(F.col("n") > max_bucket).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    words = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    through = words.join(least, "word").filter("a < fp").select("a", F.col("fp").alias("b"))
    return found.union(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached.

    Alternates the large-star and the small-star step until nothing changes; each round is stored, and only its row count and
    checksum come to the driver.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash, component_id, component_fp) for every row of ``docs``.

    component_id is the smallest doc_id of the component, component_fp one of its fingerprints, which tells components apart.

    A null or empty text, or one without words, has fingerprint 0. Null ids take part, but are never a component's id unless all its
    ids are null. Repeated rows stay; rows with one id and several texts are several members. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, max_bucket)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    return prints.join(named, "fp").select("doc_id", "fp", "text_hash", "component_id", "component_fp")


def hex_print(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
