"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

1. A text is its set of hashed shingles of ``shingle`` words (ASCII letters lowered, words cut at ASCII blanks). A text with fewer
   words is one shingle, one without words the empty set. Equal sets are merged at once.
2. Candidates share a key, and a set has keys of two kinds. One kind are the Golay keys of its fingerprint, as in ``simhash``: any two
   sets whose fingerprints differ in at most two bits share one. The other kind reaches copies further apart: ``BANDS`` bands of
   ``ROWS`` minhashes each. Two sets of similarity s share a band with probability 1 - (1 - s^5)^20, which is 0.9996 at 0.8 and above
   0.99999 from 0.87 on.
3. All pairs of a bucket of up to ``max_bucket`` sets are candidates. In a larger bucket every set is first compared with the least
   one, its pivot. If pivot and sets are one component then, no other pair of them can join anything.
4. Where several components remain, sets are joined by what tells them from the pivot. Two sets x and y that differ in at most h
   shingles share at least (d(x) + d(y) - h) / 2 of the d(x) and d(y) shingles in which they differ from it. So, ordered from the
   rarest on, they share one among the first h / 2 + 1 of the one nearer to the pivot and the first h + 1 of the other. What
   pages have in common with their pivot is not among these shingles, and what only one page has meets nothing, so crowds of pages
   on one template or of copies with edits of their own bring few candidates, and none is left out.
5. Each candidate is verified with the exact similarity of the two sets; what is verified is linked, and links form components.

Only the 64-bit hashes of shingles stand for the words. Texts move only if a bitmap of fixed size lets them through: those whose set
has a candidate, and at the end those that may go. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, WORDS_AT_ONCE, bit_table, fresh, id_and_text, may_be_in, mixed, pieces, rolled, segments, stored
from .simhash import components, golay_keys, majority, near_codewords, syndromes

BANDS, ROWS = 20, 5


def lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: lowers A-Z only, splits at [\x20\x09-\x0D]


def shingles(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct hashes (uint64, ascending) of each text's shingles."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for seg in segments(texts, lowered_words, shingle):
        at = seg.windows(shingle)
        hashes, of = rolled(seg.hashes, shingle)[at], seg.places(at)[0]
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for i, part in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(hashes, cuts)):
            found[i].append(part)
    for i, text in enumerate(texts):
        if not found[i] and (words := lowered_words(text)):
            found[i].append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64))
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.uint64) for f in found]


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` band keys (int64) for every set; none of them may be empty."""
    every, begins = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        factor, offset = mixed(np.array([2 * i + 1, 2 * i + 2], np.uint64) * np.uint64(MULTIPLIER))
        low = np.minimum.reduceat(mixed(every * (factor | np.uint64(1)) + offset), begins)
        keys[:, i // ROWS] = mixed(keys[:, i // ROWS] * np.uint64(MULTIPLIER) + low + np.uint64(i // ROWS))
    return keys.view(np.int64)


def golay_of(sets: list[np.ndarray], table: np.ndarray, single: np.ndarray) -> list[list[int]]:
    """The Golay keys (int64) of every set's fingerprint; sets within two bits of each other share one."""
    fp = np.array([majority(s[at:at + WORDS_AT_ONCE] for at in range(0, len(s), WORDS_AT_ONCE)) for s in sets], np.uint64)
    row, key = golay_keys(fp, table, single)
    order = np.argsort(row, kind="stable")
    keys = mixed(key[order].view(np.uint64) * np.uint64(MULTIPLIER) + np.uint64(BANDS))  # no band has this number
    return [signed(k) for k in np.split(keys, np.searchsorted(row[order], np.arange(1, len(sets))))]


def signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def prints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, set_hash, size, bands) for every row; ``text_hash`` equals Spark's xxhash64, the empty set has hash 0 and no bands.

    ``bands`` holds the set's keys of both kinds.
    """
    def run(batches):
        table, single = near_codewords(), syndromes()
        for piece in pieces(batches):
            texts = piece.column("text").to_pylist()
            sets = shingles(texts, shingle)
            filled = [s for s in sets if len(s)]
            bands = (own + golay for own, golay in zip(bands_of(filled).tolist(), golay_of(filled, table, single))) if filled else iter([])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(signed(np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)), pa.int64()),
                 pa.array(signed(names_of(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "set_hash", "size", "bands"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, set_hash long, size long, bands array<long>")


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0 for s in sets], np.uint64)


def row_key(doc_id, text_hash) -> Column:
    return F.xxhash64(doc_id, text_hash)


def sets_of(docs: DataFrame, rows: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(name, members) of the sets of at least the texts that ``rows(key)`` names."""
    def run(batches):
        for piece in pieces(batches):
            sets = shingles(piece.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(signed(names_of(sets)), pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["name", "members"])

    texts = id_and_text(docs, id_col, text_col).withColumn("key", row_key("doc_id", F.xxhash64("text")))
    found = may_be_in(texts, bit_table(rows, "key"), "key").select("text").mapInArrow(run, "name long, members array<long>")
    return found.groupBy("name").agg(F.first("members").alias("members"))


def near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``percent`` / 100; the sets of ``b`` move to those of ``a``."""
    both = pairs.distinct().join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    near = both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return near.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def rooted(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members(set_hash, ...)`` with ``root``, the component of the set by the links."""
    if links is None:
        return members.withColumn("root", F.col("set_hash"))
    roots = components(links).select(F.col("node").alias("set_hash"), "root")
    return members.join(roots, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))


def still_open(members: DataFrame, key: str) -> DataFrame:
    """(key) of the groups whose sets are of more than one component."""
    return members.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(key)


def prefixes(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, token, place, set_hash, size, away, indexed, root): where each set of ``around(pivot, set_hash, root)`` begins to differ from its pivot.

    ``away`` counts the shingles in only one of the two; a near pair has its first common one among those ``indexed`` of the nearer set.
    """
    both = around.filter("pivot <> set_hash").join(sets.toDF("set_hash", "own"), "set_hash").join(sets.toDF("pivot", "other"), "pivot")
    apart = both.select("pivot", "set_hash", "root", F.size("own").cast("long").alias("size"),
                        F.concat(F.array_except("own", "other"), F.array_except("other", "own")).alias("tokens"))
    tokens = stored(apart.select("pivot", "set_hash", "root", "size", F.explode("tokens").alias("token")))
    counts = tokens.groupBy("pivot", "token").agg(F.count("*").alias("n"))
    ordered = tokens.join(counts, ["pivot", "token"]).groupBy("pivot", "set_hash", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("words"))
    most = F.expr(f"cast(size * {100 - percent} div {percent} as int)")  # shingles in which a partner can differ
    begun = ordered.select("pivot", "set_hash", "root", "size", F.size("words").cast("long").alias("away"), F.floor(most / 2).alias("near"),
                           F.posexplode(F.slice("words", F.lit(1), most + 1)).alias("place", "word"))
    return begun.filter("word.n > 1").select("pivot", "word.token", "place", "set_hash", "size", "away", (F.col("place") <= F.col("near")).alias("indexed"), "root")


def pairs_around(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different components that can share enough of what tells them from their pivot."""
    names = ("set_hash", "size", "away", "place", "root")
    one, two = (df.select("pivot", "token", *[F.col(c).alias(f"{c}_{i}") for c in names]) for i, df in enumerate((entries.filter("indexed"), entries)))
    differ = F.expr(f"(size_0 + size_1) * {100 - percent} div {100 + percent}")
    needed = F.col("away_0") + F.col("away_1") - differ
    enough = 2 * F.least(F.col("away_0") - F.col("place_0"), F.col("away_1") - F.col("place_1")) >= needed
    met = one.join(two, ["pivot", "token"]).filter((F.col("root_0") != F.col("root_1")) & (F.col("away_0") <= F.col("away_1")) & enough & near_sizes(F.col("size_0"), F.col("size_1"), percent))
    return met.select(F.least("set_hash_0", "set_hash_1").alias("a"), F.greatest("set_hash_0", "set_hash_1").alias("b"))


def links_of(docs: DataFrame, distinct: DataFrame, shingle: int, percent: int, max_bucket: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) whose components are those of all near pairs of the sets ``distinct(set_hash, key, size, bands)``."""
    keyed = distinct.select(F.explode("bands").alias("band"), "set_hash", "size")
    shared = stored(keyed.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("set_hash", "size")).alias("least")).filter("n > 1"))
    members = stored(keyed.join(shared, "band"))
    asked = distinct.join(members.select("set_hash").distinct(), "set_hash", "left_semi")
    sets = stored(sets_of(docs, asked, shingle, id_col, text_col))

    close = members.filter(F.col("n") <= max_bucket).select("band", "set_hash", "size")
    a, b = (close.select("band", *[F.col(c).alias(f"{c}_{i}") for c in ("set_hash", "size")]) for i in range(2))
    pairs = a.join(b, "band").filter((F.col("set_hash_0") < F.col("set_hash_1")) & near_sizes(F.col("size_0"), F.col("size_1"), percent)).select(
        F.col("set_hash_0").alias("a"), F.col("set_hash_1").alias("b"))
    crowded = members.filter(F.col("n") > max_bucket)
    first = crowded.filter((F.col("least.set_hash") < F.col("set_hash")) & near_sizes(F.col("size"), F.col("least.size"), percent))
    links = stored(verified(pairs.unionByName(first.select(F.col("least.set_hash").alias("a"), F.col("set_hash").alias("b"))), sets, percent))

    pivots = F.col("least.set_hash").alias("pivot")
    around = rooted(crowded.select(pivots, "set_hash").distinct(), links)  # the pivot is one of its own sets
    around = stored(around.join(still_open(around, "pivot"), "pivot", "left_semi"))
    if around.isEmpty():
        return links
    met = stored(pairs_around(stored(prefixes(around, sets, percent)), percent).distinct())
    return links.unionByName(verified(met, sets, percent))


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, max_bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id, component_set) for every row of ``docs``.

    component_id is the smallest doc_id of the component, component_set one of its sets, which tells components apart. Texts without
    words are copies of each other. Null ids take part, but are never a component's id unless all its ids are null.
    """
    rows = stored(prints(docs, shingle, id_col, text_col))
    one = F.min(F.struct("doc_id", "text_hash"))
    distinct = stored(rows.groupBy("set_hash").agg(F.min("doc_id").alias("least"), one.alias("one"), F.first("size").alias("size"), F.first("bands").alias("bands"))
                      .select("set_hash", "least", row_key("one.doc_id", "one.text_hash").alias("key"), "size", "bands"))
    links = links_of(docs, distinct, shingle, percent, max_bucket, id_col, text_col)
    named = rooted(distinct.select("set_hash", "least"), links)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("set_hash", "component_id", F.col("root").alias("component_set"))
    return rows.select("doc_id", "text_hash", "set_hash").join(named, "set_hash").select("doc_id", "text_hash", "component_id", "component_set")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, max_bucket: int = 32) -> DataFrame:
    """The document with the smallest id of every component, with all its columns.

    If that id has several texts in the component, the one with the smallest hash stays, and of rows equal in id and text one stays.
    Rows that surely stay do not move; those that a bitmap of the others lets through are looked up.
    """
    found = stored(near_copies(docs, shingle, percent, max_bucket).groupBy("doc_id", "text_hash", "component_id", "component_set").agg(F.count("*").alias("n")))
    own = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("doc_id", "component_set").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash", F.lit(True).alias("stays"))
    same = F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.text_hash") == F.col("k.text_hash"))
    told = stored(found.alias("f").join(first.alias("k"), same, "left").select(
        "f.doc_id", "f.text_hash", "f.n", F.coalesce("k.stays", F.lit(False)).alias("stays"), row_key("f.doc_id", "f.text_hash").alias("key")).filter("NOT stays OR n > 1"))
    name = dict(zip(("id", "hash", "key"), (fresh(docs.columns, n) for n in ("kept_id", "kept_hash", "kept_key"))))
    own_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.withColumn(name["key"], row_key(F.col("doc_id").cast("long"), own_hash))
    bits = bit_table(told, "key")
    sure = may_be_in(marked, bits, name["key"], inside=False).drop(name["key"])
    asked = may_be_in(marked, bits, name["key"]).withColumns({name["id"]: F.col("doc_id").cast("long"), name["hash"]: own_hash})
    asked = asked.dropDuplicates([name["id"], name["hash"]])
    gone = told.filter("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    kept = asked.join(gone, F.col(name["id"]).eqNullSafe(F.col("gone_id")) & (F.col(name["hash"]) == F.col("gone_hash")), "left_anti")
    return sure.unionByName(kept.drop(*name.values()))
