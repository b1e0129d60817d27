import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def slow(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = []
    for _, v, _ in kept:
        v = [math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v))
        cut.append([v[p * width:(p + 1) * width] for p in range(parts)])
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[best(c[p], books[p])[1]].append(c[p])
            for i, members in held.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members)]
    out, by_label = [], Counter()
    for (i, _, label), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
        by_label[label] += out[-1][3]
    return Counter((i, code, e, by_label[label]) for i, label, code, e in out), books


def vectors(n, width, scale, seed):
    rng = np.random.default_rng(seed)
    return [(i * 3, (rng.normal(size=width) * scale).tolist(), None if i % 7 == 0 else "hot" if i % 3 else f"l{i % 50}") for i in range(n)]


def odd():
    rows = vectors(320, 8, 1, 1)
    rows += [(9000, None, "a"), (9001, [1.0, None] * 4, "a"), (9002, [1.0, math.nan] * 4, "a"), (9003, [math.inf] * 8, "a"), (9004, [-math.inf] * 8, "a")]
    rows += [(9005, [], "b"), (9006, [0.5] * 5, "b"), (9007, [-0.0001] * 8, None), (None, [3.0] * 8, None), (None, [3.0] * 8, None)]
    return rows + rows[:3] + [(i, rows[5][1], "copies") for i in range(10_000, 10_200)]


@pytest.mark.parametrize("rows", [vectors(300, 8, 1, 0), vectors(60, 6, 1, 2), vectors(290, 12, 30_000, 3), odd()], ids=["plain", "few", "large", "odd"])
def test_equals_brute_force(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    got = vector_codes.digest(table).collect()
    want, books = slow(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("bits", [None, 3, 9, 20])
def test_products_of_limbs_are_exact(bits):
    rng = np.random.default_rng(5)
    for size in (5, 1000, 1 << 27):
        a, b = rng.integers(-size, size, (40, 16)), rng.integers(-size, size, (30, 16))
        a[0], b[0], a[1], b[1] = size, -size, -size, -size
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert vector_codes.exact_products(a, b, bits).tolist() == want
    assert 16 * 2 ** (2 * vector_codes.limb_bits(16)) <= 1 << 53 and 17 * 2 ** (2 * vector_codes.limb_bits(17)) <= 1 << 53


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 2)] * 4, "a") for i in range(6)]
    coded, _, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert {r.vec_id: r.code for r in coded.collect()} == {i: "00" * 4 if i % 2 == 0 else "01" * 4 for i in range(6)}
    assert books[0, :, 0].tolist() == [0, 1024] * 3


def test_empty_table_and_single_precision(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.digest(none).collect() == [] and vector_codes.digest(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    gone = spark.createDataFrame([(1, None, "a")], SCHEMA)
    assert vector_codes.digest(gone).collect() == []
    empty = spark.createDataFrame([(1, [], "a"), (2, [], "a")], SCHEMA)
    assert {(r.vec_id, r.code, r.error) for r in vector_codes.digest(empty).collect()} == {(1, "00000000", 0), (2, "00000000", 0)}
    rows = vectors(50, 8, 1, 4)
    floats = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    exact = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in floats.collect()]
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.digest(floats).collect()) == slow(exact)[0]


def test_decoded_vectors_are_near(spark):
    table = spark.createDataFrame(vectors(300, 8, 1, 6), SCHEMA)
    coded, _, books = vector_codes.compress(table, label_col=None)
    back = {r.vec_id: r for r in vector_codes.decode(coded, books).collect()}
    for r in table.collect():
        x, y = np.floor(np.array(r.embedding) * 1024), np.array(back[r.vec_id].restored) * 1024
        assert int(((x - y) ** 2).sum()) == back[r.vec_id].error
