"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from recordlake.llm import common, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, k):
    first = {}
    key = lambda i: -(1 << 63) if i is None else i
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for a in range(len(w) - k + 1):
            g = tuple(w[a:a + k])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in texts:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < key(i):
                gone |= set(range(a, a + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "the", "É", "ñ", "x.", "\x1cq", " "]
    passages = [" ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.randrange(5, 60))) for _ in range(25)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(7))]
        rows.append((rng.randrange(-99, 999), rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1]), (None, None), (5, ""), (2000, "a " * 400), (2001, "a " * 30), (2002, " ".join(rows[7][1].split()[:14]))]
    return rows


@pytest.mark.parametrize("k,m,log_bits,at_once", [(13, 5, 26, 1 << 16), (13, 5, 16, 40), (4, 2, 18, 1 << 16), (6, 6, 20, 7)])
def test_equals_brute_force(spark, monkeypatch, k, m, log_bits, at_once):
    monkeypatch.setattr(common, "WORDS_AT_ONCE", at_once)
    rows = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.digest(repeats.without_repeats(docs, k, m, log_bits))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str)
    assert got == slow(rows, k) and sum(r[2] for r in got) > 200


def test_passages_have_the_coordinates_of_their_first_document(spark):
    common_part = " ".join("c%d" % i for i in range(20))
    other = " ".join("o%d" % i for i in range(15))
    rows = [(3, "x y " + common_part + " z"), (7, common_part), (9, "q " + common_part + " r " + other), (4, "w w w " + other), (11, "nothing here " * 9)]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.owner, r.start, r.n_words) for r in got) == [(3, 2, 20), (4, 3, 15)]


def test_edges_of_the_input(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = repeats.digest(repeats.without_repeats(spark.createDataFrame([(1, "a b c", 1, [1])], "doc_id long, text string, owner int, own array<int>"))).first()
    assert (got.n_words, got.n_removed, got.kept_sha256) == (3, 0, hashlib.sha256(b"a b c").hexdigest())
