"""SimHash against all pairs of fingerprints computed one by one."""

import random
from collections import defaultdict

import xxhash

from recordlake.llm import simhash


def slow_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def corpus(n=150):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["É", "ñandú", "Über", "İ"]
    rows = []
    for i in range(n):
        if i % 3 == 1:
            base = rows[rng.randrange(len(rows))][1].split(" ")
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base)))
        elif i % 17 == 2:
            rows.append((i, rows[rng.randrange(len(rows))][1].upper()))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 40, 300])))))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b"), (n + 5, "a b")]


def test_equals_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [slow_print(t) for _, t in rows]
    roots = slow_components(prints)
    least = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, roots):
        least[r] = min(least[r], i)
    want = sorted((i, p, least[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len(set(w[2] for w in want)) < len(want) - 10


def test_words_within_two_bits_share_a_codeword():
    table, single = simhash.near_codewords(), simhash.syndromes()
    rng = random.Random(1)

    def near(word):
        s = 0
        for b in range(23):
            s ^= int(single[b]) if word >> b & 1 else 0
        return {word ^ int(c) for c in table[s] if c >= 0}

    for _ in range(500):
        x = rng.randrange(1 << 23)
        y = x ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        assert near(x) & near(y)


def test_links_of_crowded_buckets(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for limit in (4, 64, 1000):
        found = simhash.components(simhash.links(frame, limit)).collect()
        groups = defaultdict(set)
        for r in found:
            groups[r.root].add(r.node % (1 << 64))
        want = defaultdict(set)
        for p, r in zip(prints, slow_components(prints)):
            want[r].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "x y z", 1), (None, None, 2), (7, "", 3), (5, "x y z", 4), (5, "x y z", 5)], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp == 0, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, False, 5), (None, True, 7), (7, True, 7), (5, False, 5), (5, False, 5)], key=str)
