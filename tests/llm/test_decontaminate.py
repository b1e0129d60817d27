"""Spaced seeds against a comparison of every window with every item."""

import random
import re

import pytest

from recordlake.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def slow(docs, items, window, errors, least, short_errors=1):
    out = []
    for i, t in docs:
        w, places, found = words(t), [], set()
        units = {tuple(words(u)) for line in (t or "").split("\n") for u in [line, *re.split(r"[.!?\u3002\uff01\uff1f]+(?=\s|$)", line)]}
        short = [(tuple(words(q)), item) for item, q in items if 0 < len(words(q)) < least and tuple(words(q)) in units]
        for item, q in items:
            v = words(q)
            size, allowed = (window, errors) if len(v) >= window else (len(v), short_errors)
            if size < least:
                continue
            for a in range(len(w) - size + 1):
                if any(sum(x != y for x, y in zip(w[a:a + size], v[b:b + size])) <= allowed for b in range(len(v) - size + 1)):
                    places.append((a, size))
                    found.add(item)
        out.append((i, bool(places), min((f for f in found if f is not None), default=None), len(set(places)), min((a for a, _ in places), default=None),
                    max((a + s - 1 for a, s in places), default=None), min((f for _, f in short if f is not None), default=None), len({q for q, _ in short})))
    return sorted(out, key=str)


def test_every_error_is_ignored_by_some_mask():
    from itertools import combinations

    for window, errors in ((13, 2), (13, 1), (9, 3), (5, 0)):
        shapes = decontaminate.masks(window, errors)
        for bad in combinations(range(window), errors):
            assert any(not set(bad) & set(s) for s in shapes)


@pytest.mark.parametrize("window,errors,at_once", [(13, 2, 1 << 16), (13, 2, 20), (8, 1, 1 << 16)])
def test_equals_brute_force(spark, monkeypatch, window, errors, at_once):
    monkeypatch.setattr(common, "WORDS_AT_ONCE", at_once)
    rng = random.Random(window + errors)
    pool = ["w%d" % i for i in range(60)] + ["Éa", "ñ", "X"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 13, 15, 30, 40])))) for i in range(45)] + [(None, "q r s t u v w x y z a b c d"), (51, None), (52, ""), (53, "?!"), (54, "W1 éa?"), (2, items_text(rng, pool))]
    docs = []
    for i in range(120):
        w = [rng.choice(pool) for _ in range(rng.randrange(60))]
        if i % 2:
            part = rng.choice(items)[1] or ""
            part = part.upper().split(" ")
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(pool)
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n", ". ", "? "]).join(w)))
    docs += [(200 + i, "Q: " + q + "\n" + (q or "").upper() + "!\nw1 w2") for i, q in items[:45]]
    docs += [(260, "He said so.  W1, éa? No"), (261, "w1 éa w2. 3.5 w1 éa"), (262, "no.w1 éa\u3002")]
    docs += [(None, items[3][1]), (7, None), (7, ""), docs[9], (9, items[4][1] * 2)]
    got = decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"),
                                window=window, max_errors=errors, min_words=6)
    got = sorted(((r.doc_id, r.contaminated, r.item_id, r.n_windows, r.first_word, r.last_word, r.short_item_id, r.n_short) for r in got.collect()), key=str)
    assert got == slow(docs, items, window, errors, 6) and sum(g[1] for g in got) > 20
    assert any(g[7] and not g[1] for g in got) and {g[0]: g[7] for g in got if g[0] in (260, 261, 262)} == {260: 1, 261: 0, 262: 0}


def test_every_length_with_its_substitutions_is_found(spark):
    """Items of 1 to 40 words: found with as many substitutions as the module promises for their length."""
    items, docs = [], []
    for n in range(1, 41):
        own = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(own)))
        errors = 0 if n < 8 else 1 if n < 13 else 2
        for at in range(n):
            changed = list(own)
            for e in range(errors):
                changed[(at + e * 3) % n] = "other"
            docs.append((n * 100 + at, "before it\n" + " ".join(changed) + "\nand after"))
    got = decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    assert [r.doc_id for r in got if (r.item_id if r.doc_id >= 800 else r.short_item_id) != r.doc_id // 100] == []
    assert not any(r.contaminated for r in got if r.doc_id < 800)


def items_text(rng, pool):
    return " ".join(rng.choice(pool) for _ in range(20))


def test_edges_of_the_input(spark):
    schema, items = "doc_id long, text string, seed int, leak_id string", "item_id long, text string"
    passage = " ".join("p%d" % i for i in range(13))
    bench = spark.createDataFrame([(1, passage)], items)
    docs = spark.createDataFrame([(1, "a " + passage, 0, "x"), (None, "clean", 0, "y"), (3, None, 0, None), (3, passage, 0, None)], schema)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", None), ("None", "clean")]
    assert decontaminate.clean(docs, spark.createDataFrame([], items)).count() == 4
    assert decontaminate.flagged(spark.createDataFrame([], schema), bench).count() == 0
