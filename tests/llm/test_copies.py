"""Near copies against the exact similarity of all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import common, copies, language, simhash

from .slow import slow_roots, slow_set
from .test_decontaminate import slow as slow_leaks
from .test_lines import BLANK, lowered
from .test_pipeline import fixture


def edited(words, rng, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice(vocabulary)]
    return words


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(3000)] + ["É", "ñandú", "İ"]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400, 900]))]
        rows.append(base)
        # Copies on both sides of the limit: an edit changes about five of n shingles.
        rows += [edited(base, rng, max(1, len(base) * share // 1000), vocabulary) for share in (4, 12, 18, 22, 26, 40)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows += [edited(base, rng, 1, vocabulary) for _ in range(60)]
    texts = [" ".join(r) for r in rows] + ["", None, " \n", "one", "ONE", "a b c", "a b c d", "a b c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


def test_stage_keeps_one_of_edited_copies(spark):
    rows = corpus()
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    want = sorted(set(slow_roots([t for _, t in rows])))
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows) - 150


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(common, "WORDS_AT_ONCE", 64)
    texts = [t.encode() for _, t in corpus() if t]
    cut = copies.shingles(texts, 5)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(cut, copies.shingles(texts, 5)))
    assert [len(s) for s in cut] == [len(slow_set(t.decode())) for t in texts]


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert copies.keep_one(empty).count() == 0
    odd = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (4, "x"), (4, "x"), (5, "y z"), (5, "q r"), (6, "Y  z")]
    kept = sorted(map(tuple, copies.keep_one(spark.createDataFrame(odd, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(None, "a b c d e f"), (4, "x"), (5, "y z"), (5, "q r")], key=str)


def test_pipeline_keeps_one_of_near_copies(spark, tmp_path):
    """The rows of the whole pipeline, with all pairs of similarity 0.8 found by brute force."""
    rows, items = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = language.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), common.remainder("doc_id", 4) != 2)
    kept = [(r[0], r[1]) for r in rows if r[1] is not None and not model.predict(r[1])[2]]
    held = {}
    for i, t in kept:
        for line in t.split("\n"):
            held.setdefault(lowered(line.strip(BLANK)), set()).add(i)
    often = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    kept = [(i, "\n".join(x for x in t.split("\n") if often.get(lowered(x.strip(BLANK)), i) == i)) for i, t in kept]
    roots = slow_roots([t for _, t in kept])
    near = [(i, t) for n, (i, t) in enumerate(kept) if roots[n] == n]
    assert {201, 209} <= {i for i, _ in kept} - {i for i, _ in near}
    leaks = {r[0] for r in slow_leaks(near, items, 13, 2, 8) if r[1]}
    assert got == {i for i, _ in near} - leaks


def template_pages():
    """Pages that share most of their text: all pairs are just below the limit but for some pairs above it."""
    rng = random.Random(9)
    shared = ["t%d" % i for i in range(154)]
    rows = [shared + ["p%d_%d" % (i, rng.randrange(10 ** 9)) for _ in range(23)] for i in range(400)]
    for i in range(80):  # a partner that shares a third of the page's own words as well
        rows.append(rows[i][:162] + ["q%d_%d" % (i, rng.randrange(10 ** 9)) for _ in range(15)])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_pairs_on_one_template_are_found(spark):
    rows = template_pages()
    roots = slow_roots([t for _, t in rows])
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(roots)) and len(set(roots)) == 400


def test_small_buckets_go_by_pivots(spark):
    rows = corpus()
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), max_bucket=2).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(slow_roots([t for _, t in rows])))


def close_pairs(texts):
    """Pairs of texts whose sets have a similarity of 0.8 and fingerprints within two bits, told one by one."""
    sets = [set(s.tolist()) for s in copies.shingles([(t or "").encode() for t in texts], 5)]
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s)) for s in sets]
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and bin(prints[i] ^ prints[j]).count("1") <= 2
            and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}


def test_fingerprints_within_two_bits_share_a_key():
    texts = [t for _, t in corpus() if t and t.strip()]
    keys = [set(k) for k in copies.golay_of(copies.shingles([t.encode() for t in texts], 5), simhash.near_codewords(), simhash.syndromes())]
    near = close_pairs(texts)
    assert len(near) > 40 and all(keys[i] & keys[j] for i, j in near) and sum(map(len, keys)) < 18 * len(keys)


def test_copies_within_two_bits_are_found_without_bands(spark, monkeypatch):
    """What the minhash bands miss is found by the fingerprints' keys."""
    monkeypatch.setattr(copies, "BANDS", 0)
    rows = corpus()
    found = {r.doc_id: r.component_id for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    texts, roots = [t for _, t in rows], slow_roots([t for _, t in rows])
    near = close_pairs(texts)
    assert len(near) > 40 and all(found[i] == found[j] for i, j in near)
    assert all(roots[i] == roots[c] for i, c in found.items())


def test_bitmap_of_rows(spark):
    df = spark.range(0, 5000).select("id", F.xxhash64("id").alias("h"))
    bits = common.bit_table(df.filter("id % 10 = 0"), "h")
    inside = {r.id for r in common.may_be_in(df, bits, "h").collect()}
    outside = {r.id for r in common.may_be_in(df, bits, "h", inside=False).collect()}
    assert inside >= set(range(0, 5000, 10)) and len(inside) < 520 and inside | outside == set(range(5000)) and not inside & outside
    none = common.bit_table(df.filter("id < 0"), "h")
    assert common.may_be_in(df, none, "h").count() == 0 and common.may_be_in(df, none, "h", inside=False).count() == 5000
