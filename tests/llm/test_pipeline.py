"""The pipeline's rows against the brute-force versions of its stages, one after the other."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from recordlake.llm import common, language

from .test_decontaminate import slow as slow_leaks
from .test_lines import BLANK, lowered
from .test_packing import check_sequences
from .slow import slow_roots


def fixture():
    rng = random.Random(8)
    vocabulary = {"en": ["the", "and", "house", "river", "with", "stone", "walking"], "de": ["der", "und", "haus", "fluss", "mit", "stein", "gehend"]}
    sentence = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))
    shared = [sentence("en", 12) for _ in range(4)]
    items = [(i, sentence(rng.choice(["en", "de"]), 25)) for i in range(5)]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        parts = [sentence(lang, rng.randrange(20, 90)) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 1:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if i % 15 == 2:
            parts.append(rng.choice(items)[1])
        rows.append((i, "\n".join(parts), lang, "s", 1))
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 1) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "12 34 !!", None, "s", 8), (302, "", "en", "s", 0), (303, shared[0], "en", "s", 1)]
    return rows, items


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.learn(docs, common.remainder("doc_id", 4) != 2)
    kept = [(r[0], r[1]) for r in rows if r[1] is not None and not model.predict(r[1])[2]]
    assert len(kept) > 150 and not {300, 301, 302} & {i for i, _ in kept}
    held = {}
    for i, t in kept:
        for line in t.split("\n"):
            held.setdefault(lowered(line.strip(BLANK)), set()).add(i)
    often = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    assert len(often) >= 4
    kept = [(i, "\n".join(x for x in t.split("\n") if often.get(lowered(x.strip(BLANK)), i) == i)) for i, t in kept]
    roots = slow_roots([t for _, t in kept])  # near copies: five-word shingles, similarity 0.8
    kept = [(i, t) for n, (i, t) in enumerate(kept) if roots[n] == n]
    leaks = {r[0] for r in slow_leaks(kept, items, 13, 2, 8) if r[1]}
    kept = [(i, t) for i, t in kept if i not in leaks]
    assert len(leaks) >= 5 and len(kept) > 100

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*slow.encode(t, add_special_tokens=False).ids, 0] for i, t in kept}
    assert {r.doc_id for r in got} == set(want) and sum(r.length for r in got) == sum(map(len, want.values()))
    assert check_sequences(got, 2048) <= -(-sum(map(len, want.values())) // 2048) + 1


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(fixture()[0], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs_after = stage(spark, docs, None)
        assert docs_after.dtypes == docs.dtypes
        empty = stage(spark, docs.filter("doc_id < 0"), None)
        assert empty.count() == 0
