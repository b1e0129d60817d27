"""Packing: the pieces are exact, the sequences gapless and few."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordlake.llm import packing


def check_sequences(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_documents(spark):
    rng = random.Random(1)
    words = ["the", "and", "ñandú", "Ünïcode", "x", "\n", "12"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 90, 400])))) for i in range(150)] + [(None, None), (7, ""), (7, "a"), (7, "a")]
    got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=64, with_ids=True, block_items=40).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        starts = [0, *range(len(ids) % 64 or 64, len(ids), 64)]
        for p, s in enumerate(starts):
            raw = np.array(ids[s:(starts + [len(ids)])[p + 1]], "<u4").tobytes()
            want.append((i, p, s, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    lengths = np.array([w[3] for w in want])
    together = packing.cost(lengths, packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 64), 64)[0]
    assert check_sequences(got, 64) <= together + 1


@pytest.mark.parametrize("lengths", [[1] * 500, [700] * 301, [1025] * 90 + [1023] * 90, "mixed"])
def test_few_sequences(spark, lengths):
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)] if lengths == "mixed" else lengths
    got = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid int, length long"), block_items=700).collect()
    assert sorted(r.uid for r in got) == list(range(len(lengths)))
    best = -(-len(lengths) // (2048 // lengths[0])) if len(set(lengths)) == 1 else -(-sum(lengths) // 2048)
    assert check_sequences(got, 2048) <= best * 1.003 + 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 1200, 300)
    a, b = (packing.best_fit(lengths, rng.permutation(300), 2048) for _ in range(2))
    for _ in range(20):
        child = packing.crossover(lengths, a, b, 2048, rng)
        fill = np.bincount(child, lengths)
        assert (child >= 0).all() and fill.max() <= 2048 and fill.sum() == lengths.sum()
        a, b = b, child
    start = packing.cost(lengths, packing.best_fit(lengths, rng.permutation(300), 2048), 2048)
    assert packing.cost(lengths, packing.evolve(lengths, [], 2048, 30, 4, 1)[0], 2048) < start


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
