"""Winnowing against a window-by-window selection."""

import hashlib
import random

import numpy as np
import pytest

from recordlake.llm import winnow


def slow_select(text, k, window):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return []
    k = min(k, len(points))
    hashes = [int(winnow.gram_hashes(points[i:i + k], k)[0]) for i in range(len(points) - k + 1)]
    window, out = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        part = hashes[i:i + window]
        at = max(j for j in range(window) if part[j] == min(part)) + i
        if not out or out[-1] != (at, hashes[at]):
            out.append((at, hashes[at]))
    return out


@pytest.mark.parametrize("k,window,block", [(12, 32, 1 << 18), (5, 7, 64), (1, 1, 16), (8, 255, 100)])
def test_selection(monkeypatch, k, window, block):
    monkeypatch.setattr(winnow, "BLOCK", block)
    rng = random.Random(k)
    for n in (0, 1, 4, 5, 11, 12, 13, 60, 400, 1500):
        text = "".join(rng.choice("abÉ𝄞 ") for _ in range(n))
        places, hashes = winnow.select(text, k, window)
        assert list(zip(places.tolist(), hashes.tolist())) == slow_select(text, k, window)
        back = winnow.decode(winnow.encode(places, hashes))
        assert (back[0] == places).all() and (back[1] == hashes).all()


def test_shared_passages_share_a_hash():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = make(12 + 32 - 1)
        a, b = make(rng.randrange(200)) + passage + make(50), make(rng.randrange(200)) + passage + make(80)
        assert set(winnow.select(a, 12, 32)[1].tolist()) & set(winnow.select(b, 12, 32)[1].tolist())


def slow(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        sets = [set(h for _, h in slow_select(x, 12, 32)) for x in (t, edited, nxt)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
    return out


@pytest.mark.parametrize("parts", [1, 3, 8, 200])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = ["".join(rng.choice("abc dÉñ\n𝄞") for _ in range(rng.choice([0, 3, 30, 300, 900]))) for _ in range(60)]
    rows = [(rng.randrange(-50, 500) * 7, t) for t in texts]
    rows += [(None, "q" * 50), (None, None), (rows[3][0], rows[4][1]), rows[5], rows[5], (10**12, texts[2])]
    got = winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(slow(rows), key=key)
    plain = {(r.doc_id, r.fingerprint) for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}


def test_edges_of_the_input(spark):
    assert winnow.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = winnow.edited_fingerprints(spark.createDataFrame([(4, "abcdefgh", "x")], "doc_id long, text string, part string")).first()
    assert (one.doc_id, one.edited_sha256) == (4, hashlib.sha256(b"abcdefab").hexdigest()) and one.near_next == 1.0
