"""Line de-duplication against a plain dictionary."""

import hashlib
import random
from collections import defaultdict

from recordlake.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def slow(rows, min_chars, min_docs):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lowered(line.strip(BLANK))
            if len(k) >= min_chars:
                held[k].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(held[lowered(x.strip(BLANK))]) < min_docs or i == max(held[lowered(x.strip(BLANK))], key=lambda v: -1 if v is None else v)]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["L%d " % i + "xyzÄé "[: rng.randrange(7)] * 9 for i in range(30)] + ["short", "", "  ", "É" * 41, "é" * 41, "A" * 39, "\x1c" + "b" * 45]
    rows = []
    for i in range(80):
        n = rng.choice([0, 1, 5, 150])
        rows.append((i, "\n".join(rng.choice(["", "\t", " \r"]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", " ", "\x0b"]) for _ in range(n))))
    rows += [(80, None), (None, rows[7][1]), (3, rows[9][1]), (5, rows[5][1]), (81, pool[3] + "\n" + pool[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for a, b in ((40, 5), (3, 2)):
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_digest(docs, a, b).collect()), key=str)
        assert got == slow(rows, a, b)
        assert sum(r[2] for r in got) > 100


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_digest(empty).count() == 0
    odd = spark.createDataFrame([(i, "\n".join(["x" * 50, "own %d" % i]), 1, "h1") for i in range(6)] + [(9, None, 0, "z")],
                                "doc_id long, text string, n_chars int, lines_doc string")
    got = lines.without_repeated_lines(odd)
    assert got.columns == odd.columns and got.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(i, "own %d" % i, 5) for i in range(5)] + [(5, "x" * 50 + "\nown 5", 56), (9, "", 0)]
