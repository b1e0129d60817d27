import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordlake.llm import importance

SCHEMA = "doc_id long, text string"


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_features(text):
    w = slow_words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def slow(rows, items, percent=5, min_words=20):
    s = Counter(b for _, t in rows for b in slow_features(t))
    t = Counter(b for x in items for b in slow_features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        f = slow_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(slow_words(text)) >= min_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = percent * len(able) // 100
    ranks = Counter((r[:4], k + 1) for k, r in enumerate(able[:n]))
    return out, ranks, n


def corpus():
    names = "alpha Beta gamma delta été 北京 x1 y-2 z_3 don't omega".split()
    rows = [(i, " ".join(names[(i * k + k * k) % len(names)] for k in range(i % 60))) for i in range(400)]
    rows += [(1000 + i, "the same text for a third of all rows " * 4) for i in range(200)]
    rows += [(None, "the same text for a third of all rows " * 4)] * 5 + [(7, rows[7][1])] * 3 + [(2000, None), (2001, ""), (2002, "...\n\t"), (2003, "Alpha beta " * 30000)]
    return rows, ["alpha beta gamma", "the same text", None, "", "x1 y 2 z 3"]


@pytest.mark.parametrize("percent,sorting", [(5, {}), (60, {"segment_rows": 2, "least_gap": 1}), (100, {"segment_rows": 4, "least_gap": 3, "max_runs": 2}), (5, {"segment_rows": 4, "least_gap": 5})])
def test_equals_brute_force(spark, percent, sorting):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("RANK", F.lit(1)).withColumn("row", F.lit(2))
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in items], "text string"), percent=percent, **sorting).collect()
    want, ranks, n = slow(rows, items, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in want)
    assert Counter(((r.doc_id, r.n_features, r.weight, r.score), r["rank"]) for r in got if r["rank"]) == ranks and sum(ranks.values()) == n


def test_blocks_of_a_long_text(spark, monkeypatch):
    text = "One two,three  FOUR five-six éa 七 " * 50
    whole = list(importance.features(text.encode()))
    monkeypatch.setattr(importance, "BLOCK_BYTES", 9)
    cut = list(importance.features(text.encode()))
    assert len(whole) == 1 and len(cut) > 100 and sum(n for n, _ in cut) == whole[0][0] == len(slow_words(text))
    assert Counter(b for _, x in cut for b in x.tolist()) == Counter(whole[0][1].tolist()) == Counter(slow_features(text))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b " * 20), (2, "c")], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, docs).collect() == []
    got = {r.doc_id: r["rank"] for r in importance.resample(docs, none, percent=100).collect()}
    assert got == {1: 1, 2: None}


def test_drawn_documents_keep_their_columns(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, f"s{k}") for k, r in enumerate(rows)], SCHEMA + ", _id string")
    found = importance.resample(docs, spark.createDataFrame([(x,) for x in items], "text string"))
    drawn = importance.drawn_documents(docs.withColumnRenamed("_id", "extra"), found)
    assert drawn.columns == ["doc_id", "text", "extra"]
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in found.filter("rank IS NOT NULL").collect()}
