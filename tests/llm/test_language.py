"""Language identification: held-out accuracy, calibration, and whole texts."""

import numpy as np
from pyspark.sql import functions as F

from recordlake.llm import common, language

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    model = language.learn(docs, common.remainder("doc_id", 4) != 2)
    joined = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(common.remainder("doc_id", 4) == 2).collect()
    right = [r.lang_pred == r.lang for r in joined]
    assert len(right) > 200 and np.mean(right) > 0.97
    assert np.mean([r.rejected for r in joined]) < 0.02
    # Probabilities are honest: on average they say how often the label is right.
    assert abs(np.mean([r.score for r in joined]) - np.mean(right)) < 0.05


def test_labels_of_the_held_out_rows_are_never_read(spark):
    docs = spark.read.parquet(SMALL)
    held = common.remainder("doc_id", 4) == 2
    spoilt = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.learn(docs, ~held), language.learn(spoilt, ~held)
    assert a.labels == b.labels and (a.scores == b.scores).all() and a.limit == b.limit


def test_blocks_do_not_change_the_runs(monkeypatch):
    text = "Ünï cödé, words and more words; 12 times\n" * 50
    whole = np.sort(np.concatenate([*language.subwords(text, 1 << 16)]))
    monkeypatch.setattr(language, "RUNS_AT_ONCE", 37)
    assert (np.sort(np.concatenate([*language.subwords(text, 1 << 16)])) == whole).all()


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(None, None, None, None), (1, "123 !!", "en", 1), (2, "", None, 2), (3, "the", None, 3)]
    docs = spark.createDataFrame(rows, schema)
    model = language.learn(docs, F.lit(True))
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == "und" for r in got) == 3 and {r.lang_pred for r in got} == {"und", "en", "de"}
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 60
    empty = spark.createDataFrame([], schema)
    nothing = language.learn(empty, F.lit(True))
    assert language.predict(empty, nothing).count() == 0 and language.predict(docs, nothing).filter("lang_pred <> 'und'").count() == 0
