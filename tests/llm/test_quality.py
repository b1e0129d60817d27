"""The rule ensemble: compiled rules equal the fitted ones, and held-out labels are predicted."""

import numpy as np
from pyspark.sql import functions as F

from recordlake.llm import common, quality

LARGE = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    fold = common.remainder("doc_id", 5)
    ensemble = quality.learn(docs, labels, fold != 0)
    assert 0 < len(ensemble.rules) < 150
    rows = quality.score(docs, ensemble).join(labels, "doc_id").filter(fold == 0).toPandas()
    y, p = rows["quality"].to_numpy(), rows["score"].to_numpy()
    assert auc(p, y) > 0.97 and (rows["predicted"] == y).mean() > 0.95
    # Labels of the held-out fold change nothing.
    spoilt = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(docs, spoilt, fold != 0) == ensemble


def test_compiled_rules_equal_fitted_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    described = quality.with_statistics(docs)
    x = described.toPandas()[list(quality.STATISTICS)].to_numpy()
    rng = np.random.default_rng(1)
    ensemble = quality.fit(x, (x[:, 7] + rng.normal(0, 0.02, len(x)) > 0.02).astype(float), trees=6)
    assert ensemble.rules
    compiled = described.select(ensemble.column().alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(compiled, ensemble.score(x))


def test_lasso_finds_the_one_rule_that_matters():
    rng = np.random.default_rng(2)
    a = (rng.random((2000, 12)) < 0.5).astype(float)
    y = (rng.random(2000) < np.where(a[:, 3] == 1, 0.9, 0.2)).astype(float)
    w, _ = quality.lasso(a, y, 0.03)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.05


def test_edges_of_the_input(spark):
    schema, labels = "doc_id long, text string, n_words int", "doc_id long, quality int"
    docs = spark.createDataFrame([(1, None, 0), (None, "", 1), (2, " \n ", 2), (2, "word " * 5000, 3), (2, "É!!", 4)], schema)
    for known in ([], [(1, 1), (1, None), (None, 0), (2, 7)]):
        ensemble = quality.learn(docs, spark.createDataFrame(known, labels), F.lit(True))
        got = quality.score(docs, ensemble).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(spark.createDataFrame([], schema), ensemble).count() == 0
