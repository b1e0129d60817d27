"""Quality scores from a sparse rule ensemble over text statistics.

1. Every text is described by statistics of all its bytes, words and lines.
2. On a bounded sample of labelled rows, small regression trees are boosted on the logistic loss, each on half of the rows. Every
   path from a root to a node is a rule: a conjunction of comparisons of statistics with constants.
3. A logistic regression with an L1 penalty weighs the rules (accelerated proximal gradient); most weights become zero. The penalty
   is the one that predicts a fifth of the sample, set aside, best.
4. The rules that keep a weight are compiled into one Spark column expression, so scoring is a projection over the statistics.

The sample has about ``max_rows`` labelled documents; everything else covers all rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pieces

STATISTICS = ("n_bytes", "n_words", "word_bytes", "longest_word", "upper", "digits", "marks", "symbols", "beyond_ascii", "blanks", "stops", "short_words",
              "distinct_words", "common_word", "words_with_symbols", "n_lines", "words_per_line", "repeated_lines", "short_lines")


def byte_classes() -> np.ndarray:
    """Of each byte: 0 other, 1 upper-case letter, 2 digit, 3 mark of punctuation, 4 symbol, 5 beyond ASCII, 6 blank, 7 end of a sentence."""
    kind = np.zeros(256, np.uint8)
    kind[ord("A"):ord("Z") + 1] = 1
    kind[ord("0"):ord("9") + 1] = 2
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
    kind[[ord(c) for c in "!\"'(),-:;?"]] = 3
    kind[128:] = 5
    kind[[9, 10, 11, 12, 13, 32]] = 6
    kind[ord(".")] = 7
    return kind


BYTE_CLASSES = byte_classes()


def statistics(text: bytes) -> tuple[float, ...]:
    """The values of STATISTICS for a text; shares are 0 where there is nothing to share."""
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, marks, symbols, beyond, blanks, stops = np.bincount(BYTE_CLASSES, histogram, 8)[1:] / max(1, n)
    words = text.split()
    k = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tails = sum(1 for w in words if w[-1:] in b"#$%&*!|+=<>~^" or w[:1] in b"#$%&*|+=<>~^")
    lines = [x.strip() for x in text.split(b"\n")]
    lines = [x for x in lines if x]
    m = max(1, len(lines))
    return (float(n), float(len(words)), float(sizes.mean()) if len(words) else 0.0, float(sizes.max(initial=0)), upper, digits, marks, symbols, beyond, blanks, stops,
            float((sizes <= 3).sum() / k), len(counts) / k, max(counts.values(), default=0) / k, tails / k, float(len(lines)), len(words) / m, 1 - len(set(lines)) / m if lines else 0.0,
            sum(len(x) < 20 for x in lines) / m)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATISTICS) for every row, over whole texts; a null text is an empty one."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches):
        for piece in pieces(batches):
            rows = np.array([statistics(t) for t in piece.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c) for c in rows.T)], ["doc_id", *STATISTICS])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


#: A comparison: statistic, limit, and whether the value lies above the limit.
Rule = tuple[tuple[int, float, bool], ...]


def grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule = ()) -> tuple[list[Rule], list[tuple[Rule, float]]]:
    """A regression tree by least squares: the paths to all its nodes, and the mean target at its leaves."""
    leaf = ([], [(path, float(target.mean()))])
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-9, None)
    total, n = target.sum(), len(target)
    for f, limits in enumerate(cuts):
        if not len(limits):
            continue
        slot = np.searchsorted(limits, x[:, f], side="left")  # values up to limits[i] lie in slots 0..i
        below = np.cumsum(np.bincount(slot, minlength=len(limits) + 1))[:-1]
        sums = np.cumsum(np.bincount(slot, target, minlength=len(limits) + 1))[:-1]
        fine = (below >= least) & (n - below >= least)
        gain = np.where(fine, sums ** 2 / np.maximum(below, 1) + (total - sums) ** 2 / np.maximum(n - below, 1) - total ** 2 / n, 0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (f, float(limits[i])))
    if best[1] is None:
        return leaf
    f, limit = best[1]
    rules, leaves = [], []
    for above in (False, True):
        side = (x[:, f] > limit) == above
        step = path + ((f, limit, above),)
        more, ends = grow(x[side], target[side], cuts, depth - 1, least, step)
        rules += [step, *more]
        leaves += ends
    return rules, leaves


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > limit) == above for f, limit, above in rule])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> list[Rule]:
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 48))) for c in x.T]
    z, found = np.full(len(x), 0.0), {}
    for _ in range(trees):
        part = rng.permutation(len(x))[: max(20, len(x) // 2)]
        rules, leaves = grow(x[part], (y - sigmoid(z))[part], cuts, depth, max(5, len(part) // 200))
        for r in rules:
            found.setdefault(tuple(sorted(r)), None)
        for r, value in leaves:
            z += 0.8 * value * (holds(r, x) if r else 1.0) * 4
    # Rules that hold for the same rows say the same.
    seen: dict[bytes, Rule] = {}
    for r in sorted(found, key=lambda r: (len(r), r)):
        seen.setdefault(np.packbits(holds(r, x)).tobytes(), r)
    return list(seen.values())


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty on the weights."""
    a1 = np.column_stack((a, np.ones(len(a))))
    step = 4 * len(a) / np.linalg.norm(a1, 2) ** 2
    w = v = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = v - step * (a1.T @ (sigmoid(a1 @ v) - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


class Ensemble(NamedTuple):
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(sum((w * holds(r, x) for r, w in self.rules), np.full(len(x), self.intercept)))

    def column(self) -> Column:
        """The score as an expression over the columns of STATISTICS."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [F.col(STATISTICS[f]) > limit if above else F.col(STATISTICS[f]) <= limit for f, limit, above in rule]
            z = z + F.when(reduce(lambda p, q: p & q, tests), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 5) -> Ensemble:
    """An ensemble of rows of statistics and their 0/1 labels; with fewer than two kinds of label it knows only their share."""
    if len(y) < 20 or len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, learn = order[: len(y) // 5], order[len(y) // 5:]
    rules = extract_rules(x[learn], y[learn], trees, depth, rng)
    a = np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))

    def loss(penalty: float) -> float:
        w, b = lasso(a[learn], y[learn], penalty, 150)
        p = np.clip(sigmoid(a[aside] @ w + b), 1e-9, 1 - 1e-9)
        return float(-(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean())

    best = min((0.03, 0.01, 0.003, 0.001), key=lambda p: (round(loss(p), 4), -p))
    w, b = lasso(a, y, best)
    return Ensemble([(r, float(v)) for r, v in zip(rules, w) if v], b)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 5000, **how) -> Ensemble:
    """An ensemble of the rows of ``labels(doc_id, quality)`` that are ``usable`` and whose document is in ``docs``.

    Labels that are null or neither 0 nor 1 are left out; several labels of one document all count.
    """
    known = labels.filter(usable & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n, grain = known.count(), 1 << 20
    # Chosen by a hash of the id, on both sides of the join, so that only chosen texts are read closely.
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("quality")), F.lit(grain)) < -(-grain * max_rows // max(1, n))
    described = with_statistics(docs.filter(chosen))
    rows = described.join(known.filter(chosen), "doc_id").limit(2 * max_rows).toPandas().sort_values(["doc_id", "quality", *STATISTICS])
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64), **how)


def score(docs: DataFrame, ensemble: Ensemble, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row, empty and null texts too; repeated rows get equal results."""
    return with_statistics(docs, id_col, text_col).select("doc_id", ensemble.column().alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))
