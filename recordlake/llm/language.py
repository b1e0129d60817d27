"""Language of a text by averaged hashed subword embeddings, with calibrated rejection.

A text's features are the runs of 3 and 4 bytes of its lower-cased letters, with one space for whatever lies between words. Each run
is hashed to a row of an embedding table; the mean row goes through a linear softmax. Table and softmax are learnt in numpy by
stochastic gradient descent with linearly falling steps. Afterwards both collapse into one score per run and language, so a
prediction is a mean of looked-up scores over the whole text.

Learning uses a bounded sample: about ``max_docs`` labelled rows, as many of each language, and of each row up to ``spots`` passages
of ``spot_chars`` characters spread evenly over the text. One part in five is set aside to calibrate: a temperature makes the
probabilities honest, and the rejection limit is set so that at most a share ``max_lost`` of the correctly named texts falls below it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pieces

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters become spaces.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SPACES = regex.compile(rb" {2,}")
#: Runs looked up at once.
RUNS_AT_ONCE = 1 << 18


class Model(NamedTuple):
    labels: list[str]
    scores: np.ndarray  # one row per hashed run, one column per label, and the temperature already in it
    bias: np.ndarray
    limit: float

    def probabilities(self, text: str) -> np.ndarray:
        """Of each label, for a text with a letter."""
        total, n = np.zeros(len(self.labels)), 0
        for runs in subwords(text, len(self.scores)):
            total += self.scores[runs].sum(axis=0)
            n += len(runs)
        z = total / max(n, 1) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(label, probability, rejected)."""
        if not self.labels or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.limit)


def subwords(text: str, buckets: int):
    """Hashed runs of 3 and 4 bytes, block by block."""
    data = b" " + SPACES.sub(b" ", text.lower().encode().translate(LETTERS).strip()) + b" "
    for at in range(0, len(data), RUNS_AT_ONCE):
        b = np.frombuffer(data[at:at + RUNS_AT_ONCE + 3], np.uint8).astype(np.uint32)
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        four = three[:-1] | b[3:] << 24
        last = at + RUNS_AT_ONCE >= len(data)
        three = three if last else three[:RUNS_AT_ONCE]
        for grams, odd in ((three, 0x9E3779B1), (four, 0x85EBCA77)):
            h = grams * np.uint32(odd)
            yield (h ^ h >> np.uint32(15)) & np.uint32(buckets - 1)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dims: int = 16, epochs: int = 6, rate: float = 0.5, max_lost: float = 0.001, seed: int = 7) -> Model:
    """Learns from texts and their languages; without texts the model knows no language and rejects everything."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    table, out, bias = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)), np.zeros((dims, len(labels))), np.zeros(len(labels))
    cases = []
    for text, lang in zip(texts, langs):
        runs = [*subwords(text, buckets)]
        found, counts = np.unique(np.concatenate(runs), return_counts=True)
        if len(found):
            cases.append((found, counts / counts.sum(), labels.index(lang)))
    order = rng.permutation(len(cases))
    aside = [cases[i] for i in order[: len(cases) // 5]] if len(cases) >= 10 else cases
    learn = [cases[i] for i in order[len(cases) // 5:]] if len(cases) >= 10 else cases
    step, steps = 0, epochs * max(1, len(learn))
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            found, share, y = learn[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ table[found]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            table[found] -= lr * len(found) ** 0.5 * share[:, None] * back
    flat = table @ out
    logits = np.array([share @ flat[found] + bias for found, share, _ in aside]).reshape(len(aside), len(labels))
    truth = np.array([y for *_, y in aside], int)

    def soft(t: float) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(soft(t)[np.arange(len(truth)), truth] + 1e-9).sum())
    p = soft(best)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    limit = float(min(0.5, right[int(max_lost * len(right))])) if len(right) else 0.0
    return Model(labels, (flat / best).astype(np.float32), bias / best, limit)


def learn(docs: DataFrame, usable: Column, max_docs: int = 3000, spots: int = 6, spot_chars: int = 240, **how) -> Model:
    """A model of the rows of ``docs(doc_id, text, lang)`` that are ``usable`` and have text and lang."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.select(F.col("lang").cast("string").alias("lang")).groupBy("lang").count().collect()}
    if not sizes:
        return train([], [], **how)
    each = max(1, max_docs // len(sizes))
    # Rows are chosen by a hash of their id, the same ones however the table is dealt out.
    grain = 1 << 20
    limit = F.coalesce(*[F.when(F.col("lang").cast("string") == k, F.lit(min(grain, -(-grain * each // n)))) for k, n in sizes.items()])
    length = F.char_length("text")
    whole = F.lit(spots * spot_chars)
    passages = F.when(length <= whole, F.array("text")).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(spots - 1)), lambda i: F.substring(F.col("text"), (F.lit(1) + F.floor((length - spot_chars) * i / max(1, spots - 1))).cast("int"), F.lit(spot_chars))))
    rows = (known.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(grain)) < limit).select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), passages.alias("p"))
            .limit(2 * max_docs).collect())
    texts, langs = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        # Whole passages, and the first words of one, so that short texts are known too.
        short = " ".join(r["p"][-1].split()[:1 + r["h"] % 8])
        for t in (" ".join(r["p"]), short):
            if LETTER.search(t):
                texts.append(t)
                langs.append(r["lang"])
    return train(texts, langs, **how)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, over whole texts.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Repeated rows get equal results; an empty table gives
    an empty one. The model has a fixed size and travels with the job.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in pieces(batches):
            found = [shared.value.predict(t.decode()) for t in piece.column("text").to_pylist()]
            lang, score, rejected = zip(*found)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = docs.columns, docs.schema
    text = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            keep = pa.array([t is not None and not shared.value.predict(t)[2] for t in texts], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, schema)
