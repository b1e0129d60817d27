"""Token counts against the tokenizers library, and the histogram against plain sums."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from recordlake.llm import tokens

SOME = ["a", "The ", "don't", " 12", "É", "\n", "\t", "  ", "\x1c", "\x85", " ", "　", "​", "𝄞", "漢字", "٣", "²", "'LL", "'s", "!!", "<|endoftext|>", "<|end", "\r\n", "é", "ñ"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SOME) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_those_of_tokenizers():
    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.encoder()
    for t in [*texts(2000, 1), "x" * 5000, ""]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_histogram_equals_plain_sums(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 2))] + [(None, None), (3, ""), (3, "a b"), (3, "a b")]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = sorted(len(slow.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    counts = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.length for r in counts.collect()) == n
    made = tokens.length_histogram(counts, chunk=7)
    got = {r.length: r for r in made.collect()}
    assert sorted(got) == sorted(set(n))
    for x, r in got.items():
        assert (r.docs, r.tokens, r.docs_from, r.docs_to) == (n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y <= x for y in n))
        assert (r.tokens_from, r.truncated_tokens, r.all_docs, r.all_tokens) == (sum(y for y in n if y >= x), sum(min(x, y) for y in n), len(n), sum(n))
    assert tokens.truncated_total(made, 13).first()[0] == sum(min(13, y) for y in n)
    assert tokens.quantile(made, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]
    assert tokens.length_histogram(tokens.token_counts(spark.createDataFrame([], "doc_id long, text string, length int"))).count() == 0
