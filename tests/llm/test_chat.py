import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recordlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARK = r"\[/?INST\]|</?s>|\[/?TURN\]|\[SEP\]"


def slow_read(text):
    """(turns, texts under the mask) of a formatted text, read by a plain scanner."""
    marks = [m for m in re.finditer(rf"(?<!\\)(?:{MARK})", text)]
    turns, spans, i = [], [], 0

    def body(a, b):
        piece = text[marks[a].end():marks[b].start()]
        assert piece.startswith(" ") and piece.endswith(" ") and len(piece) >= 2
        return piece[1:-1]

    def plain(x):
        return re.sub(rf"\\({MARK})", r"\1", x)

    assert not marks or marks[0].start() == 0
    while i < len(marks):
        kind = marks[i][0]
        if kind == "[TURN]":
            assert marks[i + 1][0] == "[SEP]" and marks[i + 2][0] == "[/TURN]"
            turns.append((plain(body(i, i + 1)), plain(body(i + 1, i + 2))))
            i += 3
        else:
            assert marks[i + 1][0] == {"[INST]": "[/INST]", "<s>": "</s>"}[kind]
            turns.append(({"[INST]": "user", "<s>": "assistant"}[kind], plain(body(i, i + 1))))
            if kind == "<s>":
                spans.append((marks[i].end() + 1, marks[i + 1].start() - marks[i].end() - 2))
            i += 2
        assert marks[i - 1].end() == (marks[i].start() if i < len(marks) else len(text))
    return turns, spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hostile():
    rng = random.Random(3)
    bits = [*chat.MARKS, "\\", "\\\\", " ", "\n", "a", "é", "𝒳", "$1", "[", "]", "<", "/", "INST]", "s>", "[/", "", "user", "assistant"]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "User", "[SEP]", "</s> \\"])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])))
    return rows


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(turns, key=lambda v: v[0])] for c, turns in by.items()}


@pytest.mark.parametrize("part_turns", [512, 3])
def test_round_trip_of_hostile_texts(spark, part_turns):
    rows = hostile()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("FORMATTED", F.lit(1)).repartition(5)
    texts = chat.formatted(table, part_turns)
    got = {}
    for r in sorted(texts.collect(), key=lambda r: r.part):
        turns, spans = slow_read(r.formatted)
        assert len(turns) <= part_turns and [(s.start, s.length) for s in r.loss_spans] == spans
        assert r.escaped == any(re.search(MARK, x) for turn in turns for x in turn)
        got.setdefault(r.conv_id, []).extend(turns)
    want = expected(rows)
    assert got == want
    for r in chat.digest(texts).collect():
        turns = want[r.conv_id]
        learnt = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))


def test_parser_refuses_what_the_grammar_does_not_allow(spark):
    texts = ["", "x", "[INST] a [/INST]x", "[INST] a </s>", "[INST] a", "[INST]a [/INST]", "[INST] [/INST]", "<s> a <s> b </s>", "[TURN] r [/TURN]", "[/INST]", " [INST] a [/INST]",
             r"\[INST] a [/INST]", "[TURN] a [SEP] b [SEP] c [/TURN]", r"[INST] a \[/INST]"]
    good = {r"[INST] \[/INST] [/INST]": [("user", "[/INST]")], "[INST]  [/INST]<s> b\\ </s>": [("user", ""), ("assistant", "b\\")], r"[TURN] \\<s> [SEP] x [/TURN]": [("\\<s>", "x")]}
    rows = spark.createDataFrame([(t,) for t in [*texts, *good]], "t string").select("t", chat.parsed(F.col("t")).alias("turns")).collect()
    assert {r.t: r.turns and [tuple(t) for t in r.turns] for r in rows} == {t: None for t in texts} | good


def test_hot_conversation_is_split_and_ids_may_be_missing(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i} </s>") for i in range(2000)] + [(2, 0, "user", "q")] + [(None, 0, "assistant", f"n{i}") for i in range(300)]
    rows += [(3, 5, "user", "same")] * 40 + [(4, None, "user", "b"), (4, 1, "user", "c")]
    texts = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(6), 16)
    parts = texts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("parts").alias("parts"), F.max(F.size("loss_spans")).alias("most")).collect()
    by = {r.conv_id: r for r in parts}
    assert by[1].n == by[1].parts == 125 and by[1].most == 8 and by[3].n == 3 and by[2].n == 1 and by[None].n == 300
    got = [r for r in chat.digest(texts).collect()]
    one = next(r for r in got if r.conv_id == 1)
    assert one.n_turns == 2000 and one.loss_sha256 == sha("".join(f"t{i} </s>" for i in range(0, 2000, 2)))
    assert sum(r.conv_id is None and r.n_turns == 1 for r in got) == 300
    read = chat.turns_of(texts.filter("conv_id = 4")).orderBy("place").collect()
    assert [r.text for r in read] == ["b", "c"]


def test_long_text_and_empty_table(spark):
    long = ("word </s> \\[INST] " * 60_000) + "\\" * 5000
    got = chat.digest(chat.formatted(spark.createDataFrame([(1, 0, "assistant", long)], SCHEMA))).collect()
    assert got[0].loss_sha256 == sha(long) and got[0].loss_chars == len(long) and got[0].formatted_chars == len(long) + 120_000 + 9
    assert chat.digest(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []


def test_no_python_on_the_main_path(spark):
    df = chat.digest(chat.formatted(chat.with_mark_texts(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1)))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
