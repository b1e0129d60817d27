"""The licence automaton against plain searches."""

import random
import re

from recordlake.llm import licenses
from recordlake.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def contains(words, run):
    return [i for i in range(len(words) - len(run) + 1) if words[i:i + len(run)] == run]


def random_text(rng):
    bits = []
    for _ in range(rng.randrange(40)):
        kind = rng.randrange(6)
        t = rng.choice(TEMPLATES)[1].split()
        a = rng.randrange(len(t))
        bits.append([rng.choice(list(PHRASES)).upper(), " ".join(t[a:a + rng.randrange(12)]), "the", "General", "Ünïcode1 \x1cx", rng.choice([".", "\n", "-", "\x00"])][kind])
    return " ".join(bits)


def test_matching_statistics():
    rng = random.Random(5)
    templates = [[w.encode() for w in rng.choices("abc", k=rng.randrange(1, 14))] for _ in range(6)]
    phrases = [[b"a", b"b"], [b"c"]]
    machine = licenses.Automaton(templates, phrases)
    assert len(machine.link) < 2 * sum(map(len, templates + phrases))
    runs = {tuple(t[i:j]) for t in templates + phrases for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(30):
        words = [w.encode() for w in rng.choices("abcd", k=60)]
        got = {i: (s, n) for i, s, n in machine.stream(words)}
        for i in range(len(words)):
            want = max((n for n in range(1, i + 2) if tuple(words[i - n + 1:i + 1]) in runs), default=0)
            assert got.get(i, (0, 0))[1] == want
            if want:
                run = words[i - want + 1:i + 1]
                for t, at in machine.ends[got[i][0]]:
                    assert templates[t][at - want + 1:at + 1] == run
                assert {t for t, _ in machine.ends[got[i][0]]} == {t for t, x in enumerate(templates) if contains(x, run)}
                ended = {p for p in machine.phrases[got[i][0]] if len(phrases[p]) <= want}
                assert ended == {p for p, x in enumerate(phrases) if words[max(0, i - len(x) + 1):i + 1] == x}


def test_base_places_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, random_text(rng)) for i in range(120)] + [(120, None), (121, ""), (None, "MIT License"), (5, "the mit-license! mit mit license"), (5, "x")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        words = WORD.findall(lowered(t or ""))
        at = {p: contains(words, p.split()) for p in PHRASES}
        places = sorted(x for v in at.values() for x in v)
        want.add((i, len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({PHRASES[p] for p, v in at.items() if v}))))
    assert got == want and sum(w[2] for w in want) > 50


def test_templates_are_found_whole_and_with_gaps(spark):
    scanner = licenses.Scanner()
    filler = " zzz" * 30
    for label, text in TEMPLATES:
        spans = scanner.scan((filler + " " + text + filler).encode())["spans"]
        n = len(WORD.findall(text))
        assert (label, 30, 29 + n, 1.0) in spans, (label, spans)
        words = text.split()
        if len(words) > 20:
            words[9] = "changed"
            assert any(s[0] == label and 0.8 <= s[3] < 1 for s in scanner.scan((filler + " " + " ".join(words)).encode())["spans"])
            assert not any(s[0] == label for s in scanner.scan((filler + " " + " ".join(words[:len(words) // 3])).encode())["spans"] if s[3] < 0.8)
    r = licenses.scan(spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", 0.5)], "doc_id long, text string, score double")).first()
    assert (r.labels, r.base_labels, r.score) == ("cc-by-nc", "", 1.0)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
