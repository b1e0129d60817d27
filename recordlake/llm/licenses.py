"""Licence scans with a generalised suffix automaton over the words of licence texts.

The automaton holds every run of words of the templates and phrases. A text is streamed through it once: after each word the state
stands for the longest run that ends there and occurs in some template (the matching statistics). A phrase ends at a word if its
state lies on the suffix path of the current one, so all places of the base phrases fall out of the same pass. Runs of at least
``min_match`` words that cannot be extended are chained per template, in the order of both texts and with gaps of up to ``max_gap``
words; a chain that covers at least ``min_cover`` of its template is a span and gives the text the template's label.

The automaton is built from the fixed list in ``license_texts`` and has under two states per word of it, so it travels with the job;
texts stay where they are and nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_AT_ONCE, arrow_schema, id_and_text, pieces, plain_words
from .license_texts import PHRASES, TEMPLATES

class Automaton:
    """Generalised suffix automaton of word sequences; ``phrases[s]`` and ``ends[s]`` say what ends in state ``s``."""

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[dict[int, int]] = [{}]  # state -> {template: last place where its longest run ends}
        for t, words in enumerate(templates + phrases):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), marks)
                if t < len(templates):
                    marks[last][t] = at
        # A run that ends at a place of a template lets all its suffixes end there.
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, at in marks[s].items():
                up = marks[self.link[s]]
                up[t] = max(at, up.get(t, -1))
        self.ends = [tuple(m.items()) for m in marks]
        self.phrases: list[tuple[int, ...]] = [()] * len(self.link)
        at_state = {}
        for p, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.next[s][self.vocabulary[w]]
            at_state.setdefault(s, []).append(p)
        self.phrase_lengths = [len(p) for p in phrases]
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases[s] = self.phrases[self.link[s]] + tuple(at_state.get(s, ()))

    def _extend(self, last: int, c: int, marks: list) -> int:
        def clone(p: int, q: int) -> int:
            new = len(self.link)
            self.next.append(dict(self.next[q]))
            self.link.append(self.link[q])
            self.length.append(self.length[p] + 1)
            marks.append({})
            self.link[q] = new
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = new
                p = self.link[p]
            return new

        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else clone(last, q)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        marks.append({})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else clone(p, q)
        return new

    def stream(self, words: list[bytes]):
        """Matching statistics at the words where they are not zero: (place, state, length)."""
        state = length = 0
        before, following, link, longest = -1, self.next, self.link, self.length
        for at in range(0, len(words), WORDS_AT_ONCE):
            for i, c in enumerate(map(self.vocabulary.get, words[at:at + WORDS_AT_ONCE]), at):
                if c is None:
                    continue
                if i != before + 1:
                    state = length = 0
                before = i
                while c not in following[state]:
                    state = link[state]  # every known word starts a run, so the root ends this
                    length = longest[state]
                state = following[state][c]
                length += 1
                yield i, state, length


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, min_match: int = 4, max_gap: int = 8, min_cover: float = 0.8):
        self.phrase_labels = list(phrases.values())
        self.labels = [label for label, _ in templates]
        words = [plain_words(t.encode()) for _, t in templates]
        self.sizes = [len(w) for w in words]
        self.automaton = Automaton(words, [plain_words(p.encode()) for p in phrases])
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def scan(self, text: bytes) -> dict:
        """Word count, places of the phrases, and the spans (label, first word, last word, share of the template covered)."""
        words, a = plain_words(text), self.automaton
        n_base, first, last, base = 0, None, None, set()
        chains: dict[int, list[int]] = {}  # template: first word, last word, last template place, words covered
        spans = []

        def close(t: int) -> None:
            start, end, _, covered = chains.pop(t)
            if covered >= self.min_cover * self.sizes[t]:
                spans.append((self.labels[t], start, end, covered / self.sizes[t]))

        def matched(i: int, state: int, length: int) -> None:
            for t, at in a.ends[state]:
                start, held = i - length + 1, chains.get(t)
                fresh = length
                if held is not None:
                    # Overlaps with what the chain covers count once.
                    over = max(0, held[1] - start + 1, held[2] - (at - length))
                    if at > held[2] and over < length and start - held[1] <= self.max_gap + 1:
                        fresh = length - over
                        chains[t] = [held[0], i, at, held[3] + fresh]
                        continue
                    # A longer run that starts anew replaces a shorter chain over the same words.
                    if at <= held[2] and start <= held[1] and length <= held[3]:
                        continue
                    close(t)
                chains[t] = [start, i, at, fresh]

        before = (-2, 0, 0)
        for i, state, length in a.stream(words):
            if before[2] >= self.min_match and (before[0] != i - 1 or length != before[2] + 1):
                matched(*before)
            before = (i, state, length)
            for p in a.phrases[state]:
                if a.phrase_lengths[p] <= length:
                    at = i - a.phrase_lengths[p] + 1
                    n_base += 1
                    first = at if first is None else min(first, at)
                    last = at if last is None else max(last, at)
                    base.add(self.phrase_labels[p])
        if before[2] >= self.min_match:
            matched(*before)
        for t in list(chains):
            close(t)
        spans.sort()
        return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base": base, "spans": spans}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>")


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans every row. Returns the counts and places of the base phrases, the labels and the spans covered by templates.

    The score is the largest share of a template that a span covers, 1 where a base phrase stands, and 0 without either. A null or
    empty text has no words, null places, empty labels and score 0. Repeated rows and null ids stay rows of their own; other columns
    are not read; an empty table gives an empty one.
    """
    scanner = scanner or Scanner()
    fields = arrow_schema(SCHEMA)

    def run(batches):
        for piece in pieces(batches):
            rows = []
            for text in piece.column("text").to_pylist():
                r = scanner.scan(text)
                labels = r["base"] | {s[0] for s in r["spans"]}
                score = 1.0 if r["n_base"] else max((s[3] for s in r["spans"]), default=0.0)
                rows.append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(sorted(r["base"])), ",".join(sorted(labels)), min(1.0, score),
                             [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in r["spans"]]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), fields[1:]))], [f.name for f in fields])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
