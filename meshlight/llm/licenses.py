"""License scans with a generalised suffix automaton of template words.

The automaton holds every stretch of consecutive words of all templates. A text is streamed through it
to obtain its matching statistics: at each word the length of the longest template stretch that ends
there. Stretches that cannot be extended and have at least ``MIN_MATCH`` words are placed in their
templates and chained, in the order of both text and template, into spans with at least one long
stretch. A span gives its template's label if it covers enough of the template and holds the words by which
licences of like wording differ; of spans that share words the one that covers more holds. Phrases are
found at every place where the matching statistics reach them in full.

Only words in sequence matter: words whose neighbours are neighbours in no template are passed over
without a step, as no stretch of ``MIN_MATCH`` words can contain them.

Null and empty texts have no words and no labels. Texts are read whole, whatever their length. Repeated
rows have repeated results; an empty table has no rows. Of spans that cover equally many words the one that covers
more of its template holds, then the earlier template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlight.llm import words as W
from meshlight.llm.batches import appended
from meshlight.llm.license_texts import NEEDS, PHRASES, TEMPLATES

MIN_MATCH = 3
MIN_LONG = 5  # words of a stretch that a chain must have
MAX_GAP = 12  # words between chained stretches, in the text and in the template
MIN_COVERAGE = 0.5
BESIDE = 6  # words after a span in which the words that a licence needs may stand

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Automaton:
    """Suffix automaton of several word sequences, with the places where each state ends."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((number, place))
        # A state ends wherever the states that link to it end.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]].extend(ends[state])
        self.ends = [sorted(set(e)) for e in ends]
        self.ends[0] = []

    def _state(self, length: int, follow: dict[int, int], link: int, ends: list) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append([])
        return len(self.next) - 1

    def _clone(self, state: int, word: int, old: int, ends: list) -> int:
        """Split off the stretches of ``old`` that ``state`` and its links reach by the word."""
        new = self._state(self.length[state] + 1, dict(self.next[old]), self.link[old], ends)
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:  # an earlier sequence has this stretch
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, word, old, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._clone(state, word, old, ends)
        return new

    def statistics(self, ids: Sequence[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest stretch that ends at each word."""
        state, length, out = 0, 0, []
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append((state, length))
        return out


class Scanner:
    """The automaton of a set of templates, and what is needed to run batches of texts through it."""

    def __init__(
        self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
        needs: dict[str, tuple[tuple[str, ...], ...]] = NEEDS,
    ):
        texts = [words_of(t) for _, t in [*phrases, *templates]]
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.phrases = len(phrases)
        asked = [words_of(p) for groups in needs.values() for group in groups for p in group]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*texts, *asked] for w in t))}
        sequences = [[vocabulary[w] for w in t] for t in texts]
        self.needs = {
            label: [[[vocabulary[w] for w in words_of(p)] for p in group] for group in groups] for label, groups in needs.items()
        }
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        # Phrases that a state's stretches can end with, its links' included: (phrase, its words).
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for state in sorted(range(1, len(self.ending)), key=lambda k: self.automaton.length[k]):
            own = {
                (number, self.sizes[number]) for number, place in self.automaton.ends[state]
                if number < self.phrases and place == self.sizes[number] - 1
                and self.automaton.length[self.automaton.link[state]] < self.sizes[number] <= self.automaton.length[state]
            }
            self.ending[state] = sorted(own.union(self.ending[self.automaton.link[state]]))
        size = len(vocabulary)
        self.follows = np.zeros((size + 1) * (size + 1), bool)  # the last id is any other word
        for s in sequences:
            for a, b in zip(s, s[1:]):
                self.follows[a * (size + 1) + b] = True
        self.unknown = size
        data = b" ".join(vocabulary)
        run = next(W.runs(pa.array([data.decode()])))
        starts, ends, _ = run.segments(SEPARATOR)
        hashes = run.hashes(starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.ids[place], self.unknown)

    def scan(self, run: W.Run) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
        """Words of each text; for texts with matches the phrases (number, start) and the spans."""
        starts, ends, doc = run.segments(SEPARATOR)
        n_words = W.counts_per(doc, run.n)
        found: dict[int, tuple[list, list]] = {}
        if len(starts) < MIN_MATCH:
            return n_words, found
        ids = self.ids_of(run.hashes(starts, ends))
        pairs = self.follows[ids[:-1] * (self.unknown + 1) + ids[1:]] & (doc[1:] == doc[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], pairs, [False]]).astype(np.int8)))
        begins, closes = edges[::2], edges[1::2] + 1  # words begins..closes-1 are neighbours in templates
        long = closes - begins >= MIN_MATCH
        first_word = np.cumsum(n_words) - n_words
        stretches: dict[int, list] = {}
        for begin, close in zip(begins[long].tolist(), closes[long].tolist()):
            text = int(doc[begin])
            offset = begin - int(first_word[text])
            statistics = self.automaton.statistics(ids[begin:close].tolist())
            phrases, _ = found.setdefault(text, ([], []))
            for i, (state, length) in enumerate(statistics):
                for number, size in self.ending[state]:
                    if size <= length:
                        phrases.append((number, offset + i - size + 1))
                extended = i + 1 < len(statistics) and statistics[i + 1][1] == length + 1
                if length >= MIN_MATCH and not extended:
                    for number, place in self.automaton.ends[state]:
                        if number >= self.phrases:
                            stretches.setdefault(text, []).append((number, offset + i - length + 1, place - length + 1, length))
        for text, matches in stretches.items():
            if max(m[3] for m in matches) >= MIN_LONG:
                own = ids[first_word[text] : first_word[text] + n_words[text]]
                found[text][1].extend(self.spans(matches, own))
        return n_words, {t: f for t, f in found.items() if f[0] or f[1]}

    def _told(self, label: str, words: list[int]) -> bool:
        """Whether the words hold what tells the licence from others."""
        def stands(phrase: list[int]) -> bool:
            size = len(phrase)
            return any(words[i : i + size] == phrase for i in range(len(words) - size + 1))

        return all(any(stands(p) for p in group) for group in self.needs.get(label, ()))

    def spans(self, matches: list[tuple[int, int, int, int]], words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coverage) of the best chains that cover enough."""
        out: list[tuple[int, int, int, int]] = []  # covered words, template, first, last
        by_template: dict[int, list] = {}
        for number, at, place, length in matches:
            by_template.setdefault(number, []).append((at, place, length))
        for number, blocks in sorted(by_template.items()):
            if max(b[2] for b in blocks) < MIN_LONG:
                continue
            blocks.sort()
            starts = [b[0] for b in blocks]
            reach = max(b[2] for b in blocks) + MAX_GAP
            covered, opened, long = [b[2] for b in blocks], [b[0] for b in blocks], [b[2] >= MIN_LONG for b in blocks]
            for k, (at, place, length) in enumerate(blocks):
                for j in range(bisect_left(starts, at - reach), k):
                    a, p, n = blocks[j]
                    gap, skip = at - (a + n), place - (p + n)
                    if -n < gap <= MAX_GAP and -n < skip <= MAX_GAP and at > a and place > p:
                        gain = covered[j] + length - max(0, -gap, -skip) - max(0, gap - max(0, skip))  # inserted words
                        if gain > covered[k]:
                            covered[k], opened[k], long[k] = gain, opened[j], long[j] or length >= MIN_LONG
            taken: list[tuple[int, int]] = []  # spans kept, in text order; they do not overlap
            for k in sorted((k for k in range(len(blocks)) if long[k]), key=lambda k: (-covered[k], blocks[k])):
                first, last = opened[k], blocks[k][0] + blocks[k][2] - 1
                if covered[k] < MIN_COVERAGE * self.sizes[number]:
                    break
                place = bisect_left(taken, (first, last))
                before_ends = taken[place - 1][1] if place else -1
                after_begins = taken[place][0] if place < len(taken) else last + 1
                if before_ends < first and last < after_begins:
                    taken.insert(place, (first, last))
                    if self._told(self.labels[number], words[first : last + 1 + BESIDE].tolist()):
                        out.append((min(covered[k], self.sizes[number]), number, first, last))
        # Templates share wording: of spans that share most of the shorter one the one that covers more words holds.
        held: list[tuple[int, int, int, float]] = []
        for n, number, first, last in sorted(out, key=lambda s: (-s[0], self.sizes[s[1]], s[1:])):
            if all(2 * (min(last, l) - max(first, f) + 1) <= min(last - first, l - f) + 1 for _, f, l, _ in held):
                held.append((number, first, last, n / self.sizes[number]))
        return sorted(held)


RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:bigint,last:bigint,coverage:double>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
_scanner: Scanner | None = None


def _scanned(texts: pa.Array) -> dict[str, pa.Array]:
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    s = _scanner
    n = len(texts)
    n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last = [None] * n, [None] * n
    base, labels, score, spans = [""] * n, [""] * n, np.zeros(n), [[]] * n
    for run in W.runs(texts, lower=True):
        counts, found = s.scan(run)
        n_words[run.first : run.first + run.n] = counts
        for text, (phrases, chains) in found.items():
            i = run.first + text
            n_base[i] = len(phrases)
            named = {s.labels[number] for number, _ in phrases}
            if phrases:
                first[i], last[i] = min(p for _, p in phrases), max(p for _, p in phrases)
                base[i] = ",".join(sorted(named))
                score[i] = 1.0
            labels[i] = ",".join(sorted(named | {s.labels[c[0]] for c in chains}))
            score[i] = max([score[i], *[c[3] for c in chains]])
            spans[i] = [{"label": s.labels[c[0]], "first": c[1], "last": c[2], "coverage": c[3]} for c in sorted(chains, key=lambda c: c[1:3])]
    return {
        "n_words": pa.array(n_words), "n_base": pa.array(n_base), "first_word": pa.array(first, pa.int64()),
        "last_word": pa.array(last, pa.int64()), "base_labels": pa.array(base), "labels": pa.array(labels),
        "score": pa.array(score), "spans": pa.array(spans, _SPANS),
    }


def scanned(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with words, phrase places, labels, score and template spans of each whole text.

    One pass without a shuffle. ``score`` is the largest coverage, 1 where a phrase stands. An input column
    with the name of a computed one is replaced.
    """
    return appended(df, text, RESULT, _scanned, keep)
