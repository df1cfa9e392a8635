"""Quality rules as weak supervision.

Every rule votes for a document (1), against it (-1) or abstains (0). A generative model with the
accuracies of each rule and the share of good documents is fitted by expectation-maximisation to the votes
of the whole table; a document's posterior probability of being good replaces the demand that it
pass every rule. The model is fitted on the counts of distinct vote patterns, of which there are at
most 3 to the power of the number of rules, however large the table is.

Nulls and empty texts have no words; they fail the base rules. A rule that cannot be judged on a
text abstains. Equal texts get equal results, and an empty table fits the prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.llm import words as W
from meshlight.llm.batches import appended

SIGNALS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_letter_words bigint, n_window_words bigint, n_window_distinct bigint, n_symbol_words bigint"
)
WINDOW = 200  # words in which different ones are counted; a shorter text is one window
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks every key that occurs twice or more."""
    marks = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        marks[order[1:]] |= same
        marks[order[:-1]] |= same
    return marks


def _distinct(keys: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each document; keys differ between documents."""
    _, first = np.unique(keys, return_index=True)
    return W.counts_per(documents[first], n)


def _windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all windows of each document: the word's number, its window's number, its document.

    Windows of ``WINDOW`` words stand side by side; the last one ends with the document, so that it may
    share words with the one before.
    """
    n_windows = -(-n_words // WINDOW)
    document = np.repeat(np.arange(len(n_words)), n_windows)
    place = np.arange(len(document)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    size = np.minimum(n_words[document], WINDOW)
    begin = np.minimum(place * WINDOW, n_words[document] - size) + (np.cumsum(n_words) - n_words)[document]
    window = np.repeat(np.arange(len(document)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return begin[window] + inside, window, document[window]


def _signals(texts) -> dict[str, np.ndarray]:
    names = [f.split()[0] for f in SIGNALS.split(", ")]
    out = {name: np.zeros(len(texts), np.int64) for name in names}
    for run in W.runs(texts):
        rows = slice(run.first, run.first + run.n)
        starts, ends, doc = run.segments(W.SPACE)
        hashes = run.hashes(starts, ends)
        salt = W.mix(np.arange(run.n, dtype=np.uint64))
        out["n_words"][rows] = W.counts_per(doc, run.n)
        out["word_chars"][rows] = run.per_document(~W.SPACE[run.data] & ((run.data & 0xC0) != 0x80))
        out["n_symbols"][rows] = run.per_document(_SYMBOL[run.data])

        letters = np.zeros(len(run.data) + 1, np.int64)
        np.cumsum(_LETTER[run.data], out=letters[1:])
        in_word = letters[ends] - letters[starts]
        out["n_letter_words"][rows] = W.counts_per(doc[in_word > 0], run.n)
        marked = np.zeros(len(run.data) + 1, np.int64)
        np.cumsum(_SYMBOL[run.data], out=marked[1:])
        out["n_symbol_words"][rows] = W.counts_per(doc[marked[ends] > marked[starts]], run.n)
        windowed, window, of = _windows(W.counts_per(doc, run.n))
        out["n_window_words"][rows] = W.counts_per(of, run.n)
        keys = W.joined(hashes[windowed], W.mix(window.astype(np.uint64)))
        out["n_window_distinct"][rows] = _distinct(keys, of, run.n)

        whole = np.flatnonzero(doc[2:] == doc[:-2])  # first words of the windows within one document
        windows = W.joined(W.joined(hashes[whole], hashes[whole + 1]), hashes[whole + 2])
        again = whole[_repeated(W.joined(windows, salt[doc[whole]]))]
        covered = np.zeros(len(doc), bool)
        for step in range(3):
            covered[again + step] = True
        out["n_repeat_words"][rows] = W.counts_per(doc[covered], run.n)

        begins, closes, line_doc = run.segments(_NEWLINE)
        worded = np.searchsorted(starts, closes) > np.searchsorted(starts, begins)
        begins, closes, line_doc = begins[worded], closes[worded], line_doc[worded]
        lines = W.counts_per(line_doc, run.n)
        out["n_lines"][rows] = lines
        keys = W.joined(run.hashes(begins, closes), salt[line_doc])
        out["n_dup_lines"][rows] = lines - _distinct(keys, line_doc, run.n)
    return out


def signals(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts over each whole text, in one pass and without a shuffle.

    Words are maximal runs without ASCII white space. ``n_dup_lines`` counts lines with a word that
    equal an earlier line; ``n_repeat_words`` counts words inside 3-word windows found twice or more.
    ``n_window_distinct`` counts different words, window by window.
    """
    return appended(df, text, SIGNALS, _signals, keep)


def base_failed() -> Column:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the signals. Shares are compared as products, so that no word means no division."""
    words, lines = F.col("n_words"), F.col("n_lines")
    some = words > 0
    return {
        "length": _vote(words < MIN_WORDS, words >= 2 * MIN_WORDS),
        "word_length": F.when(some, _vote(
            (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words),
            (F.col("word_chars") >= 3 * words) & (F.col("word_chars") <= 10 * words),
        )).otherwise(0),
        "symbols": F.when(some, _vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 50 < words)).otherwise(0),
        "symbol_words": F.when(some, _vote(F.col("n_symbol_words") * 10 > words * 2, F.col("n_symbol_words") * 50 < words)).otherwise(0),
        "lines": F.when(lines >= 4, _vote(F.col("n_dup_lines") * 10 > lines * 5, F.col("n_dup_lines") * 10 <= lines)).otherwise(0),
        "repeats": F.when(some, _vote(
            F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT, F.col("n_repeat_words") * 100 <= words * 10
        )).otherwise(0),
        "letters": F.when(some, _vote(F.col("n_letter_words") * 10 < words * 7, F.col("n_letter_words") * 10 >= words * 9)).otherwise(0),
        # Few different words in a window are a fault, however long the text is.
        "variety": F.when(words >= MIN_WORDS, _vote(
            F.col("n_window_distinct") * 100 < F.col("n_window_words") * 30,
            F.col("n_window_distinct") * 100 >= F.col("n_window_words") * 45,
        )).otherwise(0),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, per rule, the log odds that its votes for and against add."""

    share: float
    weights: dict[str, tuple[float, float]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability of being good; an abstaining rule adds nothing."""
        odds = F.lit(float(np.log(self.share / (1 - self.share))))
        for name, vote in votes.items():
            up, down = self.weights[name]
            odds = odds + F.when(vote == 1, up).when(vote == -1, down).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Fit the share of good rows and each rule's log odds to vote patterns (-1, 0, 1) with counts.

    A rule has an accuracy in either class: how often, when it votes, it votes for a good document
    and against a bad one. The start calls a pattern bad if any rule votes against it. Accuracies have
    a weak prior, and a vote for never counts against nor the other way round, so that the classes
    cannot trade places. Returns (share, array of (for, against) per rule).
    """
    for_, against = patterns == 1, patterns == -1
    good = np.where(against.any(axis=1), 0.02, 0.98)
    share, weights = 0.8, np.zeros((patterns.shape[1], 2))
    for _ in range(rounds):
        on_good, on_bad = counts * good, counts * (1 - good)
        right_good = (on_good @ for_ + 9) / (on_good @ (for_ | against) + 10)
        right_bad = (on_bad @ against + 1) / (on_bad @ (for_ | against) + 2)
        new = np.column_stack([
            np.clip(np.log(right_good / (1 - right_bad)), 0, 3),
            np.clip(np.log((1 - right_good) / right_bad), -9, 0),
        ])
        new_share = float(np.clip((counts @ good + 8) / (counts.sum() + 10), 0.05, 0.95))
        done = max(np.abs(new - weights).max(initial=0), abs(new_share - share)) < 1e-10
        share, weights = new_share, new
        if done:
            break
        odds = np.log(share / (1 - share)) + for_ @ weights[:, 0] + against @ weights[:, 1]
        good = 1 / (1 + np.exp(-odds))
    return share, weights


def fit(signalled: DataFrame) -> LabelModel:
    """Fit the label model to all rows: one aggregation, at most 3^rules rows reach the driver."""
    votes = rules()
    rows = (
        signalled.select(*[v.alias(n) for n, v in votes.items()])
        .groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).orderBy(*votes).collect()
    )
    patterns = np.array([[r[n] for n in votes] for r in rows], float).reshape(len(rows), len(votes))
    share, weights = em(patterns, np.array([r["n"] for r in rows], float))
    return LabelModel(share, {n: (float(up), float(down)) for n, (up, down) in zip(votes, weights)})


def judged(signalled: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    return (
        signalled.withColumn("base_failed", base_failed())
        .withColumn("quality", model.posterior(rules()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
