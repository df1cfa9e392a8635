"""Toxicity by weak supervision.

A lexicon of word units (whole words and word beginnings) is induced from labelled training rows: the
units that toxic texts hold far more often than others, by more than chance brings among so many units. Each
unit belongs to a class of evidence, and a text's counts of units by class are what voters and classifier
see, however many units there are. Voters vote toxic when a text holds a unit of their classes and abstain
otherwise; patterns of writing vote as well, and two voters vote against. The given label is a voter like
the others. A generative label model, fitted to the votes alone, estimates how often each voter speaks in
either class and how the voters' errors correlate, and turns votes into a posterior label. A linear classifier
on class counts and patterns is trained on the posterior labels and scores every text.

Lexicon and label model are fitted to all labelled rows, by counts of units and of vote patterns; the
classifier to at most about ``SAMPLE_ROWS`` of them, picked by a hash of the text. Scoring is one pass over
whole texts without a shuffle.

What reaches the driver and the tasks: 9 bytes for each unit of the lexicon, of which chance brings at most about
``CHANCE_UNITS`` and the rest is the toxic vocabulary of the labelled rows; at most 2 to the power of ``BITS``
vote patterns; the sample's features, ``CLASSES`` and a few more numbers a row.

Null and empty texts have the score of no words; texts are read whole, whatever their length. Equal texts
have equal scores; without toxic labels, or without rows, every score is low.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.llm import words as W
from meshlight.llm.batches import appended, text_of
from meshlight.session import written

SAMPLE_ROWS = 20_000
CHANCE_UNITS = 1e6  # units that may pass by chance, at most
PURE = (0.8, 0.9, 0.97)  # toxic share of the texts that hold a unit: classes of evidence by it
WEIGHTS = 24  # classes of evidence by likelihood ratio, each a square root of two above the one before
CLASSES = WEIGHTS * (len(PURE) + 1)
STRONG_WEIGHT, STRONG_PURE = 5, 2  # from these classes on a unit is strong evidence
MIN_TEXTS = 4  # toxic texts that must hold a unit
MIN_ODDS = 3.0  # log odds ratio
PREFIXES = (4, 5, 6)
VOTERS = 8  # of the lexicon, each with the units of some neighbouring classes
SEED_SHARE = 0.1  # share of toxic texts that the label model starts from

_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = ~_APART
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True
_STAR = np.zeros(256, bool)
_STAR[ord("*")] = True
PATTERNS = ("shouting", "exclaiming", "stretched", "masked")
_TAIL = len(PATTERNS) + 3  # features after the class counts
BITS = VOTERS + 2 + len(PATTERNS) + 2 + 2  # votes, the given label's two among them


def _lowered(run: W.Run) -> W.Run:
    return W.Run(run.first, run.n, W.LOWER[run.data], run.bounds)


def _units(run: W.Run) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Unit hashes with their words: whole words, then beginnings of each length; and each word's text."""
    low = _lowered(run)
    starts, ends, doc = low.segments(_APART)
    hashes, words = [low.hashes(starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(low.hashes(starts[long], starts[long] + k))
        words.append(long)
    return hashes, words, doc


def _patterns(run: W.Run, n_words: np.ndarray) -> np.ndarray:
    """Shares of the text that shout, exclaim, stretch letters, or mask them."""
    data = run.data
    letters = run.per_document(_LETTER[data])
    stretched = np.zeros(len(data), bool)
    masked = np.zeros(len(data), bool)
    if len(data) > 3:
        same = (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3]) & _LETTER[data[3:]]
        stretched[3:] = same
        masked[1:-1] = _STAR[data[1:-1]] & _LETTER[data[:-2]] & (_LETTER[data[2:]] | _STAR[data[2:]])
    words = np.maximum(1, n_words)
    return np.column_stack([
        np.where(letters >= 20, run.per_document(_UPPER[data]) / np.maximum(1, letters), 0.0),
        np.minimum(1.0, run.per_document(_BANG[data]) / words),
        np.minimum(1.0, run.per_document(stretched) / words),
        np.minimum(1.0, run.per_document(masked) / words),
    ])


@dataclass(frozen=True)
class Lexicon:
    """Sorted unit hashes, and the class of evidence of each."""

    units: np.ndarray
    classes: np.ndarray


def _odds(a, b, n_toxic: int, n_clean: int, log=np.log):
    """Log odds ratio of a unit that a toxic and b other texts hold."""
    return log((a + 0.5) / (n_toxic - a + 0.5)) - log((b + 0.5) / (n_clean - b + 0.5))


def _ratio(a, b, n_toxic: int, n_clean: int, log=np.log):
    """Likelihood ratio of the texts that hold a unit against those that would by chance: chance exceeds it
    with a probability of about exp(-ratio / 2)."""
    share = n_toxic / max(1, n_toxic + n_clean)
    held = a + b
    return 2 * (a * log((a + 1e-9) / (held * share + 1e-9)) + b * log((b + 1e-9) / (held * (1 - share) + 1e-9)))


def _least_ratio(tested: int) -> float:
    """The ratio that so many units reach by chance no more than ``CHANCE_UNITS`` times."""
    return max(0.0, 2 * float(np.log(max(1, tested) / CHANCE_UNITS)))


def lexicon(units: np.ndarray, a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int, tested: int) -> tuple[Lexicon, Lexicon, Lexicon]:
    """All units that pass; and the units as a toxic and as another training text sees them.

    A training text sees the units that pass without its own count, so that units of chance do not look
    better on the texts they were found in than on others.
    """
    order = np.argsort(units)
    units, a, b = units[order], a[order], b[order]
    least = _least_ratio(tested)
    weight = np.clip(2 * np.log2(np.maximum(_ratio(a, b, n_toxic, n_clean), 8.0) / 8.0), 0, WEIGHTS - 1).astype(np.uint8)
    pure = np.searchsorted(PURE, (a + 0.5) / (a + b + 1), side="right").astype(np.uint8)
    classes = weight * (len(PURE) + 1) + pure

    def of(a: np.ndarray, b: np.ndarray) -> Lexicon:
        kept = (a >= MIN_TEXTS) & (_odds(a, b, n_toxic, n_clean) >= MIN_ODDS) & (_ratio(a, b, n_toxic, n_clean) >= least)
        return Lexicon(units[kept], classes[kept])

    return of(a, b), of(a - 1, b), of(a, np.maximum(0, b - 1))


_CLASS = np.arange(CLASSES)
_STRONG = (_CLASS // (len(PURE) + 1) >= STRONG_WEIGHT) & (_CLASS % (len(PURE) + 1) >= STRONG_PURE)


def _features(texts: pa.Array, known: Lexicon) -> np.ndarray:
    """Of each text: counts of units by class, patterns, words, words with a strong unit, and words with other
    units alone."""
    n, units = len(texts), known.units
    out = np.zeros((n, CLASSES + _TAIL), np.float32)
    for run in W.runs(texts):
        hashes, words, doc = _units(run)
        rows = slice(run.first, run.first + run.n)
        n_words = W.counts_per(doc, run.n)
        out[rows, CLASSES:-3] = _patterns(run, n_words)
        out[rows, -3] = n_words
        if len(units):
            strong_word, hit_word = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            for h, w in zip(hashes, words):
                place = np.minimum(np.searchsorted(units, h), len(units) - 1)
                hit = np.flatnonzero(units[place] == h)
                classes = known.classes[place[hit]]
                np.add.at(out, (run.first + doc[w[hit]], classes), 1)
                hit_word[w[hit]] = True
                strong_word[w[hit[_STRONG[classes]]]] = True
            out[rows, -2] = W.counts_per(doc[strong_word], run.n)
            out[rows, -1] = W.counts_per(doc[hit_word & ~strong_word], run.n)
    return out


@dataclass(frozen=True)
class Model:
    """The lexicon and the classifier's weights on its inputs."""

    lexicon: Lexicon
    weights: np.ndarray

    @property
    def units(self) -> np.ndarray:
        return self.lexicon.units

    def score(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(_inputs(_features(texts, self.lexicon)) @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _inputs(features: np.ndarray) -> np.ndarray:
    """Of each text: damped class counts, patterns, damped number and share of words with a unit, and 1.

    Words that only units of little evidence know are numbered apart: in a large lexicon chance brings some.
    """
    n_words = np.maximum(1, features[:, -3])
    units = features[:, :-_TAIL]
    numbers = [f(hits) for hits in (features[:, -2], features[:, -1]) for f in (
        np.log1p, lambda x: np.minimum(x, 2), lambda x: np.minimum(1.0, 20 * x / n_words),
    )]
    return np.column_stack([
        np.log1p(np.minimum(units, 8)), features[:, -_TAIL:-3], *numbers, np.ones(len(features)),
    ]).astype(np.float64)


def votes(features: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 not, 0 abstain).

    Each lexicon voter has the units of some neighbouring classes of weight. Two more ask for a second and a
    fourth word with a strong unit, four look at patterns, and two vote against texts with none or one
    word of the lexicon.
    """
    units = features[:, :-_TAIL]
    patterns, hits, others = features[:, -_TAIL:-3], features[:, -2], features[:, -1]
    cast = [(part > 0).any(axis=1).astype(int) for part in np.array_split(units, VOTERS, axis=1)]
    cast += [(hits >= 2).astype(int), (hits >= 4).astype(int)]
    cast += [(patterns[:, k] > bound).astype(int) for k, bound in enumerate((0.4, 0.05, 0.02, 0.02))]
    cast += [np.where(hits + others == 0, -1, 0), np.where(hits + others <= 1, -1, 0)]
    return np.column_stack(cast)


def label_model(
    cast: np.ndarray, start: np.ndarray | None = None, rounds: int = 100, counts: np.ndarray | None = None
) -> np.ndarray:
    """Posterior probability of toxic for each row of votes, from a first guess (else: any vote for it).

    Expectation-maximisation over how often each voter speaks in either class gives its log odds. Voters
    that speak together beyond what the classes explain repeat one another: with the correlations of
    their residuals, a vote counts the less the more of its like are cast on the same row. A row may
    stand for ``counts`` equal ones.
    """
    if not len(cast):
        return np.zeros(0)
    speaks = cast != 0
    counts = np.ones(len(cast)) if counts is None else counts.astype(float)
    parts = [slice(at, at + 65_536) for at in range(0, len(cast), 65_536)]  # numbers are wide, votes are not
    own = np.where((cast == -1).any(axis=0), 0, 1)
    toxic = np.where((cast == 1).any(axis=1), 0.9, 0.02) if start is None else start
    odds = np.zeros(cast.shape[1])
    for _ in range(rounds):
        both = np.column_stack([(1 - toxic) * counts, toxic * counts])
        mass = both.sum(axis=0)
        rate = sum(speaks[p].T.astype(float) @ both[p] for p in parts)
        # A weak prior: a voter speaks in its own class more often than in the other.
        rate = (rate + np.where(np.arange(2) == own[:, None], 0.6, 0.02)) / (mass + 1)
        log_ratio = np.log(rate[:, 1] / rate[:, 0])
        new = np.where(own == 1, np.clip(log_ratio, 0, 8), np.clip(log_ratio, -8, 0))
        share = float(np.clip((mass[1] + 1) / (mass.sum() + 10), 0.005, 0.5))
        base = np.log(share / (1 - share))
        toxic = _sigmoid(base + np.concatenate([speaks[p] @ new for p in parts]))
        done = np.abs(new - odds).max() < 1e-8
        odds = new
        if done:
            break
    moments = np.zeros((len(own), len(own)))
    for p in parts:
        residual = speaks[p] - np.outer(1 - toxic[p], rate[:, 0]) - np.outer(toxic[p], rate[:, 1])
        moments += (residual * counts[p, None]).T @ residual
    moments /= counts.sum()
    spread = np.sqrt(np.diag(moments)) + 1e-9
    repeats = np.clip(moments / np.outer(spread, spread), 0, 1)
    np.fill_diagonal(repeats, 0)
    return _sigmoid(base + np.concatenate([(speaks[p] * odds / (1 + speaks[p] @ repeats)).sum(axis=1) for p in parts]))


def linear_classifier(inputs: np.ndarray, target: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression on soft labels by damped Newton steps; the constant is hardly held to its start."""
    n, width = inputs.shape
    weights = np.zeros(width)
    ridge = np.full(width, penalty * max(1, n))
    ridge[-1] = 1e-6 * max(1, n)
    weights[-1] = np.log(SEED_SHARE / (1 - SEED_SHARE))
    start = weights.copy()

    def loss(w: np.ndarray) -> float:
        z = np.clip(inputs @ w, -35, 35)
        return float((np.logaddexp(0, z) - target * z).sum() + (ridge * (w - start) ** 2).sum() / 2)

    now = loss(weights)
    for _ in range(rounds):
        p = _sigmoid(inputs @ weights)
        slope = inputs.T @ (p - target) + ridge * (weights - start)
        bend = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-9 and loss(weights - size * step) > now:
            size /= 2
        weights = weights - size * step
        before, now = now, loss(weights)
        if before - now <= 1e-9 * max(1.0, abs(now)):
            break
    return weights


def _training_features(batch: pa.RecordBatch, seen: list[Lexicon]) -> np.ndarray:
    """Features of (text, toxic) rows, by the units that each sees, and the label."""
    toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    parts = []
    for label, known in ((True, seen[0]), (False, seen[1])):
        texts = batch.column(0).filter(pa.array(toxic == label))
        parts.append(np.column_stack([_features(texts, known), np.full(len(texts), label, np.float32)]))
    return np.concatenate(parts)


def _unit_counts(batches):
    """Per batch and unit: texts that are toxic and texts that are not, which hold it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for run in W.runs(batch.column(0)):
            hashes, words, doc = _units(run)
            keys, texts = np.concatenate(hashes), doc[np.concatenate(words)]
            order = np.lexsort((texts, keys))
            keys, texts = keys[order], texts[order]
            if not len(keys):
                continue
            once = np.append(True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]))
            keys, texts = keys[once], texts[once]
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            held = toxic[run.first + texts].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[cuts].view(np.int64)), pa.array(np.add.reduceat(held, cuts)),
                    pa.array(np.add.reduceat(1 - held, cuts)),
                ],
                ["unit", "toxic", "clean"],
            )


_PAGE = 15  # bits of a bitmap page's positions
MAX_BITS = 1 << 29  # of the bitmap that sifts texts; beyond it more texts pass in vain


def _sifted(texts: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """The rows whose ``__llm_text`` may be one of the n of ``marks``: all that are, and few others.

    One bit of a broadcast bitmap for each, so that other texts are not shuffled.
    """
    bits = min(MAX_BITS, max(1 << _PAGE, 1 << (8 * n).bit_length()))
    place = F.col("__llm_text").bitwiseAND(F.lit(bits - 1))
    page, at = F.shiftright(place, _PAGE).cast("int"), place.bitwiseAND(F.lit((1 << _PAGE) - 1))
    pages = marks.select(page.alias("__page"), at.alias("at")).groupBy("__page").agg(F.bitmap_construct_agg("at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return texts.join(F.broadcast(pages), page == F.col("__page")).where(bit).select(*texts.columns)


def training_rows(df: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(__llm_text, text, toxic) of every labelled row; equal texts once, with the hash of the text.

    Rows with a null id or label teach nothing; of several labels of one id, or of equal texts, the
    largest holds. Ids and hashes meet the labels first, so that only texts that have one are shuffled.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__llm_id")).agg(
        F.max(F.col(label).cast("int")).alias("toxic")
    )
    hashed = df.select(F.xxhash64(text_of(text)).alias("__llm_text"), F.col(f"`{key}`").alias("__llm_key"))
    marks = hashed.where("__llm_key IS NOT NULL").distinct().join(known, F.col("__llm_key") == F.col("__llm_id"))
    marks = written(marks.groupBy("__llm_text").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    texts = df.select(F.xxhash64(text_of(text)).alias("__llm_text"), text_of(text).alias("text"))
    once = _sifted(texts, marks, marks.count()).groupBy("__llm_text").agg(F.first("text").alias("text"))
    return once.join(marks, "__llm_text").select("__llm_text", "text", "toxic")


def _cast(features: np.ndarray) -> np.ndarray:
    """Votes and the given label, the last of the features: one voter more, whose errors are estimated too."""
    given = features[:, -1].astype(int)
    return np.column_stack([votes(features[:, :-1]), given, given - 1])


def _mask(cast: np.ndarray) -> np.ndarray:
    """Which voters speak, as bits. A voter speaks for one class only."""
    return (cast != 0) @ (1 << np.arange(cast.shape[1], dtype=np.int64))


def train(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS
) -> Model:
    """Fit lexicon and label model to all labelled rows, the classifier to about ``rows`` of them.

    Without toxic rows every score is low.
    """
    every = written(training_rows(df, labels, text, key, label), "toxicity-training")
    n_toxic, n = (int(x or 0) for x in every.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    n_clean = n - n_toxic
    texts = every.select("text", "toxic")
    counted = written(
        texts.mapInArrow(_unit_counts, "unit bigint, toxic bigint, clean bigint").groupBy("unit").agg(
            F.sum("toxic").alias("a"), F.sum("clean").alias("b")
        ), "toxicity-units",
    )
    tested = counted.count()
    # Every unit that passes is kept, or would pass without one of the other texts that hold it. The test is
    # made where the counts are; only units that pass it reach the driver.
    a, fewer = F.col("a"), F.greatest(F.col("b") - 1, F.lit(0))
    near = (_odds(a, fewer, n_toxic, n_clean, F.log) >= MIN_ODDS - 1e-9) & (
        _ratio(a, fewer, n_toxic, n_clean, F.log) >= _least_ratio(tested) - 1e-6
    )
    held = counted.where((a >= MIN_TEXTS) & near).toArrow()
    unit, a, b = (held[c].to_numpy() for c in ("unit", "a", "b"))
    known, *seen = lexicon(unit.view(np.uint64), a, b, n_toxic, n_clean, tested)
    shipped = df.sparkSession.sparkContext.broadcast(seen)

    def patterns(batches):
        for batch in batches:
            masks, counts = np.unique(_mask(_cast(_training_features(batch, shipped.value))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(counts.astype(np.int64))], ["mask", "n"])

    def features(batches):
        for batch in batches:
            flat = _training_features(batch, shipped.value)
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))], ["x"]
            )

    # The distinct patterns of votes, two numbers each, at most 2^BITS.
    voted = texts.mapInArrow(patterns, "mask bigint, n bigint").groupBy("mask").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(masks := voted["mask"].to_numpy())
    masks, counts = masks[order], voted["n"].to_numpy()[order]
    signs = _cast(np.zeros((1, CLASSES + _TAIL + 1), np.float32))[0]  # a text of nothing casts all votes against
    cast = np.where(masks[:, None] >> np.arange(len(signs)) & 1, np.where(signs < 0, -1, 1), 0).astype(np.int8)
    posterior = label_model(cast, np.where(cast[:, -2] == 1, 0.9, 0.02), counts=counts)

    # The bounded sample's features.
    part = F.pmod(F.xxhash64("__llm_text", F.lit("toxicity")), F.lit(1 << 24)) < int(min(1.0, rows / max(1, n)) * (1 << 24))
    rows_ = every.where(part).select("text", "toxic").mapInArrow(features, "x array<float>").toArrow()["x"].combine_chunks()
    width = CLASSES + _TAIL + 1
    flat = rows_.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(rows_) else np.zeros((0, width), np.float32)
    flat = flat[np.lexsort(flat.T[::-1])]  # the same sums whatever order the rows arrive in
    target = posterior[np.searchsorted(masks, _mask(_cast(flat)))]
    return Model(known, linear_classifier(_inputs(flat[:, :-1]), target))


def scored(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``toxicity`` (0 to 1) of each whole text; an input column named ``toxicity`` is replaced."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # the units' hashes and classes, and the weights
    return appended(df, text, "toxicity double", lambda texts: {"toxicity": shipped.value.score(texts)}, keep)
