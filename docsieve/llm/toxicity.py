"""Toxicity: a convolutional text classifier in numpy.

Hashed word embeddings, filters of several widths, max pooling and a logistic
output, all learned from random starts on a bounded labelled sample. A part of
the sample sets a threshold per language, which moves the scores so that 0.5 is
the threshold everywhere. Languages are guessed from the text alone: they are
the clusters of the sample's character profiles, learned without any tag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed, labelled
from .common import fresh, text_or_empty

#: A word has two rows of HALF numbers, from two tables of 2 ** BITS rows: at the hash of itself and at that of its first STEM letters.
BITS, HALF, STEM = 17, 8, 5
BUCKETS, DIM = 1 << BITS, 2 * HALF
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, RATE, CALIBRATION = 8, 0.1, 4
#: Steps that a fit takes at least: small samples go through more epochs, up to MOST_EPOCHS.
LEAST_STEPS, MOST_EPOCHS = 10_000, 60
#: Share of a text's words that a step of the fit sees, so that it doesn't learn texts by heart.
KEEP = 0.7
#: Texts of the sample that a word (or stem) must be in to have a vector; all others share the zero vector.
LEAST_TEXTS = 4
#: Spread of the random starts of word vectors.
SPREAD = 0.05
#: Share of the epochs in which all words of a text learn, by a pooling of this sharpness; then only the largest responses do.
SOFT, SHARP = 0.375, 1.0
#: Share of clean texts lost against share of toxic texts missed, when thresholds are set.
FALSE_COST = 3
#: Character profile of a text: hashed pairs of code points; clusters of them; rounds of their fit; texts of each class that a threshold needs.
PROFILE, LANGUAGES, ROUNDS, LEAST_CLASS = 512, 8, 12, 20


def _between_words(codes: np.ndarray) -> np.ndarray:
    """White space and ASCII punctuation."""
    low = codes < 128
    return low & _MARKS[np.where(low, codes, 0)]


_MARKS = np.array([chr(i).isspace() or 0x21 <= i < 0x7F and not chr(i).isalnum() for i in range(128)])


def parts_of(text: str, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, profile counts) of a whole text, in parts of bounded size."""
    words, last = hashed.Words(STEM), np.full(1, hashed.SPACE, dtype=np.uint32)
    for codes in hashed.slices(text, size):
        codes = np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        run = np.concatenate([last, codes])
        pairs = hashed.mixed(run[:-1] * np.uint32(31) + run[1:]) % np.uint32(PROFILE)
        yield words.feed(codes, _between_words(codes)), np.bincount(pairs, minlength=PROFILE)
        last = run[-1:]
    yield words.end(), np.zeros(PROFILE, dtype=np.int64)


def _rows(words: np.ndarray) -> np.ndarray:
    """The two table rows of each word."""
    return (words >> np.uint32(32 - BITS)).astype(np.int32) + np.array([0, BUCKETS], dtype=np.int32)


def _unit(counts: np.ndarray) -> np.ndarray:
    """Profiles of length one, with large counts damped (no characters: zero)."""
    root = np.sqrt(counts.astype(np.float64))
    return root / np.maximum(np.linalg.norm(root, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    table: np.ndarray  # (2 * BUCKETS, HALF)
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    bias: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((1, PROFILE)))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of words, and zero vectors after the last for the filters that reach over it."""
        out = np.zeros((len(rows) + WIDTHS[-1] - 1, DIM), dtype=np.float32)
        out[: len(rows)] = self.table[rows].reshape(len(rows), DIM)
        return out

    def language(self, profile: np.ndarray) -> int:
        return int((self.languages @ profile).argmax())


def responses(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Per width the responses (position, filter) over embedded words; a text without words has one position."""
    n = max(1, len(x) - WIDTHS[-1] + 1)
    if len(x) < n + WIDTHS[-1] - 1:
        x = np.concatenate([x, np.zeros((n + WIDTHS[-1] - 1 - len(x), DIM), dtype=np.float32)])
    return [sum(x[k : k + n] @ model.filters[j][k] for k in range(width)) + model.biases[j] for j, width in enumerate(WIDTHS)]


def _softmax(r: np.ndarray, sharp: float) -> np.ndarray:
    w = np.exp(sharp * (r - r.max(axis=0)))
    return w / w.sum(axis=0)


def fit(rows: list[tuple[str, int]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    """Fit on (text, class) rows; every CALIBRATION-th row only sets thresholds. Without rows every text scores 0.5."""
    rng = np.random.default_rng(seed)
    model = Model(
        np.zeros((2 * BUCKETS, HALF), dtype=np.float32),
        [rng.normal(0, (width * DIM) ** -0.5, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), dtype=np.float32),
        rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32),
        0.0,
    )
    if not rows:
        model.out[:] = 0
        return model
    seen = [(np.concatenate([w for w, _ in parts]), sum(p for _, p in parts), y) for parts, y in ((list(parts_of(text)), y) for text, y in rows)]
    train = [(_rows(w), y) for i, (w, _, y) in enumerate(seen) if i % CALIBRATION]
    texts = np.zeros(2 * BUCKETS, dtype=np.int32)
    for at, _ in train:
        texts[np.unique(at)] += 1
    known = texts >= LEAST_TEXTS
    model.table[known] = rng.normal(0, SPREAD, (int(known.sum()), HALF))
    square = np.full(2 * BUCKETS, 1e-2, dtype=np.float32)  # Adagrad, a number per table row
    epochs = max(epochs, min(MOST_EPOCHS, -(-LEAST_STEPS // max(1, len(train)))))
    steps, done = max(1, epochs * len(train)), 0
    for epoch in range(epochs):
        # all words learn in the first part of the fit
        sharp = SHARP if epoch < SOFT * epochs else None
        for i in rng.permutation(len(train)):
            at, y = train[i]
            stay = rng.random(len(at)) < KEEP
            step(model, square, known, at[stay] if stay.any() else at, y, rate * (1 - done / steps), sharp)
            done += 1
    _languages(model, np.stack([p for _, p, _ in seen]), rng)
    _calibrate(model, [x for i, x in enumerate(seen) if not i % CALIBRATION])
    return model


def step(model: Model, square: np.ndarray, known: np.ndarray, at: np.ndarray, y: int, lr: float, sharp: float | None) -> None:
    """One gradient step on a text with table rows ``at``, of which only those that ``known`` marks change."""
    x = model.embed(at)
    r = responses(model, x)
    columns = np.arange(FILTERS)
    if sharp is None:
        where = [a.argmax(axis=0) for a in r]
        pooled = np.stack([a[w, columns] for a, w in zip(r, where, strict=True)])
    else:
        share = [_softmax(a, sharp) for a in r]
        pooled = np.stack([(s * a).sum(axis=0) for s, a in zip(share, r, strict=True)])
    active = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip((active * model.out).sum() + model.bias, -30, 30)))
    g = float(p - y)
    if abs(g) < 1e-3:
        return
    back = g * model.out * ((pooled > 0) + 0.05)  # a small slope below zero keeps idle filters alive
    model.out -= lr * g * active
    model.bias -= lr * g
    model.biases -= lr * back
    if not len(at):
        return
    if sharp is None:
        place = np.unique(np.concatenate([w + k for w, width in zip(where, WIDTHS, strict=True) for k in range(width)]))
        dx = np.zeros((len(place), DIM), dtype=np.float32)
        for j, width in enumerate(WIDTHS):
            for k in range(width):
                hit = where[j] + k
                np.add.at(dx, np.searchsorted(place, hit), (model.filters[j][k] * back[j]).T)
                model.filters[j][k] -= lr * x[hit].T * back[j]
        inside = place < len(at)
        place, dx = place[inside], dx[inside]
    else:
        place, dx = np.arange(len(at)), np.zeros((len(x), DIM), dtype=np.float32)
        for j, width in enumerate(WIDTHS):
            own = share[j] * back[j]
            for k in range(width):
                part = x[k : k + len(own)]
                dx[k : k + len(own)] += own @ model.filters[j][k].T
                model.filters[j][k] -= lr * (part.T @ own)
        dx = dx[: len(at)]
    both, d = at[place].ravel(), dx.reshape(-1, HALF)
    learns = known[both]
    order = np.argsort(both[learns], kind="stable")
    both, d = both[learns][order], d[learns][order]
    if not len(both):
        return
    first = np.flatnonzero(np.diff(both, prepend=-1))
    rows, total = both[first], np.add.reduceat(d, first, axis=0)
    square[rows] += (total * total).sum(axis=1)
    model.table[rows] -= lr * total / np.sqrt(square[rows])[:, None]


def _languages(model: Model, counts: np.ndarray, rng: np.random.Generator) -> None:
    """Clusters of unit profiles by spherical k-means; each start lies farthest from those before."""
    unit = _unit(counts)
    centres = unit[[int(rng.integers(len(unit)))]]
    for _ in range(min(LANGUAGES, len(unit)) - 1):
        centres = np.concatenate([centres, unit[[int((unit @ centres.T).max(axis=1).argmin())]]])
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    model.languages, model.thresholds = centres, np.zeros(len(centres))


def _best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between logits that separates the classes best."""
    order = np.argsort(logits)
    s, t = logits[order], y[order]
    missed, false = np.concatenate([[0], np.cumsum(t)]), np.concatenate([[(1 - t).sum()], (1 - t).sum() - np.cumsum(1 - t)])
    cost = missed / max(1, t.sum()) + FALSE_COST * false / max(1, (1 - t).sum())
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    good = np.flatnonzero(cost <= cost.min() + 1e-12)
    i = good[np.argmax(edges[good + 1] - edges[good])]  # the widest gap of the best ones
    return float((edges[i] + edges[i + 1]) / 2)


def _calibrate(model: Model, seen: list) -> None:
    """A threshold per guessed language, or of all together where a class has under LEAST_CLASS rows."""
    if not seen or len({y for _, _, y in seen}) < 2:
        return
    logits = np.array([logit(model, [w]) for w, _, _ in seen])
    y = np.array([y for _, _, y in seen])
    lang = np.array([model.language(_unit(p)) for _, p, _ in seen])
    every = _best_cut(logits, y)
    for i in range(len(model.languages)):
        own = lang == i
        enough = min((y[own] == 0).sum(), (y[own] == 1).sum()) >= LEAST_CLASS
        model.thresholds[i] = _best_cut(logits[own], y[own]) if enough else every


def logit(model: Model, parts: Iterator[np.ndarray] | list[np.ndarray]) -> float:
    """Output before the threshold for word hashes in parts; windows of words go over the parts."""
    best, held = np.full((len(WIDTHS), FILTERS), -np.inf, dtype=np.float32), np.empty((0, 2), np.uint32)

    def pool(x: np.ndarray) -> None:
        for j, r in enumerate(responses(model, x)):
            best[j] = np.maximum(best[j], r.max(axis=0))

    reach = WIDTHS[-1] - 1
    for words in parts:
        held = np.concatenate([held, words])
        if len(held) > reach:  # the last words wait for those that follow
            pool(model.table[_rows(held)].reshape(-1, DIM))
            held = held[-reach:]
    pool(model.embed(_rows(held)))
    return float((np.maximum(best, 0) * model.out).sum()) + model.bias


def score_text(model: Model, text: str, size: int | None = None) -> float:
    profile = np.zeros(PROFILE, dtype=np.int64)

    def words() -> Iterator[np.ndarray]:
        nonlocal profile
        for own, counts in parts_of(text, size):
            profile = profile + counts
            yield own

    raw = logit(model, words())
    return float(1 / (1 + np.exp(-np.clip(raw - model.thresholds[model.language(_unit(profile))], -60, 60))))


def score_column(text: Column, model: Model) -> Column:
    """Toxicity from 0 to 1; the model has a fixed size and goes to the workers once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_text(model, t) for t in texts], dtype="float64")

    return score(text)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``; only the text is looked at, a null text is an empty one.

    Whole texts are scored, in parts that overlap. A name that clashes gets a
    leading underscore; an empty table gives an empty result.
    """
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score_column(text_or_empty(text_col), model))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = labelled.PER_CLASS, **columns: str) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class."""
    return fit(labelled.sample(docs, labels, label, per_class=per_class, **columns))
