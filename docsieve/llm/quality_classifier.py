"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: of its words, of its pairs of
words and of the character n-grams of its words, all hashed into buckets; a
softmax over two classes follows. Fitted by stochastic gradient descent in
numpy on a bounded labelled sample. For scoring, the output layer is folded
into the buckets, so that a feature is one number.

Pairs of a word and itself share one bucket: a word said twice running is one
feature whatever the word, which n-grams of known words can't tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed, labelled
from .common import fresh, text_or_empty

#: Buckets (a power of two) and numbers of a vector.
BITS, DIM = 17, 16
BUCKETS = 1 << BITS
#: Lengths of the character n-grams of a word between its marks.
NGRAMS = (3, 4, 5)
EPOCHS, RATE = 4, 3.0
_PAIR, _SAME, _SPREAD = np.uint32(0x27D4EB2F), np.uint32(1), np.uint32(0x2C1B3C6D)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _SPREAD) >> np.uint32(32 - BITS)


def features(text: str, size: int | None = None) -> Iterator[np.ndarray]:
    """Buckets of all features of a whole text, in arrays of bounded size.

    The features don't depend on the slices. A text without words has one
    feature, the word of no characters.
    """
    words, before, any_word = hashed.Words(), np.empty(0, np.uint32), False
    tail = np.full(1, hashed.SPACE, dtype=np.uint32)

    def of_words(new: np.ndarray) -> Iterator[np.ndarray]:
        nonlocal before, any_word
        if len(new):
            any_word = True
            run = np.concatenate([before, new])
            first, second = run[:-1], run[1:]
            yield _bucket(new)
            yield _bucket(hashed.mixed(np.where(first == second, _SAME, first * _PAIR + second)))
            before = run[-1:]

    for codes in hashed.slices(text, size):
        yield from of_words(words.feed(codes, hashed.white(codes)))
        joined = np.concatenate([tail, codes])
        yield from map(_bucket, hashed.ngrams(joined, len(tail), NGRAMS))
        tail = joined[-(NGRAMS[-1] - 1) :]
    yield from of_words(words.end())
    if any_word:
        yield from map(_bucket, hashed.ngrams(np.append(tail, np.uint32(hashed.SPACE)), len(tail), NGRAMS))
    else:
        yield _bucket(np.zeros(1, dtype=np.uint32))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their shares of its features."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in features(text):
        ids, n = np.unique(part, return_counts=True)
        counts[ids] += n
    ids = np.flatnonzero(counts).astype(np.int32)
    return ids, (counts[ids] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """``weights``: a number per bucket, the difference of the two classes' logits; ``bias`` likewise."""

    weights: np.ndarray
    bias: float


def score_text(model: Model, text: str) -> float:
    """Probability of class 1 of a whole text."""
    total, n = 0.0, 0
    for part in features(text):
        total += float(model.weights[part].sum(dtype=np.float64))
        n += len(part)
    return float(1 / (1 + np.exp(-np.clip(total / n + model.bias, -60, 60))))


def fit(rows: list[tuple[str, int]], *, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 7, prior: float | None = None) -> Model:
    """Fit on (text, class) rows. Without rows every text scores 0.5; with rows of
    one class only, texts score towards that class.

    ``prior``: the share of class 1 that scores assume; the sample's own by default.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    bags = [(*bag(text), y) for text, y in rows]
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share, y = bags[i]
            vectors = table[ids]
            h = share @ vectors
            logits = h @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - done / steps)
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= 0.1 * lr * p
            # shares are small: a bucket's step is scaled up to the size that one feature in a short text would get
            table[ids] = vectors - (lr * 20 * share)[:, None] * back
            done += 1
    share_1 = np.mean([y for _, y in rows]) if rows else 0.5
    shift = 0.0
    if prior is not None and 0 < share_1 < 1:
        shift = float(np.log(prior / (1 - prior)) - np.log(share_1 / (1 - share_1)))
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]) + shift)


def score_column(text: Column, model: Model) -> Column:
    """Probability of class 1 of each text; the model has a fixed size and goes to the workers once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_text(model, t) for t in texts], dtype="float64")

    return score(text)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``; nothing but the text is looked at, a null text is an empty one.

    A name that clashes gets a leading underscore; an empty table gives an empty result.
    """
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score_column(text_or_empty(text_col), model))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = labelled.PER_CLASS, **columns: str) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class."""
    return fit(labelled.sample(docs, labels, label, per_class=per_class, **columns), prior=0.5)
