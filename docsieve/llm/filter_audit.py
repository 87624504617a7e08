"""Audit of how filters interact: what each removes, in every order, part by part.

A document's verdicts become a mask of five bits, A to E. A to D come from its
text alone and are measured over Arrow buffers: byte classes and prefix sums
count words, capitals and symbols, sorted hashes of a document's words, with
their bytes compared where hashes agree, count the distinct ones. E says whether
a smaller id has the same text anywhere in the table. All 120 orders then follow
from the number of documents of each mask, 32 a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize, quoted, text_or_empty

FILTERS = "ABCDE"
#: A: least words; B: least distinct words, percent of the words; C: most capitals, percent of the code points; D: symbols that fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bytes beyond which a text is measured piece by piece.
LONG = 8 << 20
PIECE = 1 << 20

_GAP, _CAPITAL, _SYMBOL, _START = 1, 2, 4, 8
_CLASS = np.full(256, _START, dtype=np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[[0x20, *range(9, 14)]] |= _GAP
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _OWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _counted(where: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks each document has, by a prefix sum over all of them."""
    upto = np.concatenate([[0], np.cumsum(where, dtype=np.int64)])
    return np.diff(upto[bounds])


def _distinct(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct words of each document; ``first`` marks where words start, ``words`` counts them."""
    starts = np.flatnonzero(first)
    if not len(starts):
        return words
    at = np.flatnonzero(inside)
    head = np.flatnonzero(first[at])
    sizes = np.diff(head, append=len(at))
    place = at - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, dtype=np.uint64))
    doc = np.repeat(np.arange(len(words)), words)
    key = np.add.reduceat(_VALUE[data[at]] * powers[place], head) + doc.astype(np.uint64) * _OWN
    order = np.argsort(key)
    twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[twin], order[twin + 1]
    fits = (doc[a] == doc[b]) & (sizes[a] == sizes[b])
    n = sizes[a[fits]]
    if len(n):
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        same = data[np.repeat(starts[a[fits]], n) + step] == data[np.repeat(starts[b[fits]], n) + step]
        fits[fits] = np.logical_and.reduceat(same, ends - n)
    out = words - np.bincount(doc[a[fits]], minlength=len(words))
    for i in np.unique(np.concatenate([doc[a[~fits]], doc[b[~fits]]])):  # hashes that agree by chance: count these documents plainly
        out[i] = len(set(data[bounds[i] : bounds[i + 1]].tobytes().split()))
    return out


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (words, distinct words, capitals, symbols, code points) of the documents that lie in ``data`` between ``bounds``."""
    kind = _CLASS[data]
    inside = (kind & _GAP) == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opening = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[opening] = inside[opening]
    words = _counted(first, bounds)
    return np.stack([words, _distinct(data, bounds, inside, first, words), *(_counted((kind & x) != 0, bounds) for x in (_CAPITAL, _SYMBOL, _START))], axis=1)


def long_measures(data: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The same of one very long text, piece by piece: memory follows its distinct words and its longest one."""
    seen: set[bytes] = set()
    total, rest = np.zeros(5, dtype=np.int64), [b""]
    for i in range(0, len(data), piece):
        part = data[i : i + piece]
        kind = _CLASS[part]
        total[2:] += [int(np.count_nonzero(kind & x)) for x in (_CAPITAL, _SYMBOL, _START)]
        gaps = np.flatnonzero(kind & _GAP)
        if not len(gaps):  # inside one word
            rest.append(part.tobytes())
            continue
        closed = (b"".join(rest) + part[: gaps[-1]].tobytes()).split()
        total[0] += len(closed)
        seen.update(closed)
        rest = [part[gaps[-1] + 1 :].tobytes()]
    if last := b"".join(rest):
        total[0] += 1
        seen.add(last)
    total[1] = len(seen)
    return total


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus long columns words, distinct_words, capitals, symbols and code_points.

    A null text counts as an empty one; a very long text is measured whole, piece
    by piece; repeated rows count each by itself; an empty table gives an empty
    result. Columns of these names must not be there before.
    """

    def start():
        import pyarrow as pa
        import pyarrow.compute as pc

        def work(texts):
            texts = texts.cast(pa.large_binary())
            if texts.null_count:
                texts = pc.fill_null(texts, b"")
            _, offsets, buffer = texts.buffers()
            bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(buffer or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
            found = long_measures(data)[None, :] if len(texts) == 1 and len(data) > LONG else measures(data, bounds - bounds[0])
            return [pa.array(found[:, k]) for k in range(5)]

        return work

    return extended(docs, text_col, start, keep=False, words="long", distinct_words="long", capitals="long", symbols="long", code_points="long")


def masks(docs: DataFrame, *, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (id, part, mask, first, n): how many rows of ``docs`` share id, part, text and the verdicts A to D
    (bits 0 to 3), and whether their id is the smallest of their text.

    The smallest id of each text comes from a partial aggregate over digests, and
    goes back to its row by id and digest, so that neither a text that a third of
    the rows share nor an id that does lands in one task. A null id is neither
    smaller nor larger than another. The narrow rows are written out once.
    """
    bare = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    seen = measured(bare.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    fails = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("code_points"),
        "D": F.col("symbols") > 0,
    }
    mask = sum((F.when(f, 1 << FILTERS.index(k)).otherwise(0) for k, f in fails.items()), F.lit(0))
    rows = materialize(seen.select("id", "part", "digest", mask.cast("int").alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    firsts = rows.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("f_id")).withColumnRenamed("digest", "f_digest")
    found = rows.join(firsts, (F.col("id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    return found.select("id", "part", "mask", (F.col("f_id").isNotNull() | F.col("id").isNull()).alias("first"), "n")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the five filters and step.

    ``part``: the values of ``part_col`` (null: empty string). ``kept``: left
    after the step; ``removed``: removed in it; ``redundant``: fail its filter but
    went before; ``unique_fails``: fail its filter only; ``good_lost``,
    ``toxic_lost``: removed in it with label 1; ``shapley``: removed by its
    filter, summed over all orders. ``filter_order``, ``step`` and its letter
    name the rest.

    A document has a label if any of its label rows says 1. Null ids have no
    label; repeated rows count each by itself; an empty table gives no rows.
    """
    rows = masks(docs, id_col=id_col, part_col=part_col, text_col=text_col)
    flag = lambda c: F.max((quoted(c) == 1).cast("long"))
    marks = labels.groupBy(quoted(id_col).alias("l_id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("bad"))
    rows = rows.join(marks, F.col("id") == F.col("l_id"), "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E")))
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good"), weighed("bad"))
    return _orders(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells")))


def _orders(parts: DataFrame) -> DataFrame:
    """All orders and steps from the cells of a part (at most 32), by what passes each of the 32 sets of filters."""
    none = F.lit(0).cast("long")

    def passing(field: str) -> Column:
        clear = lambda s: F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0)
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.aggregate(clear(s), none, lambda total, c: total + c[field]))

    parts = parts.select("part", *(passing(f).alias(f) for f in ("n", "good", "bad")))
    at = lambda field, s: F.element_at(field, s + 1)
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    # orders in which the filter stands right after each set of others, as many as those of the set times those of the rest
    after = F.array(*(F.lit(factorial(b.bit_count()) * factorial(max(4 - b.bit_count(), 0))) for b in range(32)))
    others = lambda own: F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: b.bitwiseAND(own) == 0)
    share = lambda own: F.aggregate(others(own), none, lambda s, b: s + F.element_at("after", b + 1) * (at("n", b) - at("n", b + own)))
    parts = parts.withColumn("after", after)
    parts = parts.withColumn("shares", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: share(bit(k))))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    number = lambda letter: F.ascii(letter) - F.lit(ord(FILTERS[0]))
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("k", number(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", F.aggregate(earlier, F.lit(0), lambda s, x: s + bit(number(x))))
    own, before = bit(F.col("k")), F.col("before")
    lost = lambda field: at(field, before) - at(field, before + own)
    failing = at("n", F.lit(0)) - at("n", own)
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", before + own).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        (at("n", F.lit(31) - own) - at("n", F.lit(31))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("bad").alias("toxic_lost"),
        F.element_at("shares", F.col("k") + 1).alias("shapley"),
    )
