"""Quality rules with adaptive thresholds.

Signals of each document are integers. Their distribution per language and
source is kept in a mergeable quantile sketch: counts of exponentially growing
bins (128 to each power of two, so a quantile is at most 1/128 too low). Merging
is adding counts, whatever the order, so the thresholds are the same on every
cluster. A document is rejected where a signal lies beyond its group's cut:
outside the quartiles by a multiple of their range, or above the lowest value
whose tail (the rows above it) has a median many times as large, which is what
tells the odd ones of a signal that is zero nearly everywhere. The cuts of a
group are drawn to those of its language, and these to those of the whole
corpus, the more the fewer rows it has. No cut is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, text_or_empty

#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Symbols that count as noise.
SYMBOLS = b"#*$%&|<>"
#: Bins to each power of two.
BIN_BITS = 7
#: Rows of its own at which a group's cut counts as much as that of the level above.
HALF_ROWS = 50
#: A cut lies so many quartile ranges outside the quartiles, or below a tail whose median is so many times what it starts at.
RANGES, FAR = 3, 256
#: Signals per word: name, counted field, scale, whether low values count too.
SIGNALS = (
    ("word_length", "word_chars", 100, True),
    ("symbols", "n_symbols", 1000, False),
    ("dup_lines", "n_dup_lines", 1000, False),
    ("repeats", "n_repeat_words", 1000, False),
)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more.

    Windows meet by a 64-bit hash of their words' numbers; where two hashes
    agree, the windows themselves are compared.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, dtype=bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    seen: dict[bytes, int] = {}
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for i in np.flatnonzero(twin).tolist():
        first = seen.setdefault(ids[i : i + window].tobytes(), i)
        if first != i:
            for at in (first, i):
                cover[at] += 1
                cover[at + window] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def signal_values(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()  # bytes.split cuts at exactly 20 and 09 to 0D
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else []
    return len(words), int(np.count_nonzero((letters & 0xC0) != 0x80)), int(np.count_nonzero(_SYMBOL[letters])), len(lines) - len(set(lines)), repeated_words(words)


def signals(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct ``signals`` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null text counts as an empty one; a name that clashes gets a leading underscore.
    """
    (name,) = fresh(docs, "signals")

    @F.pandas_udf(", ".join(f"{f} long" for f in FIELDS))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([signal_values(t) for t in texts], columns=list(FIELDS), dtype="int64")

    return docs.withColumn(name, measure(text_or_empty(text_col)))


def per_word(s: Column, field: str, scale: int) -> Column:
    return F.floor(scale * s[field] / F.greatest(s["n_words"], F.lit(1))).cast("long")


def bin_of(value: Column) -> Column:
    """Lower bound of the sketch bin of an integer from 0 on."""
    step = F.greatest(F.length(F.bin(value)) - (BIN_BITS + 1), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value.cast("long"), step), step)


def sketch(rows: DataFrame, keys: list[str], signals_col: str = "signals") -> DataFrame:
    """Sketches as rows (keys, signal, bin, n)."""
    s = quoted(signals_col)
    values = F.array(*(F.struct(F.lit(name).alias("signal"), bin_of(per_word(s, field, scale)).alias("bin")) for name, field, scale, _ in SIGNALS))
    return rows.select(*keys, F.explode(values).alias("x")).groupBy(*keys, "x.signal", "x.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))


def cuts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, signal, rows, low, high); a cut that the values don't show is null.

    A value a from the third quartile on counts as the end of the usual ones if
    the median of the rows above it is at least FAR times a + 1; the cut is the
    geometric middle. It depends on quantiles alone: rows that come to lie
    between a and FAR times a + 1 leave the cut where it is as long as they are
    no more than those beyond.
    """
    group = Window.partitionBy(*keys, "signal")
    order = group.orderBy("bin")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketches.withColumn("upto", upto).withColumn("rows", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bin")))
    cells = F.sort_array(F.collect_list(F.struct("bin", "n", (F.col("rows") - F.col("upto")).alias("tail"))))  # a cell a bin
    found = ranked.groupBy(*keys, "signal").agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"), cells.alias("cells"))
    beyond = lambda a: F.aggregate("cells", F.lit(0).cast("long"), lambda s, b: s + F.when(b["bin"] + 1 >= FAR * (a["bin"] + 1), b["n"]).otherwise(F.lit(0)))
    ends = F.filter("cells", lambda a: (a["bin"] >= F.col("q3")) & (a["tail"] > 0) & (2 * beyond(a) >= a["tail"]))
    tail = F.try_element_at(ends, F.lit(1))["bin"]
    wide = F.when(F.col("q3") > F.col("q1"), RANGES * (F.col("q3") - F.col("q1")))
    both = F.col("signal").isin([name for name, _, _, low in SIGNALS if low])
    return found.select(
        *keys,
        "signal",
        "rows",
        F.when(both, F.col("q1") - wide).cast("double").alias("low"),
        F.least((F.col("q3") + wide).cast("double"), (tail + 1) * F.sqrt(F.lit(float(FAR)))).alias("high"),
    )


def drawn(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` cuts drawn to those of the level ``above``, which has the columns ``keys``; a null cut gives way."""
    same = F.col("o.signal") == F.col("a.signal")
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"a.{k}"))
    weight = F.col("o.rows") / (F.col("o.rows") + HALF_ROWS)
    to = lambda c: F.coalesce(weight * F.col(f"o.{c}") + (1 - weight) * F.col(f"a.{c}"), F.col(f"o.{c}"), F.col(f"a.{c}")).alias(c)
    rest = [F.col(f"o.{c}") for c in own.columns if c not in ("low", "high")]
    return own.alias("o").join(above.alias("a"), same, "left").select(*rest, to("low"), to("high"))


def judge(measured: DataFrame, *, signals_col: str = "signals", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of :func:`signals` with FIELDS, base_failed and kept in place of the struct.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated
    8-word windows. The sketches cover every document that passes the base
    rules. Null languages and sources are groups like any other; null and empty
    texts fail the base rules; new names that clash get a leading underscore;
    an empty table gives an empty result. A text of any length is measured whole,
    and repeated rows count each by itself. ``measured`` is read twice, so write
    it out first (``materialize``) where measuring is dear.
    """
    rest = [c for c in measured.columns if c != signals_col]
    names = fresh(measured.select(*(quoted(c) for c in rest)), *FIELDS, "base_failed", "kept")
    lang, source, rule = fresh(measured, "k_lang", "k_source", "rule")
    s = quoted(signals_col)
    failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])

    passed = measured.filter(~failed).select(quoted(lang_col).alias("lang"), quoted(source_col).alias("source"), s.alias("signals"))
    by_source = sketch(passed, ["lang", "source"])
    by_lang = merge(by_source, ["lang"])
    per_lang = drawn(cuts(by_lang, ["lang"]), cuts(merge(by_lang, []), []), [])
    per_source = drawn(cuts(by_source, ["lang", "source"]), per_lang, ["lang"])
    rules = per_source.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("low", "high")))).alias(rule))
    rules = rules.select(F.col("lang").alias(lang), F.col("source").alias(source), rule)

    judged = measured.join(rules, quoted(lang_col).eqNullSafe(F.col(lang)) & quoted(source_col).eqNullSafe(F.col(source)), "left")
    good = F.lit(True)
    for name, field, scale, _ in SIGNALS:
        cut, value = F.element_at(F.col(rule), name), per_word(s, field, scale)
        good = good & F.coalesce(value <= cut["high"], F.lit(True)) & F.coalesce(value >= cut["low"], F.lit(True))
    fields = [s[f].alias(n) for f, n in zip(FIELDS, names, strict=False)]
    return judged.select(*(quoted(c) for c in rest), *fields, failed.alias(names[5]), (~failed & good).alias(names[6]))
