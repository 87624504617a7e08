"""Fill-in-middle transformation in Spark SQL functions.

A text is cut into units, a word with the white space before it (or white space
at the end); two cuts drawn from the hash of the document's id give prefix,
middle and suffix, which are laid out again between sentinels so that a model
that reads from left to right learns to fill gaps. Parsing the sentinels gives
the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, text_or_empty

SEED = 42
#: Percent of the texts that are rearranged, and percent of these that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SENTINELS = ("<P>", "<S>", "<M>")
#: Possessive, so that the match is linear on any text.
UNITS = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def _draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` plus n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    A text that is empty or holds a sentinel stays plain, and so do those that
    the draw leaves out; all others come out as ``<P>prefix<S>suffix<M>middle``
    (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). Sentinels must differ, and
    none may begin inside another.

    Everything is local to a row: no shuffle, whatever the keys. A null text
    counts as an empty one, a null id as an empty string of digits; repeated rows
    come out alike; a very long text is cut whole, in one array of its units;
    names that clash get a leading underscore; an empty table gives an empty result.
    """
    n, form, prefix_chars, middle_chars, output, units, draws, spans, parts = fresh(docs, "n", "form", "prefix_chars", "middle_chars", "output", "units", "draws", "spans", "parts")
    before, after, gap = (F.lit(s) for s in sentinels)
    text = text_or_empty(text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    cut = docs.withColumn(units, F.regexp_extract_all(text, F.lit(UNITS), 0)).withColumn(draws, F.array(*(_draw(digest, k) for k in range(4))))

    size, h = F.size(quoted(units)), quoted(draws)
    plain = (text == "") | F.contains(text, before) | F.contains(text, after) | F.contains(text, gap) | (h[2] % 100 >= rate)
    at = [(h[k] % (size + 1)).cast("int") for k in (0, 1)]
    cut = cut.withColumns({n: size.cast("long"), form: F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"), spans: F.struct(F.least(*at).alias("a"), F.greatest(*at).alias("b"))})

    a, b = quoted(spans)["a"], quoted(spans)["b"]
    joined = lambda start, length: F.array_join(F.slice(quoted(units), start, length), "")
    pieces = F.struct(joined(F.lit(1), a).alias("prefix"), joined(a + 1, b - a).alias("middle"), joined(b + 1, F.size(quoted(units)) - b).alias("suffix"))
    cut = cut.withColumn(parts, F.when(quoted(form) != "plain", pieces))
    p = quoted(parts)
    return cut.select(
        *(quoted(c) for c in docs.columns),
        quoted(n),
        quoted(form),
        F.length(p["prefix"]).cast("long").alias(prefix_chars),
        F.length(p["middle"]).cast("long").alias(middle_chars),
        F.when(quoted(form) == "psm", F.concat(before, p["prefix"], after, p["suffix"], gap, p["middle"]))
        .when(quoted(form) == "spm", F.concat(after, p["suffix"], before, p["prefix"], gap, p["middle"]))
        .otherwise(text)
        .alias(output),
    )


def restore(laid_out: DataFrame, *, form_col: str = "form", output_col: str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``laid_out`` plus ``restored``, the text that form and output stand for.

    Each sentinel is there once, so what lies before and after it is read by its
    place. A null form or output gives null; a name that clashes gets a leading
    underscore; an empty table gives an empty result.
    """
    (restored,) = fresh(laid_out, "restored")
    form, output = quoted(form_col), quoted(output_col)
    before, after, gap = sentinels
    head, middle = F.substring_index(output, gap, 1), F.substring_index(output, gap, -1)

    def two(opening: str, inner: str) -> tuple[Column, Column]:
        body = F.substr(head, F.lit(len(opening) + 1))
        return F.substring_index(body, inner, 1), F.substring_index(body, inner, -1)

    prefix_first, suffix_first = two(before, after), two(after, before)
    text = F.when(form == "psm", F.concat(prefix_first[0], middle, prefix_first[1])).when(form == "spm", F.concat(suffix_first[1], middle, suffix_first[0])).when(form == "plain", output)
    return laid_out.withColumn(restored, text)
