"""Text normalization, tokens and identities as Columns."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that lexical search passes over (fixed values).
STOPWORDS = "a an and are as at be by can does for from give how in is it of on or that the their this to use what when which why with".split()
#: What counts as a term: ASCII words with underscores inside, or a run of Han characters (fixed value).
TERM = "[a-z0-9]+(?:_[a-z0-9]+)*|[\u3400-\u4dbf\u4e00-\u9fff]+"
#: Runs of these scripts are tokenized by character n-grams.
CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"


def normalize_form(text: Column, form: str = "NFKC", *, fold: bool = False) -> Column:
    """Unicode normalization (and case folding), which Spark has no function for."""

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize(form, t.casefold() if fold else t))

    return normal(text)


def fold(text: Column) -> Column:
    """Case-folded text; ASCII texts don't go through Python."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else t.casefold())

    return F.coalesce(folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def wide_fold(text: Column) -> Column:
    """NFKC, case-folded; ASCII texts don't go through Python."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return F.coalesce(folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def search_form(text: Column) -> Column:
    """NFKC, case-folded, with the marks of formulas as white space and that collapsed: the form that titles are found in."""
    return collapse_space(F.regexp_replace(wide_fold(text), r"[\\{}^]", " "))


def canonical_text(text: Column) -> Column:
    """NFKC with white space collapsed and trimmed: the form that offsets refer to."""
    return collapse_space(normalize_form(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def metric_text(text: Column) -> Column:
    """NFC with newlines unified and white space stripped; case and width stay."""
    return normalize_form(strip(F.regexp_replace(text, r"\r\n?", "\n")), "NFC")


def heading_form(text: Column) -> Column:
    """Headings compare without case, width, soft hyphens and kinds of dash."""
    folded = normalize_form(text, fold=True)
    return collapse_space(F.regexp_replace(F.regexp_replace(folded, "­", ""), "[‐-―−]", "-"))


def compact(text: Column) -> Column:
    """Without spaces and hyphens."""
    return F.regexp_replace(text, r"(?U)[\s\-]", "")


def terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """Terms of two characters or more without stopwords, repeats kept: words, words joined by underscores, runs of Han characters."""
    stop = F.array(*(F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)))
    found = F.regexp_extract_all(wide_fold(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def term_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(terms(text)))


def cjk_stream(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{CJK}]", "")


def char_ngrams(text: Column, n: int | Column) -> Column:
    """All character n-grams of a text (none for shorter texts)."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def word_ngrams(words: Column, n: int) -> Column:
    """All n-word windows of an array of words, space-joined."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def verbatim_forms(text: Column) -> Column:
    """Struct of ``words``, the case-folded text, and ``cjk``, the CJK characters of its NFKC form.

    ASCII texts, whose forms are the lower-case text and nothing, don't go through Python.
    """

    @F.pandas_udf("words string, cjk string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        other = re.compile(f"[^{CJK}\\uf900-\\ufaff]+")
        for texts in batches:
            rows = [(None, None) if t is None else (t.casefold(), other.sub("", unicodedata.normalize("NFKC", t))) for t in texts]
            yield pd.DataFrame(rows, columns=["words", "cjk"], dtype="object")

    made = forms(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    return F.struct(F.coalesce(made["words"], F.lower(text), F.lit("")).alias("words"), F.coalesce(made["cjk"], F.lit("")).alias("cjk"))


def plain_forms(text: Column) -> Column:
    """Struct like that of :func:`verbatim_forms` of the text as it is: ``words`` in lower case, each character by itself,
    and ``cjk``, its characters of the ranges 3040-30FF, 3400-4DBF and 4E00-FAFF. Case isn't folded, width stays."""
    lower = F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))
    cjk = F.regexp_replace(text, "[^\u3040-\u30ff\u3400-\u4dbf\u4e00-\ufaff]", "")
    return F.struct(F.coalesce(lower, F.lit("")).alias("words"), F.coalesce(cjk, F.lit("")).alias("cjk"))


def natural_tokens(text: Column) -> Column:
    """Distinct words that start with a letter, and the bigrams and trigrams of each run of Han characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9-]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[\u3400-\u9fff]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(char_ngrams(r, 2), char_ngrams(r, 3))))
    return F.array_sort(F.array_distinct(F.concat(words, grams)))


def math_tokens(text: Column) -> Column:
    """Distinct glyphs of formulas, case and primes kept: TeX commands, and single Latin, Greek or mathematical letters with their marks and indices."""
    letter = "[A-Za-z]|[\u0370-\u03ff]|[\U0001d400-\U0001d7ff]"
    marks = r"(?:_\{[A-Za-z0-9,+-]{1,64}\}|_[A-Za-z0-9]+|[\u2080-\u2089]|[\u0300-\u036f\u20d0-\u20ff])*['\u2032\u2033]*"
    pattern = r"\\(?:mathbf|boldsymbol|vec)\{[^{}\s]{1,64}\}|\\[A-Za-z]+|(?U:(?<!\w)(?:" + letter + ")" + marks + r"(?!\w))"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def composite_tokens(folded: Column) -> Column:
    """Distinct words of a text (underscores inside), and the bigrams of all its Han characters in a row.

    ``folded`` is a column that has been through :func:`wide_fold`.
    """
    stream = F.regexp_replace(folded, "[^\u3400-\u9fff]", "")
    return F.array_distinct(F.concat(F.regexp_extract_all(folded, F.lit("[a-z0-9_]+"), F.lit(0)), char_ngrams(stream, 2)))


#: Words that a surface phrase is built without, and words that no part of one may have (fixed values).
SURFACE_STOPWORDS = "a an and are as at be by can for from in is it of on or the to with within".split()
SURFACE_GENERIC = "field magnetic device concept system operation problem discussion source section context candidate current".split()


def surface_forms(folded: Column) -> Column:
    """Phrases that name a concept: a whole form with Han characters, or the Latin words together and by twos and threes.

    A phrase of several words isn't broken into single words; a single word counts from four letters on.
    ``folded`` is a column that has been through :func:`wide_fold`.
    """
    folded = collapse_space(F.regexp_replace(folded, "[\u2013\u2014]", "-"))
    has_han = folded.rlike("[\u3400-\u9fff]")
    han = F.when(F.length(F.regexp_replace(folded, "[^\u3400-\u9fff]", "")) >= 2, F.array(F.regexp_replace(folded, "[^0-9a-z\u3400-\u9fff_+\\-./%\u03bc\u03a9]", "")))
    lit = lambda words: F.array(*map(F.lit, words))
    words = F.filter(F.regexp_extract_all(folded, F.lit(r"[a-z][a-z0-9_+\-]*"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(lit(SURFACE_STOPWORDS), w))
    own = lambda n: F.filter(word_ngrams(words, n), lambda p: ~F.arrays_overlap(F.split(p, " "), lit(SURFACE_GENERIC)))
    one = F.filter(words, lambda w: (F.size(words) == 1) & (F.length(w) >= 4) & ~F.array_contains(lit(SURFACE_GENERIC), w))
    latin = F.when(F.size(words) > 0, F.concat(F.array(F.array_join(words, " ")), own(2), own(3), one))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(F.when(has_han, F.coalesce(han, none)).otherwise(latin), none)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets to 6 places; 0 where one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 6))


def first_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(found != "", found)


def join_fragments(fragments: Column) -> Column:
    """Texts in order; a space goes only between two ASCII letters or digits, or where there was white space."""

    def add(left: Column, right: Column) -> Column:
        spaced = left.rlike(r"\s$") | right.rlike(r"^\s") | (left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]"))
        return F.when(left == "", right).when(spaced, F.concat(F.rtrim(left), F.lit(" "), F.ltrim(right))).otherwise(F.concat(left, right))

    return F.aggregate(fragments, F.lit(""), add)


def is_caption_prefix(text: Column) -> Column:
    """Whether a text is nothing but the word that opens a caption (the pattern is a fixed value)."""
    return text.rlike(r"(?i)^\s*(?:figure|fig(?:ure)?\.?|图|table|tab(?:le)?\.?|表|equation|eq(?:uation)?\.?|式)\s*$")


def text_lines(text: Column) -> Column:
    """Lines without white space at their ends; empty ones are left out."""
    return F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")


def table_like_lines(text: Column) -> Column:
    """Lines that fall into three cells or more at pipes, tabs or runs of white space."""
    return F.size(F.filter(text_lines(text), lambda x: F.size(F.split(x, r"(?U)\s{2,}|\t|\|")) >= 3))


def printed_page_label(text: Column) -> Column:
    """A page number of up to three digits in the first or last five lines (null: none).

    In this order: alone in one of the last lines, from the end; before other
    text in one of the first; after other text in one of the first; after other
    text in one of the last.
    """
    lines = text_lines(text)
    first, last = F.slice(lines, 1, 5), F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5)
    found = lambda part, pattern: F.get(F.filter(F.transform(part, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), 0)
    after = r"(?U)\D\s+(\d{1,3})$"
    return F.coalesce(found(F.reverse(last), r"(?U)^(\d{1,3})$"), found(first, r"(?U)^(\d{1,3})\s+\D"), found(first, after), found(last, after))


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """``prefix-`` and the first hex digits of the SHA-256 of the parts in search case and form, set apart by U+001F."""
    form = lambda p: fold(collapse_space(wide_form(F.coalesce(p.cast("string"), F.lit("")))))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *map(form, parts)), 256), 1, length))


def wide_form(text: Column) -> Column:
    """NFKC; ASCII texts don't go through Python."""
    return F.coalesce(normalize_form(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def keyed_id(prefix: str, **parts: Column) -> Column:
    """``prefix-`` and 24 hex digits of the SHA-256 of the parts as JSON with sorted keys, nulls kept."""
    body = F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(body, 256), 1, 24))


def canonical_json(value: Column) -> Column:
    """JSON text with sorted keys, no spaces, nulls kept and no NaN, from JSON text (null where that is invalid)."""

    @F.pandas_udf("string")
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return json.dumps(json.loads(text, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            except (TypeError, ValueError):
                return None

        for texts in batches:
            yield texts.map(one)

    return canonical(value)


def _refuse(name: str):
    raise ValueError(name)


def row_hash(*columns: str) -> Column:
    """SHA-256 over columns; nulls differ from every value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def semver(text: Column) -> Column:
    """(major, minor, patch), which compare like versions; null where the text is none."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)\.([0-9]+)$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).cast("int").alias("patch")))


def satisfies(version: Column, wanted: Column) -> Column:
    """Whether a version lies in a range: ``*``, ``^1.2.3``, ``~1.2.3``, ``=1.2.3``, comparisons joined by spaces."""
    v = semver(version)

    def bound(text: Column, rule: str) -> Column:
        b = semver(F.regexp_replace(text, r"^[\^~<>=]+", ""))
        major = F.struct((b["major"] + 1).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch"))
        minor = F.struct(b["major"].alias("major"), (b["minor"] + 1).alias("minor"), F.lit(0).alias("patch"))
        patch = F.struct(b["major"].alias("major"), b["minor"].alias("minor"), (b["patch"] + 1).alias("patch"))
        caret = F.when(b["major"] > 0, major).when(b["minor"] > 0, minor).otherwise(patch)
        return {"^": (v >= b) & (v < caret), "~": (v >= b) & (v < minor), ">=": v >= b, "<=": v <= b, ">": v > b, "<": v < b, "=": v == b}[rule]

    def one(text: Column) -> Column:
        out = F.when(text == "*", F.lit(True))
        for rule in ("^", "~", ">=", "<=", ">", "<", "="):
            out = out.when(text.startswith(rule), bound(text, rule))
        return F.coalesce(out.otherwise(bound(text, "=")), F.lit(False))

    return v.isNotNull() & F.forall(F.split(F.trim(wanted), r"\s+"), one)


def edit_distance_words(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words (``levenshtein`` does it for characters)."""

    @F.pandas_udf("int")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([_distance(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="int32")

    return distance(a, b)


def _distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
