"""Planning a book: where its headings are, what each page and segment needs, which modules it makes.

Pages are rows (book, page, text), segments rows (book, segment, title,
first_page, last_page); both may be of any number of books.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as T

from . import graph

#: Scores of places of headings and the margin that decides (fixed values).
METHODS = {"normalized-exact": 80, "unicode-ligature-equivalent": 76, "dehyphenated-line-match": 72, "compact-token-boundary-match": 68}
BOUNDARIES = {"exact-line": 35, "line-boundary": 20, "substring": -12}
ROLES = {"body-heading": 30, "inline-heading-candidate": 0, "running-header": -80, "footer": -80, "body-text": -20}
MARGIN = 12
#: Titles that make no knowledge, and words of front matter (fixed values).
NO_KNOWLEDGE = r"(?i)\b(?:bibliography|references?|index|glossary|acknowledg(?:e)?ments?|contents|table of contents)\b"
FRONT_MATTER = r"(?i)\b(?:preface|foreword|dedication|copyright|contents|table of contents|acknowledg(?:e)?ments?)\b"


def _points(of: Column, table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for row in table.items() for x in row))[of]


def _page_lines(pages: DataFrame) -> DataFrame:
    """``pages`` plus raw (lines with a letter), folded and dense (without spaces and hyphens), and starts of the dense lines."""
    folded = F.regexp_replace(T.normalize_form(F.col("text"), fold=True), "[­\r]", "")
    both = F.arrays_zip(F.split("text", "\n").alias("raw"), F.split(F.regexp_replace(folded, "[‐-―−]", "-"), "\n").alias("folded"))
    lined = pages.select("book", "page", F.filter(both, lambda x: F.length(T.compact(x["folded"])) > 0).alias("lines"))
    lined = lined.select("book", "page", F.transform("lines", lambda x: T.collapse_space(x["raw"])).alias("raw"), F.transform("lines", lambda x: T.collapse_space(x["folded"])).alias("folded"))
    lined = lined.withColumn("dense", F.transform("folded", T.compact))
    add = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x)))
    return lined.withColumn("starts", F.aggregate("dense", F.array(F.lit(0)), add)).withColumn("whole", F.array_join("dense", ""))


def heading_candidates(pages: DataFrame, segments: DataFrame, *, before: int = 1, after: int = 2) -> DataFrame:
    """(book, segment, page, line, at, boundary, role, method, score): places where a segment's title may stand.

    Pages from ``before`` to ``after`` around the segment's first page are searched
    without regard to case, width, spaces, hyphens and line ends. ``at`` counts the
    characters before the place, spaces and hyphens left out; a title over several lines
    belongs to its first one. Null and empty titles and pages give none.
    """
    titled = segments.select("book", "segment", F.col("first_page").alias("outline"), T.collapse_space(F.col("title")).alias("title"), T.heading_form(F.col("title")).alias("folded_title"))
    titled = titled.withColumn("t", T.compact(F.col("folded_title"))).filter("t != ''")
    wanted = titled.withColumn("page", F.explode(F.sequence(F.col("outline") - before, F.col("outline") + after)))
    rows = wanted.join(_page_lines(pages), ["book", "page"]).filter(F.contains("whole", F.col("t")))
    # the pieces between the places; folded text has no \E that could end the quotation
    pieces = F.split("whole", F.concat(F.lit(r"\Q"), "t", F.lit(r"\E")), F.lit(-1))
    jump = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + F.length("t")))
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(0)), jump)
    rows = rows.withColumn("end", F.explode(F.slice(ends, 2, F.size(ends) - 1))).withColumn("at", F.col("end") - F.length("t"))
    line_of = lambda place: F.size(F.filter("starts", lambda s: s <= place)) - 1
    rows = rows.withColumn("line", line_of(F.col("at"))).withColumn("last", line_of(F.col("end") - 1))
    cut = lambda lines: F.array_join(F.slice(lines, F.col("line") + 1, F.col("last") - F.col("line") + 1), " ")
    rows = rows.withColumn("raw_text", cut("raw")).withColumn("text", cut("folded"))
    bare = F.regexp_replace(F.regexp_replace("text", r"^\d{1,4}(\s|\b)", ""), r"(\s|\b)\d{1,4}$", "")
    exact = (T.compact(F.col("text")) == F.col("t")) | (T.compact(bare) == F.col("t"))
    at_edge = (F.col("at") - F.get("starts", F.col("line")) <= 1) | (F.get("starts", F.col("last") + 1) - F.col("end") <= 1)
    rows = rows.withColumn("boundary", F.when(exact, "exact-line").when(at_edge, "line-boundary").otherwise("substring"))
    numbered = ~exact & (F.col("text").rlike(r"^\d{1,4}(\s|\b)") | F.col("text").rlike(r"(\s|\b)\d{1,4}$"))
    role = (
        F.when(numbered & (F.col("line") >= F.size("raw") - 2), "footer").when(numbered & (F.col("line") <= 1), "running-header")
        .when(exact, "body-heading").when(at_edge, "inline-heading-candidate").otherwise("body-text")
    )
    method = (
        F.when(F.contains("raw_text", F.col("title")), "normalized-exact").when(F.contains("text", F.col("folded_title")), "unicode-ligature-equivalent")
        .when(F.contains("text", F.lit("-")), "dehyphenated-line-match").otherwise("compact-token-boundary-match")
    )
    rows = rows.withColumn("role", role).withColumn("method", method)
    near = F.greatest(F.lit(-20), 20 - 8 * F.abs(F.col("page") - F.col("outline")))
    first = F.when((F.col("line") <= 1) & (F.col("role") == "body-heading"), 4).otherwise(0)
    score = _points(F.col("method"), METHODS) + _points(F.col("boundary"), BOUNDARIES) + _points(F.col("role"), ROLES) + near + first
    return rows.select("book", "segment", "page", "line", "at", "boundary", "role", "method", score.cast("int").alias("score"))


def resolve_headings(segments: DataFrame, found: DataFrame) -> DataFrame:
    """(book, segment, status, reason, page, line, margin), one row per segment.

    Running headers, footers and places within a line don't count. The best
    place is taken if it is the only one or leads by MARGIN points.
    """
    good = found.filter(~F.col("role").isin("running-header", "footer") & (F.col("boundary") != "substring"))
    order = Window.partitionBy("book", "segment").orderBy(F.desc("score"), "page", "at")
    best = good.withColumn("margin", F.col("score") - F.lead("score").over(order)).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    rows = segments.select("book", "segment").join(best.select("book", "segment", "page", "line", "margin"), ["book", "segment"], "left")
    reason = F.when(F.col("page").isNull(), "missing").when(F.col("margin").isNull(), "unique").when(F.col("margin") >= MARGIN, "margin").otherwise("ambiguous")
    rows = rows.withColumn("reason", reason)
    clear = F.col("reason").isin("unique", "margin")
    taken = lambda c: F.when(clear, F.col(c)).alias(c)
    return rows.select("book", "segment", F.when(clear, "resolved").otherwise("resolution-required").alias("status"), "reason", taken("page"), taken("line"), "margin")


def _covered(segments: DataFrame) -> DataFrame:
    return segments.filter("first_page <= last_page").select("book", "segment", F.explode(F.sequence("first_page", "last_page")).alias("page"))


def _short(least_chars: int) -> Column:
    return F.length(T.strip(F.coalesce("text", F.lit("")))) < least_chars


def page_plan(pages: DataFrame, segments: DataFrame, *, least_chars: int, visual: Column) -> DataFrame:
    """(book, page, status): ocr-candidate, visual-review, context-only, gap or compile.

    Pages with little text need OCR, those where ``visual`` holds a look; pages of no segment
    are context before the first segment and in front matter, else gaps.
    """
    of_segment = _covered(segments).select("book", "page").distinct().withColumn("covered", F.lit(True))
    first = segments.groupBy("book").agg(F.min("first_page").alias("begins"))
    rows = pages.withColumn("look", visual).join(of_segment, ["book", "page"], "left").join(first, "book", "left")
    context = F.col("begins").isNull() | (F.col("page") < F.col("begins")) | F.col("text").rlike(FRONT_MATTER)
    status = (
        F.when(_short(least_chars), "ocr-candidate").when(F.col("look"), "visual-review").when(F.col("covered"), "compile")
        .when(context, "context-only").otherwise("gap")
    )
    return rows.select("book", "page", status.alias("status"))


def segment_plan(pages: DataFrame, segments: DataFrame, resolved: DataFrame, *, least_chars: int, visual: Column) -> DataFrame:
    """(book, segment, status, promotion): from the segment's pages, its title and the status in ``resolved``."""
    flags = pages.select("book", "page", _short(least_chars).alias("short"), visual.alias("look"))
    own = _covered(segments).join(flags, ["book", "page"]).groupBy("book", "segment").agg(F.bool_or("short").alias("short"), F.bool_or("look").alias("look"))
    found = resolved.select("book", "segment", (F.col("status") == "resolved").alias("found"))
    rows = segments.select("book", "segment", "title").join(own, ["book", "segment"], "left").join(found, ["book", "segment"], "left")
    status = (
        F.when(F.col("short"), "ocr-candidate").when(~F.coalesce("found", F.lit(False)), "gap").when(F.col("look"), "visual-review")
        .when(F.col("title").rlike(NO_KNOWLEDGE), "non-knowledge").otherwise("compile")
    )
    promotion = F.when(status.isin("ocr-candidate", "visual-review"), "candidate-only").when(status == "gap", "blocked").otherwise("not-started")
    return rows.select("book", "segment", status.alias("status"), promotion.alias("promotion"))


def modules(pages: DataFrame, segments: DataFrame, *, chunk: int = 50) -> DataFrame:
    """(book, module, first_page, last_page, n_pages, n_segments): a module per outermost segment and its descendants.

    ``segments`` also has ``parent``, null at the top; a parent that is no segment makes a top of its own.
    Pages of no segment are gathered, ``chunk`` at a time, in modules context-0001 and on.
    """
    node = lambda c: F.to_json(F.struct(F.col("book").alias("b"), F.col(c).alias("s")))
    known = segments.select("book", F.col("segment").alias("parent"), F.lit(True).alias("known"))
    named = segments.join(known, ["book", "parent"], "left").select("book", "segment", "first_page", "last_page", node("segment").alias("node"), F.when(F.col("known"), node("parent")).alias("parent"))
    tops = named.join(graph.roots(named.select("node", "parent")).select("node", "root"), "node")
    tops = tops.join(named.select(F.col("node").alias("root"), F.col("segment").cast("string").alias("module")), "root", "left").withColumn("module", F.coalesce("module", F.col("segment").cast("string")))
    held = tops.select("book", "segment", "module").join(_covered(segments), ["book", "segment"]).join(pages.select("book", "page"), ["book", "page"])
    spans = held.groupBy("book", "module").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("n_pages"))
    counted = tops.groupBy("book", "module").agg(F.count("*").alias("n_segments")).join(spans, ["book", "module"], "left")
    left = pages.select("book", "page").join(_covered(segments), ["book", "page"], "left_anti")
    nth = F.floor((F.row_number().over(Window.partitionBy("book").orderBy("page")) - 1) / chunk) + 1
    context = left.withColumn("module", F.format_string("context-%04d", nth)).groupBy("book", "module")
    context = context.agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.lit(0).cast("long").alias("n_segments"))
    return counted.unionByName(context).select("book", "module", "first_page", "last_page", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "n_segments")
