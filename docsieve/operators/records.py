"""Records of a compiled document: constructors, normal forms, assertions and their coverage, workpacks, snapshots as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import geometry as G
from docsieve.functions import text as T
from docsieve.operators import provenance as V


def compact_map(text: Column) -> Column:
    """Struct of ``compact``, a text without white space and hyphens, and ``pos``, where each of its characters stood."""
    chars = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] != "") & ~x["c"].rlike(r"(?U)^[\s\-]$"))
    return F.struct(F.array_join(F.transform(chars, lambda x: x["c"]), "").alias("compact"), F.transform(chars, lambda x: x["i"]).alias("pos"))


def allowed_form(folded: Column) -> Column:
    """A folded text with dashes unified, without white space and all but letters, digits, Han characters and signs of units."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "[–—]", "-"), r"(?U)\s+", ""), "[^0-9a-z㐀-鿿_+\\-./%μΩ]", "")


def numeric_tokens(values: Column) -> Column:
    """Typed numeric rows (value, unit) as ``value unit``, sorted by value and unit; rows without a value are passed over."""
    kept = F.filter(values, lambda v: v["value"].isNotNull())
    return F.transform(F.array_sort(F.transform(kept, lambda v: F.struct(v["value"].cast("string").alias("value"), F.coalesce(v["unit"], F.lit("")).alias("unit")))), lambda v: F.trim(F.concat_ws(" ", v["value"], v["unit"])))


def visual_id(page: Column, kind: Column, box: Column, label: Column) -> Column:
    """An id that the place, kind and label of an object fix; edges count to 6 places."""
    edges = {e: F.round(box[e], 6) for e in ("x0", "y0", "x1", "y1")}
    return T.keyed_id("visual", page=page, kind=kind, label=label, **edges)


def transform_receipt(dpi: Column, width: Column, height: Column) -> Column:
    """Scale from pixels to points and back, and the size in pixels, of a page rendered at ``dpi``."""
    return F.struct(F.round(F.lit(72.0) / dpi, 9).alias("scale"), F.round(dpi / F.lit(72.0), 9).alias("inverse"), F.ceil(width * dpi / 72).alias("pixel_width"), F.ceil(height * dpi / 72).alias("pixel_height"))


def candidate_rows(rows: DataFrame, kinds: dict[str, str], *, kind: str, default: str = "other") -> DataFrame:
    """``rows`` of a vendor in the common form: kind through a table, status forced to candidate, boxes that are none set to null."""
    table = F.create_map(*(F.lit(x) for p in kinds.items() for x in p))
    box = G.box("x0", "y0", "x1", "y1")
    good = G.is_valid(box)
    own = rows.withColumn(kind, F.coalesce(F.element_at(table, F.lower(kind)), F.lit(default))).withColumn("status", F.lit("candidate"))
    return own.withColumns({c: F.when(good, F.col(c)) for c in ("x0", "y0", "x1", "y1")})


def contained(small: DataFrame, large: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, id, n): rows whose canonical text lies in that of a row of the other side on their page."""
    form = lambda df, name: df.select(*keys, "id", T.canonical_text(T.fold(F.col(text))).alias(name))
    met = form(small, "a").join(form(large, "b").withColumnRenamed("id", "other"), keys).filter((F.col("a") != "") & F.contains("b", "a"))
    return met.groupBy(*keys, "id").agg(F.count("*").alias("n"))


def assertions(objects: DataFrame, proposals: DataFrame, *, key: str) -> DataFrame:
    """(key, kind, value, origin): the atomic assertions of each object's proposal, or of the object itself where it has none.

    Both have key and arrays statement, numeric, unit, assumption.
    """
    fields = ("statement", "numeric", "unit", "assumption")
    own = lambda df, origin: df.select(key, F.explode(F.concat(*(_tagged(f) for f in fields))).alias("x"), F.lit(origin).alias("origin"))
    fallback = objects.join(proposals.select(key), key, "left_anti")
    both = own(proposals, "proposal").unionByName(own(fallback, "object"))
    return both.select(key, "x.kind", "x.value", "origin")


def _tagged(field: str) -> Column:
    return F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda v: F.struct(F.lit(field).alias("kind"), v.alias("value")))


def assertion_coverage(made: DataFrame, supports: DataFrame, *, key: str) -> DataFrame:
    """(key, n, supported, status): how many of an object's assertions have a support: complete, partial or none."""
    known = supports.select(key, "kind", "value").distinct().withColumn("s", F.lit(1))
    out = made.select(key, "kind", "value").distinct().join(known, [key, "kind", "value"], "left").groupBy(key).agg(F.count("*").alias("n"), F.count("s").alias("supported"))
    return out.withColumn("status", F.when(F.col("supported") == F.col("n"), "complete").when(F.col("supported") > 0, "partial").otherwise("none"))


def draft_coverage(expected: DataFrame, present: DataFrame, group: str, key: str) -> DataFrame:
    """(group, present, expected, share): drafts that are there of those that are expected; others don't count."""
    there = present.select(key).distinct().withColumn("p", F.lit(1))
    out = expected.select(group, key).distinct().join(there, key, "left").groupBy(group).agg(F.count("p").alias("present"), F.count("*").alias("expected"))
    return out.withColumn("share", F.round(F.col("present") / F.col("expected"), 6))


def split_check(gold: DataFrame, predicted: DataFrame, split: str, item: str) -> DataFrame:
    """(split, n, missing, surplus, comparable): whether gold and predictions of a split have the same items; if not, nothing is scored."""
    both = gold.select(split, item).distinct().withColumn("g", F.lit(1)).join(predicted.select(split, item).distinct().withColumn("p", F.lit(1)), [split, item], "full_outer")
    out = both.groupBy(split).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("surplus"))
    return out.withColumn("comparable", (F.col("missing") == 0) & (F.col("surplus") == 0))


def auto_edges(rows: DataFrame, key: str, references: dict[str, str]) -> DataFrame:
    """(src, dst, relation): an edge for each reference column that isn't null, arrays included; relations by column."""
    kinds = dict(rows.dtypes)
    each = [_edges_of(c, r, kinds[c]) for c, r in references.items()]
    return rows.select(F.col(key).alias("src"), F.explode(F.concat(*each)).alias("x")).select("src", "x.dst", "x.relation").filter("dst IS NOT NULL").distinct()


def _edges_of(column: str, relation: str, kind: str) -> Column:
    values = F.coalesce(F.col(column), F.array().cast(kind)) if kind.startswith("array") else F.array(column)
    return F.transform(values, lambda v: F.struct(v.cast("string").alias("dst"), F.lit(relation).alias("relation")))


def snapshot(rows: DataFrame, key: str, kind: str, identity: list[str], evidence: list[str]) -> DataFrame:
    """(node, kind, identity_sha256, evidence_sha256, content_sha256): a record as a node with three hashes."""
    return rows.select(F.col(key).alias("node"), F.lit(kind).alias("kind"), V.record_hash(*identity).alias("identity_sha256"), V.record_hash(*evidence).alias("evidence_sha256"), V.record_hash(*identity, *evidence).alias("content_sha256"))


def source_merges(rows: DataFrame, source: str, first: str, last: str) -> DataFrame:
    """(source, first, last, n, state): page ranges of a source united where they meet; a source whose ranges leave a gap is rejected."""
    w = Window.partitionBy(source).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("gap", F.when(F.col(first) > before + 1, 1).otherwise(0))
    out = marked.groupBy(source).agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("n"), F.max("gap").alias("gap"))
    return out.select(source, "first", "last", "n", F.when(F.col("gap") == 1, "rejected").otherwise("merged").alias("state"))


def request_issues(requests: DataFrame, known: DataFrame, *, key: str) -> DataFrame:
    """(key, issue): scopes named twice or unknown, and facts given twice with other values.

    Requests have key, scope (array) and facts (array of name, value); ``known`` has scope.
    """
    scopes = requests.select(key, F.explode("scope").alias("scope"))
    twice = scopes.groupBy(key, "scope").count().filter("count > 1").select(key, F.concat(F.lit("scope_repeated:"), "scope").alias("issue"))
    unknown = scopes.join(known.select("scope").distinct(), "scope", "left_anti").select(key, F.concat(F.lit("scope_unknown:"), "scope").alias("issue")).distinct()
    facts = requests.select(key, F.inline("facts")).groupBy(key, "name").agg(F.count_distinct("value").alias("n")).filter("n > 1").select(key, F.concat(F.lit("fact_disputed:"), "name").alias("issue"))
    return twice.unionByName(unknown).unionByName(facts)


def workpack_units(pages: DataFrame, headings: DataFrame, book: str, *, most: int) -> DataFrame:
    """(book, unit, first_page, first_at, last_page, last_at, n_chars, state): from the end of each heading to the start of the next.

    Headings have unit (their order), page, at and length; pages page and text.
    The last unit ends with its book. A unit over ``most`` characters is oversize.
    """
    w = Window.partitionBy(book).orderBy("page")
    sized = pages.select(book, "page", F.length(F.coalesce("text", F.lit(""))).alias("n")).withColumn("base", F.sum("n").over(w) - F.col("n"))
    ends = sized.groupBy(book).agg(F.max(F.struct("page", "n", "base")).alias("end"))
    order = Window.partitionBy(book).orderBy("unit")
    placed = headings.join(sized.select(book, "page", "base"), [book, "page"]).withColumn("from", F.col("at") + F.col("length"))
    nexts = placed.withColumn("np", F.lead("page").over(order)).withColumn("na", F.lead("at").over(order)).withColumn("nb", F.lead("base").over(order)).join(ends, book)
    last_page, last_at = F.coalesce("np", "end.page"), F.coalesce("na", "end.n")
    n = F.coalesce(F.col("nb") + F.col("na"), F.col("end.base") + F.col("end.n")) - (F.col("base") + F.col("from"))
    state = F.when(n > most, "oversize").when(n <= 0, "empty").otherwise("ready")
    return nexts.select(book, "unit", F.col("page").alias("first_page"), F.col("from").alias("first_at"), last_page.alias("last_page"), last_at.alias("last_at"), n.alias("n_chars"), state.alias("state"))


def promoted(items: DataFrame, reviews: DataFrame, leaks: DataFrame, *, key: str, prefix: str) -> DataFrame:
    """(key, id): items that were reviewed, by accepting verdicts only, and that leak nothing, under ids of the package."""
    seen = reviews.groupBy(key).agg(F.bool_and(F.col("verdict") == "accepted").alias("good"))
    kept = items.join(seen.filter("good"), key, "left_semi").join(leaks.select(key).distinct(), key, "left_anti")
    return kept.select(key, T.keyed_id(prefix, item=F.col(key)).alias("id"))


def visual_index(routes: DataFrame, objects: DataFrame, charts: DataFrame) -> DataFrame:
    """(page, entry, ref): a flat index, two rows per route and object (by page and by kind), one per chart.

    Routes have page, route; objects page, id, kind; charts page, id.
    """
    by = lambda df, entry, ref: df.select("page", F.lit(entry).alias("entry"), ref.cast("string").alias("ref"))
    parts = [by(routes, "page", F.col("page")), by(routes, "route", F.col("route")), by(objects, "object", F.col("id")), by(objects, "kind", F.col("kind")), by(charts, "chart", F.col("id"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
