"""Identities of records, citations of evidence, and what becomes of keyed records between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as T


def record_hash(*columns: str | Column) -> Column:
    """SHA-256 of columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def bind(rows: DataFrame, prefix: str, identity: list[str], content: list[str]) -> DataFrame:
    """``rows`` plus ``id``, which only ``identity`` fixes, and ``content_sha256`` over the id and ``content``."""
    own = rows.withColumn("id", T.keyed_id(prefix, **{c: F.col(c) for c in identity}))
    return own.withColumn("content_sha256", record_hash("id", *content))


def stable_key(keys: list[str], body: list[str]) -> Column:
    """The first of several candidate keys that is there and not empty, else one made of the content."""
    known = [F.when(F.col(k).cast("string") != "", F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]
    return F.coalesce(*known, F.concat(F.lit("anonymous:"), F.substring(record_hash(*body), 1, 24)))


def kind_of(kind: Column, aliases: dict[str, str], default: str) -> Column:
    """A kind's name in lower case with dashes, through an alias table."""
    plain = F.regexp_replace(F.lower(T.strip(kind)), "[_ ]+", "-")
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.element_at(table, plain), F.when(plain != "", plain), F.lit(default))


def inventory_diff(old: DataFrame, new: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(kind, id, change) of two tables (kind, id, ...): added, removed, changed or unchanged in the columns that aren't ``ignored``."""
    body = [c for c in old.columns if c not in ("kind", "id", *ignored)]
    side = lambda df, name: df.select("kind", "id", record_hash(*body).alias(name))
    both = side(old, "before").join(side(new, "after"), ["kind", "id"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return both.select("kind", "id", change.alias("change"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, change) of two sets of edges: added, removed or kept."""
    side = lambda df, name: df.select("src", "dst").distinct().withColumn(name, F.lit(True))
    both = side(old, "was").join(side(new, "now"), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept").alias("change"))


def set_fingerprint(rows: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """(keys, n_rows, fingerprint): the same for the same rows in any order.

    Hashes are gathered by their first two digits and each part is hashed, then
    the parts' hashes are, so that no task holds more than a 256th of a group.
    """
    own = rows.select(*keys, record_hash(*body).alias("h")).withColumn("part", F.substring("h", 1, 2))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = own.groupBy(*keys, "part").agg(F.count("*").alias("n"), digest("h").alias("d"))
    parts = parts.withColumn("d", F.concat("part", "d"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n_rows"), digest("d").alias("fingerprint"))


def overrides(rows: DataFrame, changes: DataFrame, key: str, value: str, before: str = "before_sha256") -> DataFrame:
    """(key, value, outcome): updates (key, before_sha256, value) of rows whose value still has the hash it is said to have.

    ``outcome`` is unchanged, applied, stale (another hash) or unknown (no such key).
    """
    new = changes.select(key, F.col(before).alias("b"), F.col(value).alias("n"), F.lit(True).alias("asked"))
    both = rows.select(key, F.col(value).alias("o"), F.lit(True).alias("there")).join(new, key, "full_outer")
    outcome = F.when(F.col("there").isNull(), "unknown").when(F.col("asked").isNull(), "unchanged").when(F.sha2("o", 256).eqNullSafe(F.col("b")), "applied").otherwise("stale")
    return both.withColumn("outcome", outcome).select(key, F.when(F.col("outcome") == "applied", F.col("n")).otherwise(F.col("o")).alias(value), "outcome")


def citations(references: DataFrame, objects: DataFrame, *, package: list[str], ref: str = "object_id", sha: str = "object_sha256") -> DataFrame:
    """``references`` plus ``state``: resolved, drift (another hash), missing, ambiguous (a key held twice).

    Objects have the package's columns, ``ref`` and ``sha``. Objects are
    counted per key before the join, so a repeated key makes no extra rows.
    """
    known = objects.groupBy(*package, ref).agg(F.count("*").alias("n_objects"), F.min(sha).alias("known_sha"))
    both = references.join(known, [*package, ref], "left")
    state = F.when(F.col("n_objects").isNull(), "missing").when(F.col("n_objects") > 1, "ambiguous").when(F.col(sha) != F.col("known_sha"), "drift").otherwise("resolved")
    return both.withColumn("state", state).drop("n_objects", "known_sha")


def evidence_refs(objects: DataFrame, anchors: DataFrame) -> DataFrame:
    """(object_id, evidence_id, source_ok): anchors that an object names and that name it back.

    Objects have id, evidence_ids, source_ids; anchors id, supports, source_id.
    ``source_ok`` tells whether the anchor's source is one of the object's.
    """
    named = objects.select(F.col("id").alias("object_id"), "source_ids", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    back = anchors.select(F.col("id").alias("evidence_id"), "source_id", F.explode(F.array_distinct("supports")).alias("object_id"))
    met = named.join(back, ["object_id", "evidence_id"])
    return met.select("object_id", "evidence_id", F.coalesce(F.array_contains("source_ids", F.col("source_id")), F.lit(False)).alias("source_ok"))


def span_checks(spans: DataFrame, pages: DataFrame, *, page: str, text: str, start: str = "start", end: str = "end", sha: str = "sha256") -> DataFrame:
    """``spans`` plus ``state``: verified, drift, outside (bounds beyond the page) or missing (no such page)."""
    both = spans.join(pages.select(page, F.col(text).alias("page_text")), page, "left")
    cut = F.sha2(F.substring("page_text", F.col(start) + 1, F.col(end) - F.col(start)), 256)
    fits = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.length("page_text"))
    state = F.when(F.col("page_text").isNull(), "missing").when(~fits, "outside").when(cut == F.col(sha), "verified").otherwise("drift")
    return both.withColumn("state", state).drop("page_text")


def focus_spans(ranges: DataFrame, pages: DataFrame, *, book: str, page: str, text: str) -> DataFrame:
    """(range_id, page, start, end, sha256): the pieces on each page of ranges from (first_page, first_at) to (last_page, last_at).

    Pieces are trimmed of white space; empty ones are left out.
    """
    on = ranges.select("*", F.explode(F.sequence("first_page", "last_page")).alias(page)).join(pages.select(book, page, F.col(text).alias("t")), [book, page])
    lo = F.when(F.col(page) == F.col("first_page"), F.col("first_at")).otherwise(0)
    hi = F.when(F.col(page) == F.col("last_page"), F.least("last_at", F.length("t"))).otherwise(F.length("t"))
    raw = on.withColumn("lo", lo).withColumn("raw", F.substring("t", lo + 1, F.greatest(hi - lo, F.lit(0))))
    body = T.strip(F.col("raw"))
    start = F.col("lo") + F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    return raw.filter(body != "").select("range_id", book, page, start.cast("int").alias("start"), (start + F.length(body)).cast("int").alias("end"), F.sha2(body, 256).alias("sha256"))


def context_windows(pages: DataFrame, *, book: str, page: str, text: str, characters: int) -> DataFrame:
    """(book, page, before, after): the last characters of the page before and the first of the page after ('' at the ends)."""
    w = Window.partitionBy(book).orderBy(page)
    tail = F.coalesce(F.right(F.lag(text).over(w), F.lit(characters)), F.lit(""))
    head = F.coalesce(F.left(F.lead(text).over(w), F.lit(characters)), F.lit(""))
    return pages.select(book, page, tail.alias("before"), head.alias("after"))


def coverage(expected: DataFrame, actual: DataFrame, key: str, body: list[str]) -> DataFrame:
    """(key, state): what was expected against what is there: equal, different, missing, surplus or repeated."""
    left = expected.select(key, record_hash(*body).alias("e"))
    right = actual.groupBy(key).agg(F.count("*").alias("n"), F.min(record_hash(*body)).alias("a"))
    both = left.join(right, key, "full_outer")
    state = F.when(F.col("e").isNull(), "surplus").when(F.col("a").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("a") == F.col("e"), "equal").otherwise("different")
    return both.select(key, state.alias("state"))


def canonical_field(value: Column) -> Column:
    """A reviewed text with line ends unified, lines trimmed and white space inside lines collapsed."""
    lines = F.split(F.regexp_replace(value, r"\r\n?", "\n"), "\n")
    return T.strip(F.array_join(F.transform(lines, lambda x: T.strip(F.regexp_replace(x, r"(?U)[^\S\n]+", " "))), "\n"))


def field_disputes(left: DataFrame, right: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """(item, field, state): two reviewers' fields: same, eliminated (equal in canonical form) or substantive; a null differs from a text."""
    pairs = left.select(item, F.struct(*fields).alias("l")).join(right.select(item, F.struct(*fields).alias("r")), item)

    def one(f: str) -> Column:
        a, b = F.col(f"l.{f}"), F.col(f"r.{f}")
        state = F.when(a.eqNullSafe(b), "same").when(canonical_field(a) == canonical_field(b), "eliminated").otherwise("substantive")
        return F.struct(F.lit(f).alias("field"), state.alias("state"))

    return pairs.select(item, F.inline(F.array(*map(one, fields))))


def blanket_reviews(reviews: DataFrame, reviewer: str, rationale: str) -> DataFrame:
    """(reviewer, n_reviews): reviewers with two reviews or more who give one and the same rationale throughout."""
    return reviews.groupBy(reviewer).agg(F.count("*").alias("n_reviews"), F.count_distinct(rationale).alias("n")).filter("n_reviews >= 2 AND n < 2").drop("n")


def assigned(items: DataFrame, reviewers: list[str], required: int, item: str) -> DataFrame:
    """(item, reviewer): every item goes to the first ``required`` reviewers in sorted order."""
    return items.select(item, F.explode(F.array(*map(F.lit, sorted(reviewers)[:required]))).alias("reviewer"))


def page_scope_conflicts(scopes: DataFrame) -> DataFrame:
    """(source, issue, n): sources that several packages claim with overlapping pages, or under other hashes.

    Rows are (package, source, sha256, first_page, last_page). One window pass; no pairs are made.
    """
    order = Window.partitionBy("source").orderBy("first_page", "last_page", "package")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("last_page", "package")).over(before)
    # the farthest end of the packages before, and of those that are not this row's own
    marked = scopes.withColumn("reach", reach).withColumn("overlap", (F.col("first_page") <= F.col("reach.last_page")) & (F.col("reach.package") != F.col("package")))
    found = marked.groupBy("source").agg(F.count_if("overlap").alias("overlaps"), F.count_distinct("sha256").alias("hashes"))
    issues = F.array_compact(F.array(F.when(F.col("overlaps") > 0, F.struct(F.lit("overlap").alias("issue"), F.col("overlaps").alias("n"))), F.when(F.col("hashes") > 1, F.struct(F.lit("hash").alias("issue"), F.col("hashes").alias("n")))))
    return found.select("source", F.inline(issues))
