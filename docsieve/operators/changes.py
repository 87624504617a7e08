"""Comparing and merging versions of keyed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by a hash over ``content``; one shuffle per side."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(old, "before").join(digest(new, "after"), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def insert_only(base: DataFrame, additions: DataFrame, key: str) -> DataFrame:
    """``base`` and the rows that ``additions`` has new; ``outcome`` tells kept, added, same or collision.

    Collisions (a key with other content) keep the base's row and are marked.
    """
    body = [c for c in base.columns if c != key]
    left, right = base.withColumn("l", F.struct(*body)), additions.withColumn("r", F.struct(*body))
    both = left.select(key, "l").join(right.select(key, "r"), key, "full_outer")
    outcome = F.when(F.col("r").isNull(), "kept").when(F.col("l").isNull(), "added").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("collision")
    return both.select(key, F.coalesce("l", "r").alias("x"), outcome.alias("outcome")).select(key, "x.*", "outcome")


def merge_sets(rows: DataFrame, key: str, members: str, body: list[str]) -> DataFrame:
    """(key, members, n_bodies): rows of a key united; ``n_bodies`` over 1 marks records that don't agree."""
    return rows.select(key, F.explode_outer(members).alias("m"), F.xxhash64(*body).alias("b")).groupBy(key).agg(F.array_sort(F.collect_set("m")).alias(members), F.count_distinct("b").alias("n_bodies"))


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, *, gap: int = 1) -> DataFrame:
    """(keys, first, last, n_parts): closed integer intervals of a key united where at most ``gap`` lies between them."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("opens", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n_parts")).drop("island")


def overlapping(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose interval overlaps an earlier one of their key, from a running maximum rather than from pairs."""
    order = Window.partitionBy(*keys).orderBy(start, end, *[c for c in rows.columns if c not in (*keys, start, end)])
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("reaches", before).filter(F.col(start) <= F.col("reaches"))


def leaking_groups(rows: DataFrame, group: list[str], split: str) -> DataFrame:
    """Groups that span several splits."""
    return rows.groupBy(*group).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).filter("n_splits > 1")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def reviewer_coverage(items: DataFrame, reviews: DataFrame, *, item: str, reviewer: str, verdict: str, required: int) -> DataFrame:
    """(item, n_reviews, n_reviewers, lead, state): exactly ``required`` reviews by as many reviewers, all of one verdict."""
    by_item = reviews.groupBy(item).agg(
        F.count("*").alias("n_reviews"), F.count_distinct(reviewer).alias("n_reviewers"), F.count_distinct(verdict).alias("n_verdicts"), F.min(reviewer).alias("lead"), F.min(verdict).alias("verdict")
    )
    n = F.coalesce("n_reviews", F.lit(0))
    state = (
        F.when(n == 0, "missing").when(n < required, "incomplete").when((n > required) | (F.col("n_reviewers") != n), "surplus")
        .when(F.col("n_verdicts") > 1, "disputed").otherwise(F.col("verdict"))
    )
    return items.select(item).distinct().join(by_item, item, "left").select(item, n.alias("n_reviews"), F.coalesce("n_reviewers", F.lit(0)).alias("n_reviewers"), "lead", state.alias("state"))
