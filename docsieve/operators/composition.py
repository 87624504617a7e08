"""Composing packages: versions of what modules depend on, and packages that claim the same pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as T

from . import changes, graph

#: Beyond every page number.
WHOLE = 1 << 40


def dependency_issues(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(module, dependency, issue) of modules (module, version) and dependencies (module, dependency, wanted).

    invalid-version: the module's version is none. unresolved: no such module.
    mismatch: its version lies outside ``wanted``, or either is none. cycle: the module lies on a cycle
    or between two. A module is registered once; dependencies of unregistered modules are left out.
    """
    registered = modules.select("module", "version")
    none = F.lit(None).cast("string")
    invalid = registered.filter(T.semver(F.col("version")).isNull()).select("module", none.alias("dependency"), F.lit("invalid-version").alias("issue"))
    own = dependencies.join(registered.select("module"), "module", "left_semi")
    target = registered.select(F.col("module").alias("dependency"), F.col("version").alias("has"), F.lit(True).alias("known"))
    wanted = own.join(target, "dependency", "left").distinct()
    fits = F.coalesce(T.satisfies(F.col("has"), F.col("wanted")), F.lit(False))
    wrong = wanted.withColumn("issue", F.when(F.col("known").isNull(), "unresolved").when(~fits, "mismatch")).filter("issue IS NOT NULL")
    edges = wanted.filter("known").select(F.col("module").alias("src"), F.col("dependency").alias("dst"))
    cycle = graph.cyclic_nodes(edges).select(F.col("node").alias("module"), none.alias("dependency"), F.lit("cycle").alias("issue"))
    return invalid.unionByName(wrong.select("module", "dependency", "issue")).unionByName(cycle).distinct()


def contested_sources(sources: DataFrame) -> DataFrame:
    """(source, package, first_page, last_page): claims on pages that another package claims too.

    ``sources`` has these columns; a claim with a null page is of the whole source. Overlapping claims of
    a package are united first. Then no claim of the own package reaches one's pages, so that the furthest
    end before it and the nearest start after it tell of other packages, and no pairs are made.
    Rows without source or package are left out.
    """
    whole = F.col("first_page").isNull() | F.col("last_page").isNull()
    page = lambda c, other: F.when(whole, other).otherwise(F.col(c)).cast("long").alias(c)
    rows = sources.filter("source IS NOT NULL AND package IS NOT NULL").select("source", "package", page("first_page", -WHOLE), page("last_page", WHOLE))
    own = changes.merge_intervals(rows, ["source", "package"], "first_page", "last_page", gap=0)
    order = Window.partitionBy("source").orderBy("first", "last", "package")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("first")
    reaches = F.lead("first").over(order) <= F.col("last")
    marked = own.withColumn("contested", F.coalesce(reached, F.lit(False)) | F.coalesce(reaches, F.lit(False))).filter("contested")
    return marked.select("source", "package", F.nullif("first", F.lit(-WHOLE)).alias("first_page"), F.nullif("last", F.lit(WHOLE)).alias("last_page"))
