"""Outlines as nested JSON, flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators import graph


def flattened(rows: DataFrame, key: str, text: str, *, children: str = "items", title: str = "title", page: str = "page") -> DataFrame:
    """(key, idx, depth, parent_idx, title, page) of outlines of any depth, in reading order, idx from 0.

    The text is an array of entries, each with title, page and an array of
    entries below. One level is taken apart at a time until none has a level
    below; entries that are no objects are passed over with what is below them,
    and texts that are no arrays give no rows.
    """
    explode = rows.sparkSession.tvf.variant_explode
    level = rows.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("place"), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>").isNotNull().alias("good"), F.try_parse_json(text).alias("v"))
    level = level.filter("good").select("k", "place", "v")
    done, found = [], True
    while found:
        inner = level.lateralJoin(explode(F.col("v").outer()))
        entries = inner.filter(F.schema_of_variant("value").startswith("OBJECT")).select(
            "k",
            F.concat("place", F.array("pos")).alias("place"),
            F.try_variant_get("value", f"$.{title}", "string").alias("title"),
            F.try_variant_get("value", f"$.{page}", "int").alias("page"),
            F.try_variant_get("value", f"$.{children}", "variant").alias("v"),
        )
        entries = graph.cut(entries)
        done.append(entries.drop("v"))
        level = entries.filter(F.schema_of_variant("v").startswith("ARRAY<")).select("k", "place", "v")
        found = not level.isEmpty()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    numbered = graph.cut(out.withColumn("idx", (F.row_number().over(Window.partitionBy("k").orderBy("place")) - 1).cast("int")))
    parents = numbered.select("k", F.col("place").alias("up"), F.col("idx").alias("parent_idx"))
    above = numbered.withColumn("up", F.slice("place", 1, F.size("place") - 1))
    return above.join(parents, ["k", "up"], "left").select(F.col("k").alias(key), "idx", (F.size("place") - 1).alias("depth"), "parent_idx", "title", "page")
