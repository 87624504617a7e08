"""Typed dependency graphs as tables of edges (src, dst, ...): reach, roots, cycles and integrity.

Loops run over joins; each round's small change is written to the shared folder
(``spark.checkpoint.dir``), so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows from which a written table isn't sent whole to all executors, however small its files are.
MOST_SENT = 100_000
#: The temporary folder of a session in one process that names no shared one.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` that driver and executors share.

    Where that is unset, a session in one process (tests) gets a temporary
    folder; a cluster, whose machines would not share it, gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="docsieve-"))
        folder = _own[0]
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, read again: one pass, and files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node, hops): nodes within ``max_hops`` of each seed (None: all it reaches), the seed itself at 0, by the fewest hops.

    ``seeds`` has one column, node. Each hop joins only the nodes new in the last one.
    """
    links = cut(edges.select("src", "dst").distinct())
    found = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).distinct())
    last, hop = found, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = last.join(links, last["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        last = cut(step.join(found, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if max_hops is None and last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops): nodes that any of the seeds reaches along edges, by the fewest hops from the nearest.

    One row for a node, whatever the number of seeds; as many joins as hops.
    Spark takes the size of files for that of their rows, and packed columns make
    them small, so tables of over MOST_SENT rows ask for merge joins.
    """
    sized = lambda df, n: df.hint("merge") if n > MOST_SENT else df
    links = cut(edges.select("src", "dst").distinct())
    last = cut(seeds.select("node", F.lit(0).alias("hops")).distinct())
    found, hop = last, 0
    n_last = n_found = last.count()
    while n_last:
        hop += 1
        step = links.join(sized(last.select(F.col("node").alias("src")), n_last), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        last = cut(step.join(sized(found, n_found), "node", "left_anti").withColumn("hops", F.lit(hop)))
        found, n_last = found.unionByName(last), last.count()
        n_found += n_last
    return found


def shortest_paths(edges: DataFrame, ends: DataFrame, *, most: int, max_hops: int | None = None) -> DataFrame:
    """(node, path, nth): ways along edges from a node to one of the ``ends`` (column node), as arrays from the node on.

    Shortest first, ties by the names along the way, at most ``most`` a node. A
    way to the ``most`` best of a node leads over the ``most`` best of its next
    node, so each hop keeps no more than those, picked in part before the
    shuffle: rows follow most x nodes even where ways are countless. Ways that
    come back to themselves end. A way goes on past an end it meets.
    """
    links = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("via")).distinct())
    last = cut(ends.select("node", F.array("node").alias("path")).distinct())
    done, hop = last.withColumn("nth", F.lit(1)), 0
    while not last.isEmpty() and (max_hops is None or hop < max_hops):
        hop += 1
        step = links.join(last.select(F.col("node").alias("via"), "path"), "via").filter(~F.array_contains("path", F.col("node"))).select("node", F.concat(F.array("node"), "path").alias("path"))
        best = step.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("path"))).filter(F.col("nth") <= most)
        before = done.groupBy("node").agg(F.count("*").alias("had"))
        ranked = best.join(before, "node", "left").withColumn("nth", (F.col("nth") + F.coalesce("had", F.lit(0))).cast("int"))
        last = cut(ranked.filter(F.col("nth") <= most).select("node", "path", "nth"))
        done, last = done.unionByName(last), last.drop("nth")
    return done


def affected(edges: DataFrame, changed: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops, n_causes): what depends on changed nodes, against the direction src -> dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, changed, max_hops).filter("hops > 0").groupBy("node").agg(F.min("hops").alias("hops"), F.count_distinct("seed").alias("n_causes"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth) from rows (node, parent), parent null at a root.

    Pointers are doubled, so a chain of n takes log2(n) joins. A node on or
    above a cycle has a null root.
    """
    now = cut(parents.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    top = parents.filter("parent IS NULL").select(F.col("node").alias("up"))
    limit = max(1, now.count()).bit_length() + 1
    for _ in range(limit):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        new = now.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("further", "up") != F.col("up")).alias("moved"))
        new = cut(new)
        moved = not new.filter("moved").isEmpty()
        now = new.drop("moved")
        if not moved:
            break
    ended = top.withColumn("root", F.col("up"))
    return now.join(ended, "up", "left").select("node", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes that stay when nodes without incoming or outgoing edges are peeled off again and again."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        both = left.join(left.select("dst").distinct().withColumnRenamed("dst", "src"), "src", "left_semi")
        left = cut(both.join(both.select("src").distinct().withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        fewer = left.count()
        if fewer == n:
            break
        n = fewer
    return left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node (column node)."""
    known = nodes.select("node").distinct()
    at_src = edges.join(known.withColumnRenamed("node", "src"), "src", "left_anti").select(*edges.columns, F.lit("src").alias("missing"))
    at_dst = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns, F.lit("dst").alias("missing"))
    return at_src.unionByName(at_dst)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node reaches along edges (src, dst) in either direction; a node without edges is its own.

    Every node takes the smallest label around it, then its label's label, until
    nothing changes: labels jump ever farther, so rounds follow the logarithm of the longest path as a rule.
    """
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    now = cut(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        near = links.join(now.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("up"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("further"))
        new = cut(step.join(jump, "up").select("node", F.least("up", "further").alias("root"), "was"))
        if new.filter("root <> was").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")
