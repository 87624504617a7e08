"""Budgeted closure: what a request needs of a graph, expanded breadth first under bounds, with a ledger of what was left out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.operators import graph

# Bounds of a closure, gaps and links that its report lists.
MAX_HOPS, MAX_OBJECTS, MAX_BYTES, MOST_GAPS, MOST_LINKS = 3, 64, 1 << 20, 64, 128


def _decided(due: DataFrame, max_objects: int, max_bytes: int) -> DataFrame:
    """``due`` (request, node, hop, above, nth, bytes, had, spent, popped) with place and state.

    Nodes of a request pass in queue order through one task, which holds two
    sums: whether a node fits hangs on all before it.
    """
    rows = due.repartition("request").sortWithinPartitions("request", "above", "nth", "node")
    schema = StructType([due.schema["request"], due.schema["node"], *StructType.fromDDL("hop int, bytes long, place long, state string").fields])

    def run(batches) -> Iterator:
        import pyarrow as pa

        key, nodes, spent, place = object(), 0, 0, 0
        for batch in batches:
            states, places = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("request", "bytes", "had", "spent", "popped")]
            for k, size, had, before, popped in zip(*columns, strict=True):
                if k != key:
                    key, nodes, spent, place = k, had, before, popped
                place += 1
                places.append(place)
                if size is None:
                    states.append("missing")
                elif nodes >= max_objects:
                    states.append("object_limit")
                elif spent + size > max_bytes:
                    states.append("byte_limit")
                else:
                    states.append("taken")
                    nodes, spent = nodes + 1, spent + size
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("request", "node", "hop", "bytes")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int64()), pa.array(states, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def budgeted(edges: DataFrame, seeds: DataFrame, sizes: DataFrame, *, max_hops: int = MAX_HOPS, max_objects: int = MAX_OBJECTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(request, node, hop, bytes, place, state): what each request's seeds lead to, in the order of a queue.

    Edges are (src, dst, nth), nth their order at src; seeds (request, node,
    nth); sizes (node, bytes) has every node that exists, objects and records
    alike. ``state``: taken; else a gap: hop_limit, object_limit, byte_limit
    (over half of ``max_bytes``; the rest is for the report), or missing.

    What is a gap isn't expanded, so the bounds decide what is reached at all,
    and a node is decided once, where the queue first meets it. Hops are rounds
    of joins over all requests at once. A node's seeds or edges that repeat
    count once; requests without seeds give no rows.
    """
    sizes = graph.cut(sizes.select("node", F.col("bytes").cast("long").alias("bytes")).dropDuplicates(["node"]))
    links = graph.cut(edges.groupBy("src", "dst").agg(F.min("nth").alias("nth")))
    due = seeds.groupBy("request", "node").agg(F.lit(0).cast("long").alias("above"), F.min("nth").alias("nth"))
    done = None
    for hop in range(max_hops + 2):
        due = due.join(sizes, "node", "left").withColumn("hop", F.lit(hop))
        if done is None:
            due = due.withColumns({c: F.lit(0).cast("long") for c in ("had", "spent", "popped")})
        else:
            due = due.join(done.select("request", "node"), ["request", "node"], "left_anti")
            taken = F.col("state") == "taken"
            sums = done.groupBy("request").agg(F.count_if(taken).alias("had"), F.coalesce(F.sum(F.when(taken, F.col("bytes"))), F.lit(0)).alias("spent"), F.count("*").alias("popped"))
            due = due.join(sums, "request")
        if hop > max_hops:
            order = Window.partitionBy("request").orderBy("above", "nth", "node")
            last = due.select("request", "node", "hop", "bytes", (F.row_number().over(order) + F.col("popped")).alias("place"), F.when(F.col("bytes").isNull(), "missing").otherwise("hop_limit").alias("state"))
            return done.unionByName(last)
        decided = graph.cut(_decided(due, max_objects, max_bytes // 2))
        done = decided if done is None else done.unionByName(decided)
        step = decided.filter("state = 'taken'").select("request", F.col("node").alias("src"), F.col("place").alias("above")).join(links, "src")
        due = step.groupBy("request", F.col("dst").alias("node")).agg(F.min(F.struct("above", "nth")).alias("at")).select("request", "node", "at.above", "at.nth")
    raise AssertionError("the last hop returns")


def gap_ledger(closed: DataFrame, *, most: int = MOST_GAPS) -> DataFrame:
    """(request, nth, node, reason): the gaps of each request in queue order, the first ``most``; and a row of the number left out (node null, reason omitted)."""
    gaps = closed.filter("state <> 'taken'")
    ranked = gaps.withColumn("nth", F.row_number().over(Window.partitionBy("request").orderBy("place")))
    listed = ranked.filter(F.col("nth") <= most).select("request", "nth", "node", F.col("state").alias("reason"))
    rest = gaps.groupBy("request").agg((F.count("*") - most).cast("int").alias("nth")).filter("nth > 0")
    return listed.unionByName(rest.select("request", "nth", F.lit(None).cast("string").alias("node"), F.lit("omitted").alias("reason")))


def typed_links(closed: DataFrame, edges: DataFrame, *, most: int = MOST_LINKS) -> DataFrame:
    """(request, src, dst, type, listed): links that start at what was taken, in queue order; beyond the first ``most`` they are only counted as not listed."""
    taken = closed.filter("state = 'taken'").select("request", F.col("node").alias("src"), "place")
    rows = taken.join(edges.select("src", "dst", "type", "nth").dropDuplicates(["src", "dst", "type"]), "src")
    place = F.row_number().over(Window.partitionBy("request").orderBy("place", "nth", "dst", "type"))
    return rows.select("request", "src", "dst", "type", (place <= most).alias("listed"))


def summary(closed: DataFrame) -> DataFrame:
    """(request, n_taken, bytes, n_gaps, truncated, status) of each request."""
    taken, limit = F.col("state") == "taken", F.col("state").endswith("_limit")
    out = closed.groupBy("request").agg(F.count_if(taken).alias("n_taken"), F.sum(F.when(taken, F.col("bytes")).otherwise(0)).alias("bytes"), F.count_if(~taken).alias("n_gaps"), F.bool_or(limit).alias("truncated"))
    return out.withColumn("status", F.when(F.col("n_gaps") > 0, "incomplete").otherwise("complete"))
