"""Operators over ordered rows: lines, islands, outlines, curves, budgets and even samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docsieve.operators import graph


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, start, end, content): lines with code-point spans; ``key`` names a row.

    The offsets are a running sum by window: linear in the lines of a text, however many.
    """
    parts = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    return running_offsets(parts, [key], ["line"], "content").select(key, "line", "start", "end", "content")


def running_offsets(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """``rows`` plus start and end of each text in the concatenation of its key's rows, set apart by one character."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    start = F.coalesce(F.sum(length + 1).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + length)


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """``rows`` plus ``island`` (0, 1, ...): a new one where ``breaks``, which may use lag(), holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return marked.withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def nearest_shallower(rows: DataFrame, keys: list[str], order: list[str], depth: str, value: str, name: str, *, ahead: bool = False, equal: bool = False) -> DataFrame:
    """``rows`` plus ``name``: ``value`` of the nearest row of the same key before (``ahead``: after) that has less depth (``equal``: or as much), else null.

    A key's rows pass in order through one task, which keeps a stack of one row
    for each depth that is open; depths have no bound. Rows of null depth are
    neither found nor find anything.
    """
    directed = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *directed)
    schema = StructType([*rows.schema.fields, StructField(name, rows.schema[value].dataType)])
    names, n = rows.columns, len(keys)

    def run(batches) -> Iterator:
        import pyarrow as pa

        key, stack = object(), []
        for batch in batches:
            columns = [batch.column(names.index(c)) for c in (*keys, depth, value)]
            found = []
            for *k, d, v in zip(*(c.to_pylist() for c in columns), strict=True):
                if k != key:
                    key, stack = k, []
                if d is None:
                    found.append(None)
                    continue
                while stack and (stack[-1][0] > d or stack[-1][0] == d and not equal):
                    stack.pop()
                found.append(stack[-1][1] if stack else None)
                if stack and stack[-1][0] == d:
                    stack.pop()
                stack.append((d, v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, columns[n + 1].type)], names=schema.names)

    return sorted_rows.mapInArrow(run, schema)


def section_ends(rows: DataFrame, keys: list[str], order: list[str], depth: str, place: str) -> DataFrame:
    """``rows`` plus ``next_place``: of the next row of the same key that is no deeper, null where there is none. Any depth will do."""
    return nearest_shallower(rows, keys, order, depth, place, "next_place", ahead=True, equal=True)


def interpolate(curves: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, x, y): values of curves (key, x, y) at points (key, x), linear between neighbours; none outside.

    Points and knots are merged by one window, so that a curve with many knots
    makes no pairs; x must rise within a curve.
    """
    both = curves.select(key, "x", "y", F.lit(0).alias("asked")).unionByName(wanted.select(key, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("asked")))
    w = Window.partitionBy(key).orderBy("x", "asked")
    knot = F.when(F.col("asked") == 0, F.struct("x", "y"))
    low = F.last(knot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(knot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("low", low).withColumn("high", high).filter("asked = 1")
    at = F.col("low.y") + (F.col("high.y") - F.col("low.y")) * (F.col("x") - F.col("low.x")) / (F.col("high.x") - F.col("low.x"))
    y = F.when(F.col("low.x") == F.col("x"), F.col("low.y")).otherwise(at)
    return near.select(key, "x", y.alias("y")).filter("y IS NOT NULL")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, item: str) -> DataFrame:
    """(keys, item, cost, spent, taken): in order, a row is taken if it still fits; later smaller rows may fit again.

    Each decision hangs on all before it, so a key's rows pass one after the
    other through one task, which holds nothing of them but the sum spent.
    """
    n = len(keys)
    sorted_rows = rows.select(*keys, *order, F.col(item).cast("long").alias("__item"), F.col(cost).cast("long").alias("__cost")).repartition(*keys).sortWithinPartitions(*keys, *order, "__item")
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("item long, cost long, spent long, taken boolean")])

    def run(batches) -> Iterator:
        import pyarrow as pa

        key, spent = None, 0
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            sums, fits = [], []
            for k, c in zip(zip(*own[:n], strict=True), own[-1], strict=True):
                if k != key:
                    key, spent = k, 0
                fits.append(c is not None and spent + c <= budget)
                spent += c if fits[-1] else 0
                sums.append(spent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.columns[-2], batch.columns[-1], pa.array(sums, pa.int64()), pa.array(fits)], names=schema.names)

    return sorted_rows.mapInArrow(run, schema)


def even_sample(rows: DataFrame, keys: list[str], order: list[str], target: int) -> DataFrame:
    """``target`` rows per key, evenly spaced from the first to the last (all of smaller groups), with ``nth`` from 0.

    Position i of target is row floor(i * last / (target - 1) + 1/2).

    Rows are sorted over the cluster by key and order and numbered piece by
    piece; a key of any size is spread over as many pieces as it fills.
    """
    pieces = graph.cut(rows.repartitionByRange(*keys, *order).withColumn("piece", F.spark_partition_id()))
    sizes = pieces.groupBy(*keys, "piece").agg(F.count("*").alias("size"))  # a row per key and piece
    w = Window.partitionBy(*keys)
    offsets = sizes.select(*keys, "piece", F.coalesce(F.sum("size").over(w.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("size").over(w).alias("n"))
    inside = Window.partitionBy(*keys, "piece").orderBy(*order)
    same = F.col("o.piece") == F.col("p.piece")
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}"))
    numbered = pieces.withColumn("own", F.row_number().over(inside)).alias("p").join(offsets.alias("o"), same).select("p.*", "o.offset", "o.n")
    ranked = numbered.withColumn("nth", F.col("offset") + F.col("own") - 1).drop("own", "offset", "piece")
    i = F.ceil((F.col("nth") - 0.5) * (target - 1) / (F.col("n") - 1))
    hit = F.floor(i * (F.col("n") - 1) / (target - 1) + 0.5) == F.col("nth")
    return ranked.filter((F.col("n") <= target) | hit).drop("n")


def worst_status(rows: DataFrame, keys: list[str], status: str, priority: list[str]) -> DataFrame:
    """(keys, status, n): the status that comes first in ``priority`` (unknown ones last) and the number of rows."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(status)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    return rows.groupBy(*keys).agg(F.min_by(status, F.struct(rank, F.col(status))).alias("status"), F.count("*").alias("n"))
