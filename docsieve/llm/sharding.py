"""Sharding: a two-pass external shuffle.

Pass one scatters records by a seeded hash into buckets of about
``bucket_bytes``; pass two shuffles each bucket in memory (Fisher-Yates) and
writes it. The buckets laid end to end form one random permutation of all
records, which is cut into shards whose row counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, shared_dir, text_or_empty, with_fields

#: Seed of production runs.
SEED = 20_011
#: Cells of the seeded hash; buckets are runs of neighbouring cells. Where a
#: cell would be larger than a bucket, there are more cells, a power of two.
CELLS = 1 << 16
#: Cells up to which the table that maps cells to buckets is broadcast (some 40 bytes each); a larger one is joined.
MOST_BROADCAST = 1 << 20
#: Cells whose sums are worked out together.
RUN_BITS = 10
#: Bytes of text that one bucket holds (a task shuffles one bucket at a time).
BUCKET_BYTES = 16 << 20


def row_values(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` as values that can be hashed: maps as JSON."""
    return [F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema]


def counted(rows: DataFrame, values: list[Column], h: str, piece_bytes: int, size: Column) -> DataFrame:
    """``rows`` with a hash ``h`` of their own for each of equal rows.

    Equal rows are counted, partly before the shuffle; one of them stands for
    all, and is repeated number by number in pieces of about ``piece_bytes``, so
    that no task holds or makes all copies. Which of them gets which number is
    no matter. Equal are rows whose two 64-bit hashes are.
    """
    again, n, first, piece, number, one = fresh(rows, "again", "n", "first", "piece", "number", "one")
    groups = rows.withColumn(again, F.xxhash64(F.lit("again"), *values)).groupBy(h, again).agg(F.count("*").alias(n), F.first(F.struct(*(quoted(c) for c in rows.columns if c != h))).alias(one), F.first(size).alias(piece))
    # copies a piece; a piece's row is repeated only after it has moved to a task of its own
    groups = groups.withColumn(piece, F.greatest(F.lit(1), F.lit(piece_bytes).cast("long") / F.col(piece)).cast("long"))
    pieces = groups.withColumn(first, F.explode(F.expr(f"sequence(0L, `{n}` - 1, `{piece}`)"))).repartition(h, first)
    copies = pieces.withColumn(number, F.explode(F.expr(f"sequence(`{first}`, least(`{first}` + `{piece}`, `{n}`) - 1)")))
    return copies.select(*(quoted(one)[c].alias(c) if c != h else F.when(quoted(number) == 0, quoted(h)).otherwise(F.xxhash64(h, again, number)).alias(h) for c in rows.columns))


def shuffle_to_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, cells: int = CELLS, path: str | None = None) -> DataFrame:
    """Write ``docs`` as ``n_shards`` shuffled shards and return them as read back.

    The result has the columns of ``docs`` plus ``shard`` (int) and ``slot``
    (long, gapless from 0 in each shard); names that clash get a leading
    underscore. A row's place follows from the seed, its id and text and the
    other rows alone, so reruns and retried tasks agree.

    Null ids and texts hash like other values. Copies with ids of their own
    scatter over all buckets, whatever their number, and so do rows that differ
    in any other column. Rows equal in all of them are interchangeable: where
    they are more than a bucket should hold, their count is split and each number
    scatters by itself. A bucket always holds whole records, however long. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    cell, h, bucket, start, total, shard, slot = fresh(docs, "cell", "hash", "bucket", "start", "total", "shard", "slot")
    every = row_values(docs)
    hashed = docs.withColumn(h, F.xxhash64(F.lit(seed), quoted(id_col), quoted(text_col), *every)).withColumn(cell, F.pmod(quoted(h), F.lit(cells)).cast("int"))

    def per_cell_of(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy(cell).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_or_empty(text_col)) + 64).alias("bytes")), "cells")

    per_cell = per_cell_of(hashed)
    full = per_cell.filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select(cell)
    if not full.isEmpty():
        hot = counted(hashed.join(full, cell, "left_semi").drop(cell), every, h, bucket_bytes, F.octet_length(text_or_empty(text_col)) + 64)
        spread = hot.withColumn(cell, F.pmod(quoted(h), F.lit(cells)).cast("int"))
        hashed = hashed.join(full, cell, "left_anti").unionByName(spread)
        per_cell = per_cell_of(hashed)
    wanted = (per_cell.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes
    if cells < wanted:
        return shuffle_to_shards(docs, n_shards, id_col=id_col, text_col=text_col, seed=seed, bucket_bytes=bucket_bytes, cells=1 << int(wanted).bit_length(), path=path)
    # running sums in two levels: over runs of cells, then over the cells of a run
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_cell = per_cell.withColumn("run", F.shiftright(cell, RUN_BITS))
    runs = per_cell.groupBy("run").agg(F.sum("n").alias("run_n"), F.sum("bytes").alias("run_bytes"))
    along, inside = Window.orderBy("run"), Window.partitionBy("run").orderBy(cell)
    runs = runs.select("run", before("run_n", along).alias("n0"), before("run_bytes", along).alias("bytes0"), F.sum("run_n").over(Window.partitionBy(F.lit(0))).alias(total))
    places = per_cell.join(runs, "run").select(
        cell, F.floor((F.col("bytes0") + before("bytes", inside)) / bucket_bytes).alias(bucket), (F.col("n0") + before("n", inside)).alias("before"), total
    )
    places = places.withColumn(start, F.min("before").over(Window.partitionBy(bucket))).drop("before")
    dealt = hashed.join(F.broadcast(places) if cells <= MOST_BROADCAST else places, cell).drop(cell)

    names, keep = docs.columns, [h, bucket, start, total]

    def fisher_yates(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = table.num_rows
        order = pc.sort_indices(table, sort_keys=[(h, "ascending")]).to_numpy().copy()  # arrival order must not matter
        np.random.default_rng([seed, table[bucket][0].as_py()]).shuffle(order)  # Fisher-Yates
        at = np.arange(n, dtype=np.int64) + table[start][0].as_py()
        rows, k = table[total][0].as_py(), n_shards
        to = ((at + 1) * k - 1) // rows
        out = table.select(names).take(pa.array(order))
        return out.append_column(shard, pa.array(to.astype(np.int32))).append_column(slot, pa.array(at - to * rows // k))

    schema = with_fields(docs.schema, **{shard: "int", slot: "long"})
    out = dealt.select(*(quoted(c) for c in names + keep)).groupBy(bucket).applyInArrow(fisher_yates, schema)
    path = path or shared_dir(spark, "shards")
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*(quoted(c) for c in [*names, shard, slot]))
