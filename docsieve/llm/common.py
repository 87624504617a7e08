"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.operators.graph import shared_folder


#: Bytes of a column that a worker turns over before it hands rows on.
SLICE = 2 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder ``spark.checkpoint.dir`` that driver and executors share.

    Where that is unset, a session in one process (tests) gets a temporary
    folder; a cluster gets an error.
    """
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy", group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage with files that outlive any executor. The schema is
    given to the reader, so an empty table stays readable. ``group``: bytes at
    which a row group ends, checked after each row; for rows of megabytes, of
    which a writer or reader else holds all of a task at once.
    """
    path = shared_dir(df.sparkSession, name)
    write = df.write.option("compression", compression)
    if group:
        write = write.option("parquet.block.size", group).option("parquet.page.size.row.check.min", 1)
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str | Column) -> Column:
    col = F.col(f"`{col}`") if isinstance(col, str) else col
    return F.coalesce(col, F.lit(""))


def utf8_bytes(col: str | Column) -> Column:
    return text_or_empty(col).cast("binary")


def word_count(col: str | Column) -> Column:
    """Number of matches of ``[^\\x20\\x09-\\x0D]+`` (null: 0), JVM-side.

    Every word shrinks to one letter, then the spaces go; possessive
    quantifiers keep the regex linear on very long texts.
    """
    letters = F.regexp_replace(text_or_empty(col), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(letters, r"[\x20\x09-\x0D]++", "")).cast("long")


def id_remainder(col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (a null id counts as '')."""
    col = F.col(f"`{col}`") if isinstance(col, str) else col
    return F.pmod(F.crc32(utf8_bytes(col.cast("string"))), F.lit(mod))


def with_fields(schema: StructType, **types: str) -> StructType:
    """``schema`` plus new fields, given as name=DDL type."""
    return StructType(schema.fields + [StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in types.items()])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def extended(docs: DataFrame, column: str, start: Callable, *, keep: bool = True, **types: str) -> DataFrame:
    """``docs`` plus new columns. ``start()`` gives, once per task, the function from the
    values of ``column`` to the Arrow arrays of the new columns. ``keep``: whether
    ``column`` itself stays.

    Rows go through in slices of about SLICE bytes (a longer value is a slice of
    its own), so that memory follows neither the batch size nor the table.
    """
    place = docs.columns.index(column)
    stay = [i for i in range(len(docs.columns)) if keep or i != place]
    schema = with_fields(StructType([docs.schema[i] for i in stay]), **types)
    names = schema.names

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        work = start()
        for batch in batches:
            values = batch.column(place)
            length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
            sizes = np.cumsum(length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(values):
                done = sizes[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), *work(part.column(place))], names=names)
                first = end

    return docs.mapInArrow(run, schema)
