"""Bounded samples of labelled documents, which classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize, quoted, text_or_empty

#: Labels are learned from ids whose crc32 modulo this is not 0; the others are held out.
FOLDS = 5
#: Rows of a class that a fit takes at most, and bytes of text that it takes in all.
PER_CLASS, MOST_BYTES = 1_500, 128 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows of each class, the same on every run.

    The labelled ids with the smallest hashes are taken, of ids that aren't held
    out; labels other than 0 and 1 and labels without a document are passed
    over, and a document without text counts as an empty one. An id counts once
    for each of its labels; of rows that repeat an id, the text with the
    smallest hash is taken. At most 2 * per_class ids are broadcast. Whole texts
    are collected in the order of the ids' hashes as long as they have
    ``most_bytes`` together; one that doesn't fit what is left is passed over.
    """
    open_ids = labels.select(quoted(id_col).alias("k"), quoted(label).cast("int").alias("y")).filter(id_remainder(F.col("k"), FOLDS) != 0).distinct()
    classes = [open_ids.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(1), "k"), "k").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(classes[0].unionByName(classes[1]))
    rows = docs.select(quoted(id_col).alias("k"), text_or_empty(text_col).alias("text")).join(chosen, "k")
    texts = rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    texts = materialize(texts.select(F.xxhash64(F.lit(2), "k", "y").alias("order"), F.octet_length("x.text").alias("bytes"), F.col("x.text").alias("text"), "y"), "labelled")
    taken, left = [], most_bytes
    for r in sorted(texts.select("order", "bytes").collect()):  # at most 2 * per_class rows of two numbers
        if r["bytes"] <= left:
            taken.append(r["order"])
            left -= r["bytes"]
    got = texts.filter(F.col("order").isin(taken)).collect() if taken else []
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["order"], r["y"]))]
