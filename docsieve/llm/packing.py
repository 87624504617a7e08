"""Packing: token ids laid end to end and cut into sequences of one length.

Pass one encodes every document and stores its ids with the place they have in
their own task; the sums of the tasks give each task its place in the whole.
Pass two reads the ids again and cuts them at multiples of the sequence length:
sequences that lie within a task are written as they are, those that begin or
end in another task are written as boundary records and joined afterwards.
Only the last sequence of all isn't full.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .bpe import byte_characters
from .common import SLICE, materialize, quoted, shared_dir

#: Tokens of a sequence.
LENGTH = 1_024
#: The id that ends a document.
END = 0
#: Tokens of a stored row; a longer document takes several.
CHUNK = 1 << 20
#: Words that a Python worker learns before it forgets those not used since it last did, and the longest it learns.
MEMORY, LONG = 250_000, 64
#: Tasks of pass one up to which their places are broadcast (16 bytes each); more are joined.
MOST_BROADCAST = 1 << 20
#: Tasks whose sums are worked out together.
RUN_BITS = 10


class Encoder:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    The file's words and merges are all that is used. Where its merges stand in
    the order of their ids, as those of a trained vocabulary do, the lowest id
    is the next merge, and words that are new are encoded together by tiktoken,
    which takes about a seventh of the time; added tokens, other files and what
    tiktoken refuses go through tokenizers.
    """

    def __init__(self, path: str):
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocabulary = {k: v for k, v in file["model"]["vocab"].items() if k not in added}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocabulary.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        step = file["pre_tokenizer"]
        self.plain = made == sorted(made) and (step["type"], step["use_regex"], step["add_prefix_space"]) == ("ByteLevel", True, False) and not file["normalizer"] and not file["post_processor"]
        self.added = tuple(added)
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self.type = np.dtype(f"<u{width(path)}")
        self.words: dict[str, bytes | None] = {}
        self.old = self.words

    def whole(self, text: str) -> bytes:
        """Ids of a text that is encoded in one go."""
        import numpy as np

        if self.plain and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.type).tobytes()
            except ValueError:  # the splitting pattern runs out of stack on huge runs of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Ids of a space and each of the words. All are encoded in one text: a token that starts with a space starts a word."""
        import numpy as np

        todo = []
        for w in new:
            # white space after the cut could reach over it, so such words and added tokens have no ids of their own
            if not w or w[0].isspace() or len(w) > LONG or any(x in w for x in self.added):
                self.words[w] = None
            else:
                todo.append(w)
        if not todo:
            return
        ids = self.fast.encode_to_numpy(" " + " ".join(todo), disallowed_special=())
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(todo):
            raise ValueError("a token of the vocabulary goes over a space")
        raw, size = ids.astype(self.type).tobytes(), self.type.itemsize
        ends = np.append(starts[1:], len(ids))
        self.words.update((w, raw[a * size : b * size]) for w, a, b in zip(todo, starts.tolist(), ends.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as raw integers of ``type``.

        A space before a character that isn't white space always starts a match
        of the pattern, so texts are cut there and their words looked up; a text
        with other uses of the space is encoded as a whole.
        """
        if not self.plain:
            return list(map(self.whole, texts))
        if len(self.words) > MEMORY:
            self.old, self.words = self.words, {}
        cut = [t.split(" ") for t in texts]
        missing = set().union(*(w[1:] for w in cut)).difference(self.words)
        known = self.old.keys() & missing
        self.words.update((w, self.old[w]) for w in known)
        self._learn(missing - known)
        get, out = self.words.__getitem__, []
        for text, (first, *words) in zip(texts, cut, strict=True):
            ids = list(map(get, words))
            out.append(self.whole(text) if None in ids else b"".join([self.whole(first), *ids]))
        for w in [w for w in self.words if len(w) > LONG]:  # memory follows no word
            del self.words[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def width(path: str) -> int:
    """Bytes of an id."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return 2 if max([*file["model"]["vocab"].values(), *(x["id"] for x in file["added_tokens"])]) < 1 << 16 else 4


def _path(vocabulary: str) -> str:
    import os

    import public_tokenizers

    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)


def _runs(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of about ``limit`` in all; a larger one is a run of its own."""
    import numpy as np

    upto, first = np.cumsum(sizes), 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, done + limit, side="right")))
        yield first, end
        first = end


def tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, chunk: int = CHUNK) -> DataFrame:
    """Pass one, written out: rows (doc_id, doc_tokens, start, n, ids, task, at).

    ``ids``: the n ids from ``start`` on, as raw little-endian integers of 16
    bits, or 32 for vocabularies over 65,536; the last is ``end_id``. A document
    of more than ``chunk`` tokens takes several rows. ``task`` and ``at`` tell
    where the row's first id lies: a stored task comes from one attempt, so these
    fit together whatever was retried.
    """
    schema = StructType([docs.select(quoted(id_col).alias("doc_id")).schema[0], *StructType.fromDDL("doc_tokens long, start long, n int, ids binary, task int, at long").fields])

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        own, task, at = encoder(_path(vocabulary)), TaskContext.get().partitionId(), 0
        last = np.array([end_id], dtype=own.type).tobytes()
        size = own.type.itemsize
        for batch in batches:
            ids, texts = batch.columns
            for first, end in _runs(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE):
                raw = [x + last for x in own.encode([t or "" for t in texts.slice(first, end - first).to_pylist()])]
                rows = [(i, len(x) // size, k, x[k * size : (k + chunk) * size]) for i, x in enumerate(raw, first) for k in range(0, len(x) // size, chunk)]
                which, total, start, parts = zip(*rows, strict=True)
                n = np.array([len(x) // size for x in parts], dtype=np.int64)
                place = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary()), pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(place)],
                    names=schema.names,
                )

    bare = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return materialize(bare.mapInArrow(run, schema), "tokens", "zstd")


def placed(stored: DataFrame) -> DataFrame:
    """Rows of :func:`tokens` with ``at`` counted over all tasks: running sums over runs of tasks, then within a run."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = stored.groupBy("task").agg(F.sum("n").alias("total")).withColumn("run", F.shiftright("task", RUN_BITS))
    totals = materialize(totals, "task-totals")  # a row per task
    runs = totals.groupBy("run").agg(F.sum("total").alias("run_total"))
    runs = runs.select("run", before("run_total", Window.orderBy("run")).alias("run_base"))
    bases = totals.join(runs, "run").select("task", (F.col("run_base") + before("total", Window.partitionBy("run").orderBy("task"))).alias("base"))
    few = totals.count() <= MOST_BROADCAST
    return stored.join(F.broadcast(bases) if few else bases, "task").withColumn("at", F.col("at") + F.col("base")).drop("task", "base")


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END, chunk: int = CHUNK, path: str | None = None) -> DataFrame:
    """Write ``docs`` as packed sequences and return them as read back: rows (sequence_id, n, ids, pieces).

    ``ids``: the n ids, raw as in :func:`tokens`; n is ``length`` but for the
    last sequence, so the padding in all is less than one sequence. ``pieces``:
    what lies in the sequence, in order, as (doc_id, start, length, doc_tokens,
    offset, ids_crc32): ids ``start`` and on of a document of ``doc_tokens`` ids,
    ``end_id`` included, put at ``offset``; the CRC is of the ids as little-endian
    unsigned 32-bit integers.

    Documents follow each other as the tasks read them, so the order is that of
    the input's files. A null text counts as an empty one and gives ``end_id``
    alone; repeated rows and null ids are rows like any other; a very long text
    is encoded whole and stored in chunks; an empty table gives no sequences.
    """
    spark, code = docs.sparkSession, width(_path(vocabulary))
    rows = placed(tokens(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id, chunk=chunk)).select("doc_id", "doc_tokens", "start", "n", "at", "ids")
    id_field = rows.schema["doc_id"]
    piece = StructType([id_field, *StructType.fromDDL("start long, length long, doc_tokens long, offset long, ids_crc32 long").fields])
    schema = StructType.fromDDL("sequence_id long, n int, whole boolean, ids binary, end_ids binary").add("pieces", ArrayType(piece))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        type_ = np.dtype(f"<u{code}")
        end, ids, parts = None, [], []  # where the open sequence ends so far; its ids and pieces

        def cut(table) -> Iterator[tuple]:
            nonlocal end, ids, parts
            docs_, (total, start, n, at) = table[0], (c.to_numpy() for c in table[1:5])
            for i, raw in enumerate(table[5]):
                raw, begin, stop = np.frombuffer(raw.as_buffer(), dtype=type_), int(at[i]), int(at[i] + n[i])
                if end != begin and ids:  # the rows before end here
                    yield end, ids, parts
                    ids, parts = [], []
                while begin < stop:
                    end = min(stop, (begin // length + 1) * length)
                    own = raw[begin - int(at[i]) : end - int(at[i])]
                    ids.append(own.tobytes())
                    parts.append((docs_[i], int(start[i]) + begin - int(at[i]), end - begin, int(total[i]), begin % length, zlib.crc32(own.astype("<u4").tobytes())))
                    if end % length == 0:
                        yield end, ids, parts
                        ids, parts = [], []
                    begin = end

        def batch_of(found: list[tuple]):
            raw = [b"".join(x) for _, x, _ in found]
            n = np.array([len(x) // code for x in raw], dtype=np.int32)
            sequence = (np.array([x for x, _, _ in found], dtype=np.int64) - 1) // length
            flat = [p for _, _, x in found for p in x]
            columns = list(zip(*flat, strict=True))
            fields = [pa.array([x.as_py() for x in columns[0]], columns[0][0].type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            offsets = pa.array(np.cumsum([0, *(len(x) for _, _, x in found)]).astype(np.int32))
            pieces = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=piece.names))
            return pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(n), pa.array(n == length), *(pa.array([x if (len(x) == code * length) is full else None for x in raw], pa.binary()) for full in (True, False)), pieces], names=schema.names)

        waiting = []
        for batch in batches:
            for done in cut(batch.columns):
                waiting.append(done)
                if len(waiting) * length * code >= SLICE:
                    yield batch_of(waiting)
                    waiting = []
        if ids:
            waiting.append((end, ids, parts))
        if waiting:
            yield batch_of(waiting)

    path = path or shared_dir(spark, "sequences")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    return joined(stored)


def joined(stored: DataFrame) -> DataFrame:
    """Whole sequences as they are; boundary records, at most ``length`` of a sequence, put together in order.

    Their ids are a column of their own, so that looking for them reads no others.
    """
    whole = stored.filter("whole").select("sequence_id", "n", "ids", "pieces")
    ends = stored.filter("NOT whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pieces")[0]["offset"].alias("first"), "n", F.col("end_ids").alias("ids"), "pieces"))).alias("parts"))
    every = lambda what, start: F.aggregate("parts", start, lambda s, x: F.concat(s, x[what]))
    ends = ends.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0), lambda s, x: s + x["n"]).alias("n"),
        every("ids", F.lit(b"")).alias("ids"),
        F.flatten(F.transform("parts", lambda x: x["pieces"])).alias("pieces"),
    )
    return whole.unionByName(ends)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece: sequence_id and the fields of ``pieces``."""
    return sequences.select("sequence_id", F.inline("pieces"))


def token_ids(sequences: DataFrame, vocabulary: str) -> DataFrame:
    """``sequences`` with ``ids`` as an array of integers."""
    code = width(_path(vocabulary))
    digits = F.hex("ids")
    at = lambda i: F.concat(*(F.substr(digits, 2 * (code * i + k) + 1, F.lit(2)) for k in reversed(range(code))))
    return sequences.withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.conv(at(i), 16, 10).cast("int")))
