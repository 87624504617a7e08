"""LM scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of a bigram and a
unigram model and a uniform one. The mixture depends on how often the context
was seen (buckets of counts). Its weights come from expectation-maximisation on
a held-out part of the training documents, whose own counts are deleted from
the model for that.

The corpus is cut into blocks of documents. A block knows its distinct words
and word pairs as 64-bit hashes. They go, in array columns, to the partition
that adds up the counts of their range of hashes over all blocks, and the sums
come back to the block. A frequent word is one entry per block, however often
it occurs, so no key is hot; a range without entries of a block makes no row,
so that rows never outnumber the entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, materialize, quoted, text_or_empty

#: Documents whose crc32 modulo FOLDS is 0 are never learned from; those with
#: remainder DELETED are learned from, and held out while the weights are fitted.
FOLDS, DELETED = 10, 1
#: Tokens of a block, and entries of a range of hashes, about.
BLOCK, ENTRIES = 1_000_000, 1_000_000
#: Bytes at which a row group of stored blocks ends: about one block.
GROUP = 4 << 20
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
#: Partitions that ranges and blocks are dealt to: at most this many, or two for each core of a larger cluster.
MOST_PARTITIONS = 4096
#: Tokens whose probabilities are worked out at once.
SLICE = 1 << 17
#: Buckets of context counts: bit lengths up to BUCKETS - 1.
BUCKETS = 16
#: Steps per power of ten in which probabilities are counted for the weights.
STEPS = 8
#: The token that ends every document.
END = b"\n"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ADD = 0.1
ROUNDS, ENOUGH = 200, 1e-7
#: Kinds of entries.
WORD, PAIR = 0, 1

BLOCKS = "block long, role int, ids array<{}>, lengths array<int>, words array<long>, tokens array<int>, before array<int>, cuts array<long>"
REQUESTS = "part long, block long, role int, keys array<long>, counts array<int>"
ANSWERS = "part long, block long, role int, counts array<long>, deleted array<long>, n long, v long, n_deleted long"


def _hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _hash_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _list(values: np.ndarray, kind):
    """One Arrow list from numbers."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _array(lists, i: int = 0) -> np.ndarray:
    """The i-th list of an Arrow column as numbers."""
    return lists[i].values.to_numpy(zero_copy_only=False)


def blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of BLOCKS: documents of one role (0 never learned from, 1 held out for the weights, 2 others).

    ``tokens`` numbers the block's distinct words, whose hashes are ``words``;
    ids keep their type. A document that is longer than what is left of a block
    goes on in the next one: ``before`` has the context of each part's first
    token (END at the start of a document), ``cuts`` a number that the parts of
    one document share (null for a whole one).
    """
    remainder = id_remainder(id_col, FOLDS)
    role = F.when(remainder == 0, 0).when(remainder == DELETED, 1).otherwise(2).cast("int")
    piece = min(PIECE, 4 * block)

    def build(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["block", "role", "ids", "lengths", "words", "tokens", "before", "cuts"]
        task, made, cut_ones, id_type = TaskContext.get().partitionId(), 0, 0, None
        held: dict[int, _Held] = {}

        def flush(r):
            nonlocal made
            part = held.pop(r)
            made += 1
            cells = [pa.array([(task << 24) + made]), pa.array([r], pa.int32()), pa.array([part.ids], pa.list_(id_type)), _list(np.array(part.lengths), pa.int32())]
            cells += [_list(_hash_words(list(part.index)).view(np.int64), pa.int64()), _list(np.concatenate(part.tokens), pa.int32())]
            cells += [_list(np.array(part.before), pa.int32()), pa.array([part.cuts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, r, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(r, _Held()).open(key.as_py(), END)
                last = None
                for words in _pieces(text.as_py().encode().lower(), piece):
                    if last is not None and held[r].n >= block:  # more words come: they go on in a new block
                        if held[r].cuts[-1] is None:
                            cut_ones += 1
                            held[r].cuts[-1] = (task << 32) + cut_ones
                        number = held[r].cuts[-1]
                        yield flush(r)
                        held[r] = _Held()
                        held[r].open(key.as_py(), last, number)
                    held[r].add(words)
                    last = words[-1]
                if held[r].n >= block:
                    yield flush(r)
        for r in list(held):
            yield flush(r)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), role, text_or_empty(text_col)).mapInArrow(build, BLOCKS.format(id_type))


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, then END, in lists of the words of about ``size`` bytes each; no list is empty."""
    at = 0
    while at < len(text):
        gap = SPACE.search(text, at + size)
        stop = gap.start() if gap else len(text)
        words = text[at:stop].split()
        if words:
            yield words
        at = stop
    yield [END]


class _Held:
    """What a block has so far."""

    def __init__(self):
        self.ids, self.lengths, self.index, self.tokens, self.before, self.cuts, self.n = [], [], {END: 0}, [], [], [], 0

    def open(self, key, context: bytes, number: int | None = None):
        """The next document, or the rest of one that was cut."""
        self.ids.append(key)
        self.lengths.append(0)
        self.before.append(self.index.setdefault(context, len(self.index)))
        self.cuts.append(number)

    def add(self, words: list[bytes]):
        index = self.index
        self.tokens.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int32, count=len(words)))
        self.lengths[-1] += len(words)
        self.n += len(words)


def _pairs(tokens: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a block: hashes (sorted), the place of each token's pair among them, and their counts."""
    code, place, counts = np.unique(contexts.astype(np.int64) * len(words) + tokens, return_inverse=True, return_counts=True)
    keys = _hash_pairs(words[code // len(words)], words[code % len(words)])
    order = np.argsort(keys)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return keys[order], rank[place], counts[order]


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, words, tokens and the context of each token of the only row of a table of BLOCKS.

    A document's first token follows the end of another, so END is its context.
    """
    lengths, words, tokens, before = (_array(row[c]) for c in ("lengths", "words", "tokens", "before"))
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = before
    return lengths, words.view(np.uint64), tokens, contexts


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges (first ``bits`` bits) of sorted keys, and where each starts, with the end."""
    own = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    at = np.flatnonzero(np.diff(own, prepend=-1))
    return own[at], np.append(at, len(keys))


def requests(made: DataFrame, bits: int) -> DataFrame:
    """Rows of REQUESTS: per kind and range of hashes what a block has, keys ascending, with its own counts.

    ``part`` is twice the range plus the kind. There are 2 ** bits ranges.
    """

    def ask(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, words, tokens, contexts = _read(row)
                order = np.argsort(words)
                single = (words[order], np.bincount(tokens, minlength=len(words))[order])
                pair_keys, _, pair_counts = _pairs(tokens, contexts, words)
                for kind, (keys, counts) in ((WORD, single), (PAIR, (pair_keys, pair_counts))):
                    own, at = _ranges(keys, bits)
                    ends = pa.array(at, pa.int32())
                    same = [pa.repeat(pa.scalar(row.column(c)[0].as_py(), t), len(own)) for c, t in (("block", pa.int64()), ("role", pa.int32()))]
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((keys.view(np.int64), pa.int64()), (counts, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(own * 2 + kind), *same, *lists], names=["part", "block", "role", "keys", "counts"])

    return made.mapInArrow(ask, REQUESTS)


def answers(asked: DataFrame, ranges: int) -> DataFrame:
    """Rows of ANSWERS: the counts over all training documents, to each block in the order of its keys.

    ``deleted``: the part of them that comes from documents of role 1, for
    blocks of role 1 only. One row per part, without a block, has the number of
    training tokens (n), of distinct ones (v) and of deleted ones in it.
    """

    def add(table):
        import pyarrow as pa

        table = table.combine_chunks()
        role, keys = table["role"].to_numpy(), table["keys"].chunk(0)
        ends = keys.offsets.to_numpy()
        all_keys, place = np.unique(keys.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
        own, whose = table["counts"].chunk(0).flatten().to_numpy().astype(np.float64), np.repeat(role, np.diff(ends))
        total, deleted = (np.bincount(place, own * of, len(all_keys)).astype(np.int64) for of in (whose != 0, whose == 1))
        back = pa.array(ends - ends[0], pa.int32())
        wanted, cut = whose == 1, np.concatenate([[0], np.cumsum(np.where(role == 1, np.diff(ends), 0))])
        part, n = table["part"][0].as_py(), table.num_rows
        answer = pa.table([
            pa.array([part] * n), table["block"].chunk(0), table["role"].chunk(0),
            pa.ListArray.from_arrays(back, pa.array(total[place])),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(deleted[place[wanted]])),
            *[pa.nulls(n, pa.int64())] * 3,
        ], names=[x.split()[0] for x in ANSWERS.split(", ")])
        sums = {"part": [part], "n": [int(total.sum())], "v": [int((total > 0).sum())], "n_deleted": [int(deleted.sum())]}
        return pa.concat_tables([answer, pa.table(sums)], promote_options="default")

    return asked.repartition(partitions(asked.sparkSession, 2 * ranges), "part").groupBy("part").applyInArrow(add, ANSWERS)


def _counts(row, got, which: str) -> list[np.ndarray]:
    """Counts per token of a block: of the token, of its context, of the pair. ``which``: counts or deleted."""
    _, words, tokens, contexts = _read(row)
    parts, lists = got["part"].to_numpy(), got[which]
    order = np.argsort(words)
    # a block's rows in the order of their ranges have its keys in ascending order
    word, pair = (np.concatenate([_array(lists, i) for i in sorted(np.flatnonzero(parts % 2 == kind).tolist(), key=parts.__getitem__)]) for kind in (WORD, PAIR))
    of_word = np.empty(len(words), dtype=np.int64)
    of_word[order] = word
    _, place, _ = _pairs(tokens, contexts, words)
    return [of_word[tokens], of_word[contexts], pair[place]]


def _bucket(context: np.ndarray) -> np.ndarray:
    """Bit length of the context's count, at most BUCKETS - 1."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _estimates(c: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood bigram and unigram estimates and the uniform one."""
    return pair / np.maximum(context, 1), c / max(n, 1), 1.0 / (v + 1)


def _steps(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps of their logarithm; -1 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(-STEPS * np.log10(p)), -1).astype(np.int32)


def em(cells: list[tuple[int, int, int, int]], v: int) -> np.ndarray:
    """Weights (bucket; bigram, unigram, uniform) from counted cells (bucket, bigram step, unigram step, n).

    Buckets without cells take the weights of all cells together.
    """
    table = np.array(cells, dtype=np.int64).reshape(-1, 4)
    back = lambda s: np.where(s >= 0, 10.0 ** (-s / STEPS), 0.0)
    p = np.stack([back(table[:, 1]), back(table[:, 2]), np.full(len(table), 1.0 / (v + 1))], axis=1)
    n = table[:, 3].astype(np.float64)

    def fit(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(ROUNDS):
            share = p[own] * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[own, None]).sum(axis=0) / n[own].sum()
            new = np.maximum(new, 1e-6)
            new /= new.sum()
            if np.abs(new - w).max() < ENOUGH:
                return new
            w = new
        return w

    every = np.ones(len(table), dtype=bool)
    start = np.array([0.4, 0.4, 0.2])
    overall = fit(every, start) if len(table) else start
    return np.stack([fit(table[:, 0] == b, overall) if (table[:, 0] == b).any() else overall for b in range(BUCKETS)])


def partitions(spark: SparkSession, wanted: int) -> int:
    """``wanted`` partitions, as far as a cluster of this size can keep track of them; a partition then has several ranges or blocks, one after the other."""
    return min(wanted, max(MOST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))


def _together(made: DataFrame, answered: DataFrame, n_blocks: int, work, schema: str) -> DataFrame:
    """``work(row of a block, its answers)`` for each block, as Arrow tables; so is its result."""

    def both(left, right):
        return work(left.combine_chunks(), right.combine_chunks())

    n = partitions(made.sparkSession, n_blocks)
    left, right = made.repartition(n, "block"), answered.filter("block IS NOT NULL").repartition(n, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(both, schema)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Tokens are the words of the whole text, A to Z lower-cased, and one end
    token. ``base_score`` adds log10 of the add-0.1 unigram estimate over the
    tokens, ``score`` log10 of the mixed estimate. Null texts are empty ones
    (one token); null ids count as held out by the crc32 of an empty text, ids
    keep their type; repeated rows count each by itself; other columns, whatever
    their names, are not looked at; without any training document all counts
    are 0 and the uniform estimate is what is left; an empty table gives an
    empty result. Counts are kept by 64-bit hashes of words and pairs. A text of
    any length is taken apart piece by piece and may lie in many blocks.
    """
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    made = materialize(blocks(docs, id_col=id_col, text_col=text_col, block=block), "lm-blocks", group=GROUP)
    long_ones = F.exists("cuts", lambda x: x.isNotNull())
    tokens, n_blocks, has_cuts = made.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)), F.count("*"), F.coalesce(F.bool_or(long_ones), F.lit(False))).first()
    bits = max(0, int(tokens // entries).bit_length())
    n_blocks = max(1, n_blocks)

    answered = materialize(answers(requests(made, bits), 1 << bits), "lm-answers")
    n, v, n_deleted = answered.filter(F.col("block").isNull() & (F.col("part") % 2 == WORD)).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_deleted"))).first()

    def cells(row, got):
        rest = [whole - part for whole, part in zip(_counts(row, got, "counts"), _counts(row, got, "deleted"), strict=True)]
        code = np.empty(len(rest[0]), dtype=np.int64)
        for i in range(0, len(code), SLICE):
            c, context, pair = (x[i : i + SLICE] for x in rest)
            bigram, unigram, _ = _estimates(c, context, pair, n - n_deleted, v)
            code[i : i + SLICE] = (_bucket(context).astype(np.int64) << 32) | ((_steps(bigram) + 1).astype(np.int64) << 16) | (_steps(unigram) + 1)
        code, times = np.unique(code, return_counts=True)
        return pa.table({"bucket": pa.array((code >> 32).astype(np.int32)), "p2": pa.array(((code >> 16 & 0xFFFF) - 1).astype(np.int32)), "p1": pa.array(((code & 0xFFFF) - 1).astype(np.int32)), "n": pa.array(times)})

    counted = _together(made.filter("role = 1"), answered.filter("role = 1"), n_blocks, cells, "bucket int, p2 int, p1 int, n long")
    # at most BUCKETS times the squared number of steps, whatever the input: at most a few thousand in practice
    weights = em([tuple(r) for r in counted.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).orderBy("bucket", "p2", "p1").collect()], v)

    def scores(row, got):
        lengths = _array(row["lengths"])
        every = _counts(row, got, "counts")
        base, mixed, known = np.empty(len(every[0])), np.empty(len(every[0])), np.empty(len(every[0]), dtype=np.int64)
        for i in range(0, len(base), SLICE):
            part = slice(i, i + SLICE)
            c, context, pair = (x[part] for x in every)
            bigram, unigram, uniform = _estimates(c, context, pair, n, v)
            w = weights[_bucket(context)]
            mixed[part] = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] * uniform)
            base[part] = np.log10((c + ADD) / (n + ADD * (v + 1)))
            known[part] = c > 0
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = [pa.array(np.add.reduceat(x, at)) for x in (known, base, mixed)]
        ids, cuts = (row[c].chunk(0).flatten() for c in ("ids", "cuts"))
        return pa.table([ids, pa.array([row["role"][0].as_py() == 0] * len(ids)), pa.array(lengths.astype(np.int64)), *sums, cuts], names=["doc_id", "held_out", *added, "cut"])

    added = ["n_tokens", "n_known", "base_score", "score"]
    out = _together(made, answered, n_blocks, scores, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, cut long")
    if has_cuts:  # parts of one document add up
        out = materialize(out, "lm-scores")
        parts = out.filter("cut IS NOT NULL").groupBy("cut").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in added))
        out = out.filter("cut IS NULL").unionByName(parts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
