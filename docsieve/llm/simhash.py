"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of the perfect binary Golay code, which cover all
23-bit words within radius 3. Two of the fingerprint's 23-bit fields serve in
turn. If two fingerprints differ in at most 3 bits, one of the two fields
differs in at most 1 bit; then the anchor nearest to the one lies within
3 + 1 of the other, so a fingerprint is sent to all (at most six) anchors within
that radius. The 41 bits outside the field, cut into m parts, agree in m - 3 of
them at least, which refine the anchor's group; the more fingerprints there
are, the more parts, so that groups stay small. Inside a group fingerprints are
compared exactly, so nothing is missed and nothing is linked by chance.

Only distinct fingerprints are compared, and a group gives the edges of a
spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, text_or_empty

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, SEED, BITS = 3, 42, 3
#: Golay code: length, check bits and generator polynomial (fixed values).
LENGTH, CHECKS, GENERATOR = 23, 11, 0xC75
#: First bits of the two fields.
FIELDS = (0, 23)
#: Parts of the bits outside a field, and distinct fingerprints up to which so many do; beyond them there are six.
PARTS = ((4, 1 << 33), (5, 1 << 39))
#: A group of up to SMALL is compared by shifts, one of up to LARGE by search in
#: one task, and larger ones in tiles of TILE that go to different tasks.
SMALL, LARGE, TILE = 64, 32_768, 8_192
#: Edges in each file of a round of the components; fewer edges make fewer files and tasks.
EDGES_A_FILE = 250_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text as an unsigned integer (no words: 0)."""
    import xxhash

    words = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    h = partial(xxhash.xxh64_intdigest, seed=seed)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(h, joined), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprints as signed longs of the same bits."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of low 12 and high 11 bits, and per syndrome the errors of weight 4 or less (0xFFFFFFFF: none).

    The code is perfect: each syndrome has one error of weight 3 or less, its
    first entry; those of weight 3 have five more of weight 4.
    """
    column = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for at in range(LENGTH - 1, CHECKS - 1, -1):
            if rest >> at & 1:
                rest ^= GENERATOR << (at - CHECKS)
        column.append(rest)
    parts = []
    for first, n in ((0, 12), (12, 11)):
        table = np.zeros(1 << n, dtype=np.uint32)
        for k in range(n):
            table[1 << k : 2 << k] = table[: 1 << k] ^ np.uint32(column[first + k])
        parts.append(table)
    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= column[b]
            errors[syndrome].append(sum(1 << b for b in bits))
    table = np.full((1 << CHECKS, 6), 0xFFFFFFFF, dtype=np.uint32)
    for s, found in enumerate(errors):
        near = found if found and found[0].bit_count() == 3 else found[:1]
        table[s, : len(near)] = near
    return parts[0], parts[1], table


def parts_for(count: int) -> int:
    return next((m for m, most in PARTS if count <= most), 6)


def anchor_keys(prints: np.ndarray, parts: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) of every group that each fingerprint belongs to.

    A group is named by the field, the anchor, a choice of ``parts`` - 3 parts of the other bits, and those bits.
    """
    edges = [i * (64 - LENGTH) // parts for i in range(parts + 1)]
    choices = list(combinations(range(parts), parts - 3))
    low, high, errors = golay()
    keys, index = [], []
    everyone = np.arange(len(prints))
    for f, first in enumerate(FIELDS):
        field = (prints >> np.uint64(first)).astype(np.uint32) & np.uint32((1 << LENGTH) - 1)
        # what is left of the fingerprint: 41 bits
        under = prints & np.uint64((1 << first) - 1)
        rest = under | (prints >> np.uint64(first + LENGTH) << np.uint64(first))
        near = errors[low[field & 0xFFF] ^ high[field >> 12]]
        for e in near.T:
            there = everyone[e != 0xFFFFFFFF]
            code = (field ^ e)[there].astype(np.uint64)
            for c, chosen in enumerate(choices):
                bits = code
                for part in chosen:
                    width = edges[part + 1] - edges[part]
                    bits = bits << np.uint64(width) | (rest[there] >> np.uint64(edges[part])) & np.uint64((1 << width) - 1)
                keys.append(bits << np.uint64(6) | np.uint64(f * len(choices) + c))
                index.append(there)
    return np.concatenate(keys), np.concatenate(index)


def _search(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one group: each visit compares with those not reached yet."""
    edges, left = [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                found, left = left[hit], left[~hit]
                queue.extend(found)
                edges += [(x, y) for y in found]
    return edges


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the edges that a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links_of(keys: np.ndarray, prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning edges of the groups in rows sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(sizes > SMALL):
        out += _search(prints[starts[i] : starts[i] + sizes[i]], bits)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, p = keys[few], prints[few]
    a, b = [], []
    for shift in range(1, SMALL):
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        x, y = p[:-shift][same], p[shift:][same]
        close = np.bitwise_count(x ^ y) <= bits
        a.append(x[close])
        b.append(y[close])
    if a:
        out += _forest(np.concatenate(a), np.concatenate(b))
    return out


def _edges(rows: DataFrame, bits: int, limit: int | None) -> DataFrame:
    """Links among rows (key, fp): (a, b, key), with key set instead of links where a group exceeds ``limit``."""

    def scan(batches) -> Iterator:
        import pyarrow as pa

        names = ["a", "b", "key"]
        held_k, held_p, too_large = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def linked(keys, prints):
            edges = links_of(keys, prints, bits) if len(keys) else []
            if edges:
                both = np.array(edges, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=names)

        def deferred(keys, prints):
            own = pa.array(prints.view(np.int64))
            return pa.RecordBatch.from_arrays([own, own, pa.array(keys)], names=names)

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            p = np.concatenate([held_p, batch.column(1).to_numpy().view(np.uint64)])
            if too_large is not None and len(k):  # the rest of a group that has been put off
                n = int(np.searchsorted(k, too_large, side="right"))
                if n:
                    yield deferred(k[:n], p[:n])
                    k, p = k[n:], p[n:]
            if not len(k):
                held_k, held_p = k, p
                continue
            last = int(np.searchsorted(k, k[-1], side="left"))
            if limit and len(k) - last > limit:
                too_large = k[-1]
                yield deferred(k[last:], p[last:])
                held_k, held_p = k[:0], p[:0]
            else:
                held_k, held_p = k[last:], p[last:]
            yield from linked(k[:last], p[:last])
        yield from linked(held_k, held_p)

    return rows.select("key", "fp").mapInArrow(scan, "a long, b long, key long")


def links(prints: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) linked within ``bits`` <= 3 bits.

    Every group of linked fingerprints is connected by the edges; not every
    linked pair is an edge.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover up to 3 bits")

    parts = parts_for(prints.count())

    def replicate(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_numpy()
            for i in range(0, len(own), 1 << 14):
                part = own[i : i + (1 << 14)]
                keys, index = anchor_keys(part.view(np.uint64), parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[index])], names=["key", "fp"])

    rows = prints.select("fp").mapInArrow(replicate, "key long, fp long")
    found = materialize(_edges(rows.repartition("key").sortWithinPartitions("key"), bits, LARGE), "simhash-links")
    out = found.filter("key IS NULL").select("a", "b")
    put_off = found.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if put_off.isEmpty():
        return out.distinct()
    # very large groups: a fingerprint meets each tile of its group in a task of its own
    tiles = put_off.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = put_off.join(tiles, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    more = _edges(dealt.repartition("key").sortWithinPartitions("key"), bits, None).select("a", "b")
    return out.unionByName(materialize(more, "simhash-tiles")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach.

    Large-star and small-star steps in turn (the number of rounds is about the
    logarithm of the longest path); each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "stars")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select("b", "m").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small.coalesce(-(-before[0] // EDGES_A_FILE)), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str, bits: int, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), one row per document; ``root`` names the group."""
    prints = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), fingerprint_column(text_or_empty(text_col), shingle).alias("fp"))
    prints = materialize(prints, "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(distinct, bits=bits))
    labelled = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id), one row per document.

    ``component_id`` is the smallest id that links reach, the document's own
    included. Null and empty texts have fingerprint zero and are linked like
    any other; rows that repeat an id are rows of their own; null ids are never
    the smallest unless a group has no other. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, bits, shingle).drop("text_hash", "root")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id.

    Of rows that share that id, the one with the smallest fingerprint stays, then
    that with the smallest hash of its text; of rows equal in id and text, which
    are reduced in every task before they meet, any one. A group of documents
    without ids keeps one row.
    """
    found = _grouped(docs, id_col, text_col, bits, shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = found.groupBy("root").agg(F.min(F.struct("fp", "text_hash", "doc_id")).alias("x"))  # partial minima: a large group is a row per task
    kept_id, kept_hash = fresh(docs, "kept_id", "kept_hash")
    stay = own.select(F.col("x.doc_id").alias(kept_id), F.col("x.text_hash").alias(kept_hash))
    joined = docs.join(stay, quoted(id_col).eqNullSafe(F.col(kept_id)) & (F.xxhash64(quoted(text_col)) == F.col(kept_hash)))
    return joined.dropDuplicates([kept_id, kept_hash]).select(*(quoted(c) for c in docs.columns))
