"""A stored inverted index: postings on disk by ranges of terms, segments that append and merge, exact top-k search with upper bounds.

``folder`` holds ``postings/segment=.../bucket=...`` (sorted by term), ``entries``
and ``terms`` of each segment, and ``manifest/version=...``, which names the
segments of a version. A version is written once; of two writers one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.functions import text as T
from docsieve.operators import graph
from docsieve.operators.retrieval import EXACT, GLYPH

#: Postings of a query's rarest terms that its first pass may read, beyond its first term; only a matter of speed.
FIRST_POSTINGS = 10_000


@dataclass(frozen=True)
class Index:
    """A version of an index; ``id_type`` is the type of entry ids, ``attributes`` a DDL of what filters may use."""

    spark: SparkSession
    folder: str
    version: int
    segments: tuple[str, ...]
    id_type: str
    attributes: str
    buckets: int

    def _read(self, part: str, ddl: str) -> DataFrame:
        schema = StructType.fromDDL(ddl)
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        return rows.filter(F.col("segment").isin(*self.segments)).drop("segment")

    def postings(self) -> DataFrame:
        """(term, entry_id, weight, attributes, bucket)"""
        return self._read("postings", f"term string, entry_id {self.id_type}, weight int, {self.attributes + ', ' if self.attributes else ''}segment string, bucket int")

    def entries(self) -> DataFrame:
        """(entry_id, digest, n_terms, attributes)"""
        return self._read("entries", f"entry_id {self.id_type}, digest string, n_terms int, {self.attributes + ', ' if self.attributes else ''}segment string")

    def terms(self) -> DataFrame:
        """(term, n, most, bucket): of each segment, how many entries have the term, and its largest weight"""
        return self._read("terms", "term string, n long, most int, bucket int, segment string")


def science_terms(text: Column, entry_id: Column) -> Column:
    """Terms of an object for :func:`build`: words count 1, glyphs of formulas GLYPH, the exact id EXACT."""
    weighted = lambda tokens, kind, w: F.transform(tokens, lambda t: F.struct(F.concat(F.lit(kind), t).alias("term"), F.lit(w).alias("weight")))
    text = F.coalesce(text, F.lit(""))
    own = F.array(F.struct(F.concat(F.lit("x:"), entry_id.cast("string")).alias("term"), F.lit(EXACT).alias("weight")))
    return F.concat(weighted(T.natural_tokens(text), "n:", 1), weighted(T.math_tokens(text), "m:", GLYPH), own)


def science_question(prompt: Column) -> Column:
    """Terms of a question for :func:`search`; the whole question may be an id."""
    kind = lambda tokens, k: F.transform(tokens, lambda t: F.concat(F.lit(k), t))
    prompt = F.coalesce(prompt, F.lit(""))
    return F.concat(kind(T.natural_tokens(prompt), "n:"), kind(T.math_tokens(prompt), "m:"), F.array(F.concat(F.lit("x:"), prompt)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _formed(entries: DataFrame, entry_id: str, terms: Column, attributes: Sequence[str]) -> DataFrame:
    """(entry_id, terms sorted, attributes, digest)"""
    rows = entries.filter(F.col(entry_id).isNotNull()).select(F.col(entry_id).alias("entry_id"), F.array_sort(terms).alias("terms"), *attributes)
    said = F.to_json(F.struct("terms", *attributes), {"ignoreNullFields": "false"})
    return rows.withColumn("digest", F.sha2(said, 256))


def _write(rows: DataFrame, folder: str, buckets: int, attributes: Sequence[str]) -> str:
    """Writes a segment of (entry_id, terms, attributes, digest); its name.

    Terms are made once and written, since entries and postings both read them.
    Postings are rebalanced by bucket: adaptive execution splits the bucket of a
    term that most entries have, and joins small ones.
    """
    spark, segment = rows.sparkSession, f"s{uuid.uuid4().hex}"
    entries = f"{folder}/entries/segment={segment}"
    rows = graph.cut(rows)
    rows.select("entry_id", "digest", F.size("terms").alias("n_terms"), *attributes).write.parquet(entries)
    if not spark.read.parquet(entries).groupBy("entry_id").count().filter("count > 1").isEmpty():
        raise ValueError("an entry id is there more than once")
    posted = rows.select(F.explode("terms").alias("t"), "entry_id", *attributes).select("t.term", "entry_id", F.col("t.weight").cast("int").alias("weight"), *attributes)
    posted = posted.withColumn("bucket", _bucket(F.col("term"), buckets))
    posted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "entry_id").write.partitionBy("bucket").parquet(f"{folder}/postings/segment={segment}")
    schema = StructType([f for f in posted.schema if f.name in ("term", "weight", "bucket")])
    back = spark.read.schema(schema).parquet(f"{folder}/postings/segment={segment}")
    stats = back.groupBy("bucket", "term").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    stats.sortWithinPartitions("bucket", "term").write.parquet(f"{folder}/terms/segment={segment}")
    return segment


def _commit(index: Index, segments: tuple[str, ...]) -> Index:
    """The next version; an error if another writer was first."""
    version = index.version + 1
    row = [(",".join(segments), index.id_type, index.attributes, index.buckets)]
    index.spark.createDataFrame(row, "segments string, id_type string, attributes string, buckets int").coalesce(1).write.parquet(f"{index.folder}/manifest/version={version}")
    return Index(index.spark, index.folder, version, segments, index.id_type, index.attributes, index.buckets)


def build(entries: DataFrame, folder: str, *, entry_id: str, terms: Column, attributes: Sequence[str] = (), buckets: int = 64) -> Index:
    """Version 1 of an index in a new ``folder`` that all machines share.

    ``terms`` is an array of structs (term, weight) without repeated terms;
    ``attributes`` are columns for filters. Rows without an id are left out; an
    id that repeats is an error; an entry without terms is kept, but no search finds it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
    ddl = ", ".join(f"`{a}` {kinds[a]}" for a in attributes)
    empty = Index(entries.sparkSession, folder.rstrip("/"), 0, (), kinds[entry_id], ddl, buckets)
    return _commit(empty, (_write(_formed(entries, entry_id, terms, attributes), empty.folder, buckets, attributes),))


def opened(spark: SparkSession, folder: str) -> Index:
    """The latest version in ``folder``."""
    folder = folder.rstrip("/")
    last = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
    return Index(spark, folder, int(last["version"]), tuple(s for s in last["segments"].split(",") if s), last["id_type"], last["attributes"], last["buckets"])


def _names(index: Index) -> list[str]:
    return StructType.fromDDL(index.attributes).names if index.attributes else []


def append(index: Index, entries: DataFrame, *, entry_id: str, terms: Column) -> Index:
    """The next version, with ``entries`` as a segment of its own; nothing else is read but ids. An id that is there already is an error."""
    rows = _formed(entries, entry_id, terms, _names(index))
    if not index.entries().select("entry_id").join(rows.select("entry_id"), "entry_id", "left_semi").isEmpty():
        raise ValueError("an entry id is in the index already")
    return _commit(index, (*index.segments, _write(rows, index.folder, index.buckets, _names(index))))


def merged(index: Index) -> Index:
    """The next version, with all segments as one; older versions stay readable."""
    attributes = _names(index)
    segment = f"s{uuid.uuid4().hex}"
    index.entries().write.parquet(f"{index.folder}/entries/segment={segment}")
    posted = index.postings().select("term", "entry_id", "weight", *attributes, "bucket")
    posted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "entry_id").write.partitionBy("bucket").parquet(f"{index.folder}/postings/segment={segment}")
    stats = index.terms().groupBy("bucket", "term").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    stats.sortWithinPartitions("bucket", "term").write.parquet(f"{index.folder}/terms/segment={segment}")
    return _commit(index, (segment,))


def stale(index: Index, entries: DataFrame, *, entry_id: str, terms: Column) -> DataFrame:
    """(entry_id, problem): where the index isn't that of ``entries``: missing (in the index), extra, or changed (terms, weights or attributes)."""
    now = _formed(entries, entry_id, terms, _names(index)).select("entry_id", F.col("digest").alias("now"))
    both = index.entries().select("entry_id", "digest").join(now, "entry_id", "full")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("now").isNull(), "extra").when(F.col("digest") != F.col("now"), "changed")
    return both.select("entry_id", problem.alias("problem")).filter("problem IS NOT NULL")


def search(index: Index, questions: DataFrame, *, query_id: str, terms: Column, limit: int, allowed: Column | None = None, first_postings: int = FIRST_POSTINGS) -> DataFrame:
    """(query_id, entry_id, score, matched, place): the best ``limit`` entries of each question by the weights of common terms.

    ``terms`` is an array of texts over ``questions``; ``allowed`` a condition on
    the index's attributes and the columns of ``questions``, where null forbids.
    Ties go to the smaller SHA-256 of the id. Ids of questions are unique.

    Only buckets with a term of a question are read. A question's rarest terms
    come first and give a bound, its ``limit``-th best score so far. Terms so
    common and light that no entry with them alone can reach that bound are then
    looked up only for entries already found, so they make no new pairs. The
    result is that of scoring everything.
    """
    asked = questions.filter(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms)).alias("term"))
    asked = asked.withColumn("bucket", _bucket(F.col("term"), index.buckets))
    known = index.terms().groupBy("bucket", "term").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    order = Window.partitionBy("query_id").orderBy("n", "term")
    wanted = graph.cut(
        asked.join(known, ["bucket", "term"])
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("bound", F.sum("most").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # at most as many numbers as the index has buckets
    needed = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    posted = index.postings().filter(F.col("bucket").isin(*needed)) if needed else index.postings().limit(0)
    asking = questions.withColumn("query_id", F.col(query_id))
    asking = asking.select("query_id", *(c for c in questions.columns if c != "query_id" and c not in posted.columns))

    def met(of: DataFrame) -> DataFrame:
        rows = posted.join(of.select("query_id", "bucket", "term"), ["bucket", "term"])
        if allowed is not None:
            rows = rows.join(asking, "query_id").filter(allowed)
        return rows.groupBy("query_id", "entry_id").agg(F.sum("weight").alias("score"), F.collect_list("term").alias("matched"))

    is_first = F.col("before") < first_postings
    begun = graph.cut(met(wanted.filter(is_first)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    leading = begun.select("query_id", "score", F.row_number().over(best).alias("nth")).filter(F.col("nth") <= limit)
    floors = leading.groupBy("query_id").agg(F.max(F.when(F.col("nth") == limit, F.col("score"))).alias("floor"))
    judged = wanted.filter(~is_first).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    judged = graph.cut(judged.withColumn("opens", F.col("bound") >= F.col("floor")))
    more = met(judged.filter("opens"))
    found = begun.unionByName(more).groupBy("query_id", "entry_id").agg(F.sum("score").alias("score"), F.flatten(F.collect_list("matched")).alias("matched"))
    closing = judged.filter("NOT opens")
    rest = closing.groupBy("query_id").agg(F.max("bound").alias("rest"), F.max("floor").alias("floor"))
    live = found.join(rest, "query_id", "left").filter(F.col("rest").isNull() | (F.col("score") + F.col("rest") >= F.col("floor"))).select("query_id", "entry_id", "score", "matched")
    live = graph.cut(live)
    looked = live.select("query_id", "entry_id").join(closing.select("query_id", "bucket", "term"), "query_id")
    late = looked.join(posted.select("bucket", "term", "entry_id", "weight"), ["bucket", "term", "entry_id"])
    late = late.select("query_id", "entry_id", F.col("weight").cast("long").alias("score"), F.array("term").alias("matched"))
    total = live.unionByName(late).groupBy("query_id", "entry_id").agg(F.sum("score").alias("score"), F.array_sort(F.flatten(F.collect_list("matched"))).alias("matched"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.sha2(F.col("entry_id").cast("string"), 256))
    return total.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= limit)
