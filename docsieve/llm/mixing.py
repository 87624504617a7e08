"""Mixing sources to target weights by pivotal dependent rounding.

Everything here is DataFrame functions. A source's documents need a common
real number of copies f; each gets floor(f) copies, and the fraction left over
is rounded by the pivotal method, with masses counted in words: a document is
paired with the pool of the smaller ones of its chunk and one side passes mass
to the other, with chances that leave every expectation unchanged, until the
document (or the whole pool) is integral. Going from the largest document to
the smallest, a chunk ends with one fractional document at most, as a rule its
smallest. Those residuals meet in chunks of the next level, a reduction tree
that ends with one document per source.

Where the document at the root is large for its source, so that drawing it or
not misses the target by more than a stated share, a few documents of that
source take one copy more or less afterwards, the largest that fit first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, word_count

SEED = 5_009
#: No source is repeated more often than this.
MAX_COPIES = 3
#: Documents that one fold takes at most, but for chance: chunks are dealt by hash.
FAN_IN = 128
#: Share of its target by which a source may miss it before copies are evened out; documents looked at for that, in so many rounds.
SHARE, EVENED, ROUNDS = 0.005, 64, 4


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Rows (source, source_size, n_docs, target), one per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
    share all words; a source's target stops at ``max_copies`` times its size
    and the excess goes to the others by weight. The final shares are the
    level L at which the sum of least(cap, L * weight) is the total: sorted by
    cap / weight, the capped sources are a prefix, found with running sums.
    One task sorts the table of sources, one narrow row each: meant for up to
    some millions of sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    ranked = by_source.select(
        "*",
        ((F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double").alias("weight"),
        (F.col("source_size") * max_copies).cast("double").alias("cap"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
    )
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    stepped = ranked.withColumn("level", level)
    fits = stepped.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    # the first source that is not capped fixes the level of all after it
    return fits.withColumn("level", F.first("fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


#: What a document carries through the tree, and a row of it with its open mass in words.
DOC = "struct<doc_id:{},source:string,size:bigint,h:bigint,nth:bigint,source_size:bigint,target:double,base:int>"
ROW = "struct<size:bigint,tie:bigint,mass:double,doc:{}>"


#: Words below which a mass counts as none.
EPS = 1e-6


def _fold(level: int, doc: str) -> Column:
    """Fold of a chunk's array ``docs`` of ROW: the rows settled so far as ``done``
    and the one that still holds a fraction as ``open``.

    ``mass`` and ``size`` are the sums over the rows still to come. What the
    pool has given or got changes the share p of each of its rows to
    scale * p + shift, so two numbers stand for all its transfers. ``doc`` is
    the type of a document.
    """
    done_type, row_type = f"array<struct<doc:{doc},extra:int>>", ROW.format(doc)

    def step(state: Column, a: Column) -> Column:
        size = a["size"].cast("double")
        mass = F.least(size, F.greatest(F.lit(0.0), state["scale"] * a["mass"] + state["shift"] * size))
        pool_size = state["size"] - size
        pool_mass = F.least(pool_size, F.greatest(F.lit(0.0), state["mass"] - mass))
        pool_room, room = pool_size - pool_mass, size - mass
        gain, loss = F.least(room, pool_mass), F.least(mass, pool_room)
        gains = _uniform(F.lit(level), a["tie"]) * (gain + loss) < loss

        def result(scale: Column, shift: Column, moved: Column, extra: int | None = None, left: Column | None = None) -> Column:
            done = [] if extra is None else [F.struct(a["doc"].alias("doc"), F.lit(extra).alias("extra"))]
            open_row = state["open"] if left is None else F.struct(a["size"].alias("size"), a["tie"].alias("tie"), left.alias("mass"), a["doc"].alias("doc"))
            return F.struct(
                scale.alias("scale"), shift.alias("shift"), (pool_mass + moved).alias("mass"), pool_size.alias("size"),
                F.concat(state["done"], F.array(*done).cast(done_type)).alias("done"), open_row.alias("open"),
            )

        nothing = F.lit(0.0)
        keep = 1 - gain / F.greatest(pool_mass, F.lit(EPS))  # the pool gives `gain`, each row in proportion to its mass
        fill = loss / F.greatest(pool_room, F.lit(EPS))  # the pool gets `loss`, each row in proportion to its room
        scale, shift = state["scale"], state["shift"]
        return (
            F.when(mass < EPS, result(scale, shift, nothing, 0))
            .when(room < EPS, result(scale, shift, nothing, 1))
            .when((pool_mass < EPS) & (pool_room < EPS), result(nothing, nothing, nothing, left=mass))
            .when(gains & (room <= pool_mass), result(scale * keep, shift * keep, -gain, 1))
            .when(gains, result(nothing, nothing, -gain, left=mass + gain))  # the pool is empty now
            .when(mass <= pool_room, result(scale * (1 - fill), shift * (1 - fill) + fill, loss, 0))
            .otherwise(result(nothing, nothing + 1, loss, left=mass - loss))  # the pool is full now
        )

    total = lambda what: F.aggregate("docs", F.lit(0.0), lambda s, x: s + x[what])
    start = F.struct(
        F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), total("mass").alias("mass"), total("size").alias("size"),
        F.array().cast(done_type).alias("done"), F.lit(None).cast(row_type).alias("open"),
    )
    return F.aggregate("docs", start, step)


def copies(sized: DataFrame, *, fan_in: int = FAN_IN, max_copies: int = MAX_COPIES) -> DataFrame:
    """How often the mix takes each document.

    ``sized`` is what :func:`sized_documents` gives; it is written out once, and
    everything follows from that. Returns its columns, source_size, target and
    copies, one row per row of ``sized``; ids keep their type. Each document has
    floor(f) or ceil(f) copies, f being the share that its source's target asks
    for. The document left at the root of a source's tree may be any of it; where
    drawing it misses the target by over SHARE, :func:`_evened` brings the source
    nearer. Where none is missed so far, as in sources without a document
    of over SHARE of the target, the mean copies are those of the pivotal method.
    Documents of size 0 get no copies. Repeated rows count each by itself. An
    empty table gives an empty result.
    """
    sized = materialize(sized, "mix-sized")
    doc = DOC.format(sized.schema["doc_id"].dataType.simpleString())
    targets = source_targets(sized, max_copies)
    f = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    # source_size and n_docs follow the number of sources; Spark broadcasts them if they are small
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "d.h", "d.nth", "source_size", "n_docs", "target", f.alias("f"))
    rows = rows.withColumn("base", F.floor("f").cast("int")).withColumn("mass", F.when(F.col("f") >= max_copies, F.lit(0.0)).otherwise((F.col("f") - F.floor("f")) * F.col("size")))
    final = ["doc_id", "source", "size", "h", "nth", "source_size", "target"]

    whole = rows.filter((F.col("mass") <= 0) | (F.col("size") <= 0)).select(*final, F.when(F.col("size") > 0, F.col("base")).otherwise(0).cast("int").alias("copies"))
    open_rows = rows.filter((F.col("mass") > 0) & (F.col("size") > 0)).select(
        "source",
        F.ceil(F.col("n_docs") / fan_in).alias("chunks"),
        F.struct("size", F.xxhash64(F.lit(SEED), "doc_id", "h", "nth").alias("tie"), "mass", F.struct(*final, "base").alias("doc")).cast(ROW.format(doc)).alias("row"),
    )
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0  # one number: it fixes the depth of the tree
    done, level = [whole], 0
    while True:
        chunk = F.pmod(F.xxhash64(F.lit(SEED + 1 + level), F.col("row.tie")), F.col("chunks"))
        folded = (
            open_rows.withColumn("chunk", chunk)
            .groupBy("source", "chunk", "chunks")
            .agg(F.sort_array(F.collect_list("row"), asc=False).alias("docs"))
            .select("source", "chunks", _fold(level, doc).alias("state"))
        )
        folded = materialize(folded, f"mix-level{level}")
        done.append(folded.select(F.inline("state.done")).select(*(F.col(f"doc.{c}").alias(c) for c in final), (F.col("doc.base") + F.col("extra")).alias("copies")))
        open_rows = folded.filter(F.col("state.open").isNotNull()).select("source", F.ceil(F.col("chunks") / fan_in).alias("chunks"), F.col("state.open").alias("row"))
        level += 1
        if most <= fan_in:  # this level had one chunk per source
            break
        most = -(-most // fan_in)
    # the root: one document of each source still holds a fraction; it is drawn with that chance
    drawn = (_uniform(F.lit(-1), F.col("row.tie")) < F.col("row.mass") / F.col("row.size")).cast("int")
    done.append(open_rows.select(*(F.col(f"row.doc.{c}").alias(c) for c in final), (F.col("row.doc.base") + drawn).alias("copies")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _evened(out, max_copies)


def _evened(drawn: DataFrame, max_copies: int) -> DataFrame:
    """``drawn`` with sources that miss their targets by over SHARE brought nearer.

    Of the documents that may still go from floor(f) to ceil(f) copies, or back,
    and aren't larger than what is missing, the EVENED largest of a source are
    looked at, picked in part before the shuffle; each in turn changes if it
    fits what is left. A round ends below the smallest of them that was
    passed over, or has used them all; what is missing then shrinks on in the
    next round. Sources that are near enough take no part.
    """
    out = materialize(drawn, "mix-drawn")
    key = ["doc_id", "source", "h", "nth"]
    f = F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))
    base, tie = F.floor(f), F.xxhash64(F.lit(SEED + 1), "doc_id", "h", "nth")
    for _ in range(ROUNDS):
        sums = out.groupBy(F.col("source").alias("k")).agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"))
        off = sums.select("k", (F.col("t") - F.col("taken")).alias("gap")).filter(F.abs("gap") > SHARE * F.col("t"))
        may = F.when(F.col("gap") > 0, (F.col("copies") == base) & (base < f)).otherwise(F.col("copies") == base + 1)
        rows = out.join(off, F.col("source").eqNullSafe(F.col("k"))).filter((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & may).select(*key, "size", "gap", tie.alias("tie"))
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("size").desc(), "tie", "doc_id", "nth"))
        some = rows.withColumn("place", place).filter(F.col("place") <= EVENED)
        lists = some.groupBy("source").agg(F.max("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("place", "size", *(F.col(c).alias(f"k_{c}") for c in key)))).alias("rows"))
        picked = F.array().cast(dict(lists.dtypes)["rows"])
        fits = lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["picked"], F.array(x)).alias("picked"))).otherwise(s)
        chosen = F.aggregate("rows", F.struct(F.abs("gap").alias("left"), picked.alias("picked")), fits)["picked"]
        changes = lists.select(F.signum("gap").cast("int").alias("change"), F.inline(chosen)).select("change", *(f"k_{c}" for c in key))
        changes = materialize(changes, "mix-changes")  # at most EVENED rows a source
        if changes.isEmpty():
            return out
        same = F.lit(True)
        for c in key:
            same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
        out = materialize(out.join(changes, same, "left").select(*(c for c in out.columns if c != "copies"), (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int").alias("copies")), "mix-evened")
    return out


def sized_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id (of its own type), source, size (words; null text: 0), h (hash of the text) and nth (1, 2, ... among rows that share all of these)."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(quoted(text_col)).alias("h"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("size")).cast("long"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_copies: int = MAX_COPIES, fan_in: int = FAN_IN) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as :func:`copies` says, all columns kept.

    Rows that share id, source and text take each other's copies in any order; a
    null id, source or text is a value like any other. Only such repeated rows
    are numbered, all others meet their copies in one join.
    """
    h, nth, times, n, k_id, k_source, k_h, k_nth = fresh(docs, "h", "nth", "copies", "copy_no", "k_id", "k_source", "k_h", "k_nth")
    plan = copies(sized_documents(docs, id_col=id_col, source_col=source_col, text_col=text_col), fan_in=fan_in, max_copies=max_copies)
    plan = plan.groupBy(F.col("doc_id").alias(k_id), F.col("source").alias(k_source), F.col("h").alias(k_h)).agg(F.collect_list(F.struct(F.col("nth").alias(k_nth), F.col("copies").alias(times))).alias("each"))
    plan = materialize(plan, "mix-copies")
    hashed = docs.withColumn(h, F.xxhash64(quoted(text_col)))
    same = quoted(id_col).eqNullSafe(F.col(k_id)) & quoted(source_col).cast("string").eqNullSafe(F.col(k_source)) & (F.col(h) == F.col(k_h))

    alone = plan.filter((F.size("each") == 1) & (F.col("each")[0][times] > 0)).select(k_id, k_source, k_h, F.col("each")[0][times].alias(times))
    out = hashed.join(alone, same)
    repeated = plan.filter(F.size("each") > 1)
    rows = hashed.join(repeated.select(k_id, k_source, k_h), same, "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(quoted(id_col), quoted(source_col), h).orderBy(h)))
    again = rows.join(repeated.select(k_id, k_source, k_h, F.inline("each")), same & (F.col(nth) == F.col(k_nth))).filter(F.col(times) > 0)
    wanted = [*(quoted(c) for c in docs.columns), F.col(times)]
    both = out.select(*wanted).unionByName(again.select(*wanted))
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(quoted(c) for c in docs.columns))
