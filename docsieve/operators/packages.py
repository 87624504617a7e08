"""Packages of records as graphs and tables: closures, integrity, links, suites, locks on what was written."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import graph
from docsieve.operators import provenance as V

#: Bounds of a closure and of the paths that are listed (fixed values).
MAX_HOPS, MAX_OBJECTS, MAX_BYTES, MAX_PATHS = 3, 64, 1 << 20, 32


def json_paths(rows: DataFrame, key: str, text: str, depth: int = 4) -> DataFrame:
    """(key, path, value): every scalar of nested JSON with its path such as ``a.b[0]``; deeper parts than ``depth`` come as JSON text.

    One level is taken apart at a time; texts that are no JSON give no rows.
    """
    explode = rows.sparkSession.tvf.variant_explode
    level = rows.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")
    done: list[DataFrame] = []
    for i in range(depth + 1):
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        done.append((level if i == depth else level.filter(~nested)).select("k", "path", F.expr("CAST(v AS STRING)").alias("value")))
        if i < depth:
            inner = level.filter(nested).lateralJoin(explode(F.col("v").outer()))
            name = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
            level = inner.select("k", F.concat("path", name).alias("path"), F.col("value").alias("v"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.filter("value IS NOT NULL").withColumnRenamed("k", key)


def closure(edges: DataFrame, seeds: DataFrame, sizes: DataFrame, *, max_hops: int = MAX_HOPS, max_objects: int = MAX_OBJECTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(seed, node, hops, place, taken): what a seed reaches, nearest first and then by name; nodes beyond the bounds on number and bytes are kept as gaps.

    ``sizes`` has node and bytes. Bytes count in order up to and with the node.
    """
    found = graph.reach(edges, seeds, max_hops).join(sizes, "node")
    w = Window.partitionBy("seed").orderBy("hops", "node")
    placed = found.withColumn("place", F.row_number().over(w)).withColumn("sum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.select("seed", "node", "hops", "place", ((F.col("place") <= max_objects) & (F.col("sum") <= max_bytes)).alias("taken"))


def paths_to_roots(edges: DataFrame, nodes: DataFrame, *, max_hops: int | None = None, most: int = MAX_PATHS) -> DataFrame:
    """(node, path, nth): ways from a node along its edges to nodes without any, as ``a>b>c``; shortest first, at most ``most`` a node.

    The bound is what the report asks for and holds at every hop, see :func:`graph.shortest_paths`.
    """
    ends = nodes.select("node").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    ways = graph.shortest_paths(edges, ends, most=most, max_hops=max_hops).join(nodes.select("node").distinct(), "node", "left_semi")
    return ways.select("node", F.array_join("path", ">").alias("path"), "nth")


def graph_issues(nodes: DataFrame, edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(issue, ref): repeated nodes and edges, edges without an end, edges to a wrong kind of node, nodes on cycles.

    Nodes are (node, kind), edges (src, dst, relation); ``kinds`` gives the kind
    of node that a relation must lead to.
    """
    issue = lambda df, name, ref: df.select(F.lit(name).alias("issue"), ref.alias("ref"))
    pair = F.concat_ws(">", "src", "dst")
    wanted = F.element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.col("relation"))
    ends = edges.join(nodes.groupBy(F.col("node").alias("dst")).agg(F.min("kind").alias("kind")), "dst")
    parts = [
        issue(nodes.groupBy("node").count().filter("count > 1"), "duplicate_node", F.col("node")),
        issue(edges.groupBy("src", "dst", "relation").count().filter("count > 1"), "duplicate_edge", pair),
        issue(graph.dangling(edges.select("src", "dst").distinct(), nodes), "dangling_edge", F.concat_ws(":", pair, "missing")),
        issue(ends.filter(wanted.isNotNull() & (wanted != F.col("kind"))).select("src", "dst").distinct(), "wrong_kind", pair),
        issue(graph.cyclic_nodes(edges), "cycle", F.col("node")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def answer_issues(claims: DataFrame, citations: DataFrame, bundle: DataFrame, rules: dict[str, int]) -> DataFrame:
    """(answer, claim, issue): citations outside the answer's bundle, and claims with fewer citations than their kind asks for.

    Claims are (answer, claim, kind), citations (answer, claim, ref), the bundle (answer, ref).
    """
    outside = citations.join(bundle, ["answer", "ref"], "left_anti").select("answer", "claim", F.lit("citation_outside_bundle").alias("issue")).distinct()
    n = citations.groupBy("answer", "claim").agg(F.count_distinct("ref").alias("n"))
    least = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in rules.items() for x in p)), F.col("kind")), F.lit(0))
    few = claims.join(n, ["answer", "claim"], "left").filter(F.coalesce("n", F.lit(0)) < least).select("answer", "claim", F.lit("citations_missing").alias("issue"))
    return outside.unionByName(few)


def cross_links(pairs: DataFrame, records: DataFrame, attributes: list[str]) -> DataFrame:
    """(left_id, right_id, state, reasons): proposed links between packages: unresolved, rejected, deferred with what isn't comparable, or linked.

    Pairs are (left_package, left_id, left_sha, right_...); records (package,
    id, sha, kind, review, attributes). Null attributes can't be compared.
    """
    side = lambda s: records.select(F.col("package").alias(f"{s}_package"), F.col("id").alias(f"{s}_id"), F.col("sha").alias(f"{s}_sha"), F.struct("kind", "review", *attributes).alias(s[0]))
    both = pairs.join(side("left"), ["left_package", "left_id", "left_sha"], "left").join(side("right"), ["right_package", "right_id", "right_sha"], "left")

    def gap(a: str) -> Column:
        x, y = F.col(f"l.{a}"), F.col(f"r.{a}")
        return F.when(x.isNull() | y.isNull(), f"{a}_unknown").when(x != y, f"{a}_differs")

    reasons = F.array_compact(F.array(F.when(F.col("l.kind") != F.col("r.kind"), "kind_differs"), *map(gap, attributes)))
    rejected = (F.col("l.review") == "rejected") | (F.col("r.review") == "rejected")
    state = F.when(F.col("l").isNull() | F.col("r").isNull(), "unresolved").when(rejected, "rejected").when(F.size(reasons) > 0, "deferred").otherwise("linked")
    return both.select("left_id", "right_id", state.alias("state"), F.when(state == "deferred", F.array_join(reasons, ",")).otherwise("").alias("reasons"))


def tiling(spans: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span, n_rows, exact): transcript rows inside a span, and whether they fill it without a gap or overlap.

    Spans are (keys, span, start, end), rows (keys, row_start, row_end).
    """
    inside = spans.join(rows, keys).filter((F.col("row_start") >= F.col("start")) & (F.col("row_end") <= F.col("end")) & (F.col("row_start") < F.col("row_end")))
    w = Window.partitionBy(*keys, "span").orderBy("row_start", "row_end")
    meets = F.col("row_start") == F.coalesce(F.lag("row_end").over(w), F.col("start"))
    seen = inside.withColumn("meets", meets).groupBy(*keys, "span").agg(F.count("*").alias("n_rows"), F.bool_and("meets").alias("gapless"), F.max("row_end").alias("last"))
    both = spans.join(seen, [*keys, "span"], "left")
    return both.select(*keys, "span", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("gapless") & (F.col("last") == F.col("end")), F.lit(False)).alias("exact"))


def nearest_line(spans: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span, line): the line with the largest common part with a span, the first of those (null: none)."""
    common = F.least("end", "line_end") - F.greatest("start", "line_start")
    met = spans.join(lines, keys).withColumn("common", common).filter("common > 0")
    best = met.groupBy(*keys, "span").agg(F.min(F.struct((-F.col("common")).alias("o"), "line"))["line"].alias("line"))
    return spans.select(*keys, "span").join(best, [*keys, "span"], "left")


def nearest_centres(tokens: DataFrame, rows: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """(page, row, col, text): tokens (id, text, x, y) at the nearest row and column of their page, joined from left to right.

    Rows are (page, row, at), columns (page, col, at), a bounded number a page. Ties go to the first.
    """
    near = lambda df, axis, other, name: df.join(other, page).groupBy(*page, "id").agg(F.min(F.struct(F.abs(F.col(axis) - F.col("at")).alias("d"), name))[name].alias(name))
    placed = tokens.join(near(tokens, "y", rows, "row"), [*page, "id"]).join(near(tokens, "x", columns, "col"), [*page, "id"])
    return placed.groupBy(*page, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "id", "text"))), lambda t: t["text"]), " ").alias("text"))


def sealed(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as Parquet under ``path`` and return its lock: (entity, n_rows, fingerprint).

    Nothing is replaced. The fingerprint doesn't hang on the order of rows or files.
    """
    locks = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        locks.append(V.set_fingerprint(df.withColumn("entity", F.lit(name)), ["entity"], df.columns))
    out = locks[0]
    for more in locks[1:]:
        out = out.unionByName(more)
    lock = graph.cut(out)
    lock.write.mode("errorifexists").parquet(f"{path}/manifest")
    return lock


def verified(spark, path: str, entities: list[str]) -> DataFrame:
    """(entity, n_rows, state): what lies under ``path`` against its manifest: verified, changed, or unlisted."""
    manifest = spark.read.parquet(f"{path}/manifest").withColumnRenamed("n_rows", "m").withColumnRenamed("fingerprint", "f")
    parts = []
    for name in entities:
        df = spark.read.parquet(f"{path}/{name}")
        parts.append(V.set_fingerprint(df.withColumn("entity", F.lit(name)), ["entity"], df.columns))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    both = out.join(manifest, "entity", "left")
    state = F.when(F.col("f").isNull(), "unlisted").when((F.col("m") == F.col("n_rows")) & (F.col("f") == F.col("fingerprint")), "verified").otherwise("changed")
    return both.select("entity", "n_rows", state.alias("state"))


def schema_rows(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, field, type, nullable) of tables, from their schemas alone."""
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "entity string, field string, type string, nullable boolean")


def delimited_cells(rows: DataFrame, key: str, text: str, delimiter: str = ",") -> DataFrame:
    """(key, row, col, text) of strictly quoted delimited texts; texts that are ill quoted or ragged give none."""

    @F.pandas_udf("array<array<string>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(value):
            try:
                table = list(csv.reader(io.StringIO(value.removeprefix("﻿"), newline=""), delimiter=delimiter, strict=True))
            except (csv.Error, AttributeError):
                return None
            return table if table and len({len(r) for r in table}) == 1 and table[0] else None

        for texts in batches:
            yield texts.map(one)

    cells = rows.select(key, parsed(F.col(text)).alias("t")).filter("t IS NOT NULL").select(key, F.posexplode("t").alias("row", "r"))
    return cells.select(key, "row", F.posexplode("r").alias("col", "text"))


def html_grid(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, col, row_span, col_span, text) of the first table of a page: cells go to the first free place of their row, past those that reach down from above.

    Tags are cut in Spark; only the placing of a table's cells runs in Python. A
    cell is held as its columns and the row it reaches to, so that memory follows
    the cells of a table and not the spans they claim; a span too large for an
    integer counts as one.
    """
    body = F.regexp_extract(F.col(html), r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    lines = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cut = rows.select(key, lines.alias("lines")).filter(F.size("lines") > 0)
    cell = r"(?is)(<t[dh]\b[^>]*>.*?)</t[dh]>"
    span = lambda c, name: F.greatest(F.coalesce(F.regexp_extract(F.regexp_extract(c, r"(?is)^(<t[dh]\b[^>]*>)", 1), rf'(?i)\b{name}\s*=\s*["\']?(\d+)', 1).try_cast("int"), F.lit(1)), F.lit(1))
    parts = F.flatten(F.transform("lines", lambda r, i: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), lambda c: F.struct(i.alias("row"), span(c, "rowspan").alias("rs"), span(c, "colspan").alias("cs"), T.collapse_space(F.regexp_replace(c, "<[^>]*>", " ")).alias("text")))))

    @F.pandas_udf("array<struct<row:int,col:int,row_span:int,col_span:int,text:string>>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(table):
            reach, out, last, j = [], [], None, 0  # (first column, past the last, past the last row) of cells that reach down
            for c in table:
                i = c["row"]
                if i != last:
                    last, j, reach = i, 0, [r for r in reach if r[2] > i]
                while over := [r for r in reach if r[0] <= j < r[1]]:
                    j = max(r[1] for r in over)
                reach.append((j, j + c["cs"], i + c["rs"]))
                out.append({"row": i, "col": j, "row_span": c["rs"], "col_span": c["cs"], "text": c["text"]})
                j += c["cs"]
            return out

        for tables in batches:
            yield tables.map(one)

    return cut.select(key, parts.alias("t")).select(key, F.inline(placed(F.col("t"))))


def suite(entries: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(case_id, category, prompt, expected): a case per entry and category, with an id that its content fixes.

    A null prompt makes no case.
    """
    cases = F.array_compact(F.array(*(F.when(p.isNotNull(), F.struct(F.lit(c).alias("category"), p.alias("prompt"))) for c, p in categories.items())))
    rows = entries.select("entry_id", F.explode(cases).alias("x")).select("x.category", "x.prompt", F.col("entry_id").alias("expected"))
    return rows.select(T.keyed_id("case", category=F.col("category"), expected=F.col("expected"), prompt=F.col("prompt")).alias("case_id"), "category", "prompt", "expected")


def blind(cases: DataFrame, split: str, answers: list[str]) -> DataFrame:
    """The blind cases without what gives their answers away."""
    return cases.filter(F.col(split) == "blind").drop(split, *answers)


def page_tasks(pages: DataFrame, page: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(page, kind, label): the distinct labels of each kind that a page's text has; a page without any has one task, page-review."""

    def labels(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    found = F.flatten(F.array(*(labels(k, p) for k, p in patterns.items())))
    none = F.array(F.struct(F.lit("page-review").alias("kind"), F.lit("").alias("label")))
    return pages.select(page, found.alias("f")).select(page, F.inline(F.when(F.size("f") > 0, F.col("f")).otherwise(none)))


def outline_resolutions(nodes: DataFrame, pages: DataFrame, *, book: str) -> DataFrame:
    """(book, node, selected_page, status, n_candidates): where an outline's headings really stand.

    Lines from one page before to three after the outline's page that are the
    title, start with it or have it inside are scored: running heads and entries
    of contents low, headings high, less 4 for each page off, 10 more after the
    outline's page. One best line decides; several leave the outline's page.
    Nodes are (book, node, title, start_page), pages (book, page, text).
    """
    lines = pages.select(book, "page", F.posexplode(T.text_lines(F.col("text"))).alias("line", "raw")).select(book, "page", "line", T.canonical_text(F.col("raw")).alias("x"))
    words = F.split("x", " ")
    starts = lines.select(book, "page", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("title"))
    hits = starts.join(nodes.select(book, "title"), [book, "title"]).groupBy(book, "page").agg(F.count("*").alias("sibling_hits"))
    wanted = nodes.select(book, "node", "title", "start_page", F.explode(F.sequence(F.greatest(F.col("start_page") - 1, F.lit(1)), F.col("start_page") + 3)).alias("page"))
    met = wanted.join(lines, [book, "page"]).filter(F.contains("x", "title")).join(hits, [book, "page"], "left")
    exact, prefixed = F.col("x") == F.col("title"), F.startswith("x", F.concat("title", F.lit(" ")))
    trailing = prefixed & F.substring("x", F.length("title") + 1, F.length("x")).rlike(r"(?U)\s+\d{1,4}$")
    here = F.col("page") == F.col("start_page")
    points = (
        F.when(trailing, F.when(F.col("line") <= 2, 18).otherwise(8))
        .when(exact, F.when(here & (F.coalesce("sibling_hits", F.lit(0)) >= 3) & (F.col("line") <= 8), 12).when(here & (F.col("line") <= 1), 82).otherwise(100)).otherwise(20)
    )
    score = points - 4 * F.abs(F.col("page") - F.col("start_page")) + F.when(F.col("page") > F.col("start_page"), 10).otherwise(0)
    best = met.withColumn("score", score).groupBy(book, "node", "score").agg(F.count("*").alias("n"), F.min("page").alias("page")).groupBy(book, "node").agg(F.max(F.struct("score", "n", "page")).alias("top"), F.sum("n").alias("n_candidates"))
    both = nodes.join(best, [book, "node"], "left")
    status = F.when(F.col("top").isNull(), "outline-fallback").when(F.col("top.n") == 1, "resolved").otherwise("ambiguous")
    return both.select(book, "node", F.when(status == "resolved", F.col("top.page")).otherwise(F.col("start_page")).alias("selected_page"), status.alias("status"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
