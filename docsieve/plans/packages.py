"""Queries on packages, graphs, suites, grids and sealed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.operators import graph
from docsieve.operators import packages as K
from docsieve.plans.registry import query, table

# nested JSON


@query("""SELECT event_id, path, value FROM (SELECT event_id, unnest(['id', 'tags[0]', 'tags[1]', 'user.name', 'user.props.k']) AS path, unnest([event_id::VARCHAR, event_type, 'x', user_id::VARCHAR, json_extract_string(props, '$.k')]) AS value FROM events)""")
def json_paths(spark, sf_dir):
    """Events as nested JSON, flattened to paths."""
    raw = F.concat(F.lit('{"id":'), "event_id", F.lit(',"tags":["'), "event_type", F.lit('","x"],"user":{"name":"'), "user_id", F.lit('","props":'), "props", F.lit(',"none":null}}'))
    return K.json_paths(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "event_id", "raw")


@query("""SELECT event_id, 'user.password' AS path FROM events WHERE event_id % 9 = 0""")
def forbidden_keys(spark, sf_dir):
    raw = F.concat(F.lit('{"user":{"'), F.when(F.col("event_id") % 9 == 0, "password").otherwise("name"), F.lit('":"x"}}'))
    found = K.json_paths(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "event_id", "raw")
    return found.filter(F.lower("path").rlike(r"(^|\.)(password|secret|answer)$")).select("event_id", "path")


# graphs of places: customers and suppliers depend on nations, these on regions


def _edges(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    edge = lambda t, kind, key, to, ref: table(spark, sf_dir, t).select(name(kind, key).alias("src"), name(to, ref).alias("dst"))
    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


def _nodes(spark, sf_dir):
    node = lambda t, kind, key: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("node"), F.lit(t).alias("kind"))
    return node("customer", "c", "c_custkey").unionByName(node("supplier", "s", "s_suppkey")).unionByName(node("nation", "n", "n_nationkey")).unionByName(node("region", "r", "r_regionkey"))


@query("""WITH f AS (SELECT 'r:' || r_regionkey AS seed, 'r:' || r_regionkey AS node, 0 AS hops, 10 AS bytes FROM region UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey, 1, 20 FROM nation
  UNION ALL SELECT 'r:' || n_regionkey, 'c:' || c_custkey, 2, 30 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r:' || n_regionkey, 's:' || s_suppkey, 2, 40 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT *, row_number() OVER w AS place, sum(bytes) OVER (PARTITION BY seed ORDER BY hops, node ROWS UNBOUNDED PRECEDING) AS s FROM f WINDOW w AS (PARTITION BY seed ORDER BY hops, node))
SELECT seed, node, hops, place::INT AS place, place <= 64 AND s <= 800 AS taken FROM p""")
def bounded_closure(spark, sf_dir):
    """What each region holds, up to 64 objects and 800 bytes; the rest are gaps."""
    back = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    size = F.when(F.col("kind") == "region", 10).when(F.col("kind") == "nation", 20).when(F.col("kind") == "customer", 30).otherwise(40)
    sizes = _nodes(spark, sf_dir).select("node", size.alias("bytes"))
    return K.closure(back, sizes.filter("node LIKE 'r:%'").select("node"), sizes, max_bytes=800)


@query("""SELECT 'c:' || c_custkey AS node, 'c:' || c_custkey || '>n:' || c_nationkey || '>r:' || n_regionkey AS path, 1 AS nth FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 's:' || s_suppkey, 's:' || s_suppkey || '>n:' || s_nationkey || '>r:' || n_regionkey, 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'n:' || n_nationkey, 'n:' || n_nationkey || '>r:' || n_regionkey, 1 FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'r:' || r_regionkey, 1 FROM region""")
def paths_to_roots(spark, sf_dir):
    return K.paths_to_roots(_edges(spark, sf_dir), _nodes(spark, sf_dir).select("node"), max_hops=3)


@query("""SELECT 'duplicate_node' AS issue, 'r:' || r_regionkey AS ref FROM region UNION ALL SELECT 'duplicate_edge', 'n:' || n_nationkey || '>r:' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'dangling_edge', 'n:' || n_nationkey || '>x:' || n_nationkey || ':dst' FROM nation UNION ALL SELECT 'wrong_kind', 'c:' || c_custkey || '>n:' || c_nationkey FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 'cycle', 'r:0' UNION ALL SELECT 'cycle', 'r:1'""")
def graph_issues(spark, sf_dir):
    """The graph of places with regions twice, some edges twice, edges to nowhere, wrong relations and a cycle of two regions."""
    edges = _edges(spark, sf_dir)
    typed = edges.withColumn("relation", F.when(F.col("src").startswith("c:") & F.col("src").endswith("0"), "in-region").otherwise("in-nation")).withColumn("relation", F.when(F.col("dst").startswith("r:"), "in-region").otherwise(F.col("relation")))
    again = typed.filter("src LIKE 'n:%' AND CAST(substr(src, 3) AS INT) % 2 = 0")
    lost = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("x:"), "n_nationkey").alias("dst"), F.lit("other").alias("relation"))
    loop = spark.createDataFrame([("r:0", "r:1", "other"), ("r:1", "r:0", "other")], "src string, dst string, relation string")
    nodes = _nodes(spark, sf_dir)
    found = K.graph_issues(nodes.unionByName(nodes.filter("kind = 'region'")), typed.unionByName(again).unionByName(lost).unionByName(loop), {"in-nation": "nation", "in-region": "region"})
    return found


# answers, links, suites


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS answer, l_linenumber AS claim, l_partkey AS ref FROM lineitem), cl AS (SELECT l_orderkey AS answer, l_linenumber AS claim, min(l_returnflag) AS kind FROM lineitem GROUP BY ALL)
SELECT DISTINCT answer, claim, 'citation_outside_bundle' AS issue FROM c WHERE ref % 10 = 3 UNION ALL
SELECT answer, claim, 'citations_missing' FROM cl JOIN (SELECT answer, claim, count(DISTINCT ref) AS n FROM c GROUP BY ALL) USING (answer, claim) WHERE kind = 'R' AND n < 2""")
def answer_issues(spark, sf_dir):
    """Orders as answers, line numbers as claims, parts as citations; a claim that was returned needs two."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("claim"), F.col("l_partkey").alias("ref"), "l_returnflag")
    claims = lines.groupBy("answer", "claim").agg(F.min("l_returnflag").alias("kind"))
    cited = lines.select("answer", "claim", "ref")
    return K.answer_issues(claims, cited, cited.filter("ref % 10 <> 3").select("answer", "ref").distinct(), {"R": 2})


@query("""SELECT c_custkey AS left_id, s_suppkey AS right_id, CASE WHEN c_custkey % 11 = 0 THEN 'unresolved' WHEN s_acctbal < 0 OR c_acctbal < -500 THEN 'rejected' WHEN c_nationkey <> s_nationkey OR c_mktsegment = 'BUILDING' THEN 'deferred' ELSE 'linked' END AS state,
CASE WHEN c_custkey % 11 = 0 OR s_acctbal < 0 OR c_acctbal < -500 THEN '' ELSE concat_ws(',', CASE WHEN c_nationkey <> s_nationkey THEN 'nation_differs' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment_unknown' END) END AS reasons FROM customer JOIN supplier ON c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey""")
def cross_links(spark, sf_dir):
    """Customers and suppliers as records of two packages, linked where nation and segment allow it."""
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("package"), F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("sha"), F.lit("firm").alias("kind"), F.when(F.col("c_acctbal") < -500, "rejected").otherwise("ok").alias("review"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_mktsegment") != "BUILDING", "any").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("package"), F.col("s_suppkey").alias("id"), F.sha2("s_name", 256).alias("sha"), F.lit("firm").alias("kind"), F.when(F.col("s_acctbal") < 0, "rejected").otherwise("ok").alias("review"), F.col("s_nationkey").alias("nation"), F.lit("any").alias("segment"))
    left = c.select(F.col("package").alias("left_package"), F.col("id").alias("left_id"), F.when(F.col("id") % 11 == 0, "old").otherwise(F.col("sha")).alias("left_sha"))
    pairs = left.join(s.select(F.col("package").alias("right_package"), F.col("id").alias("right_id"), F.col("sha").alias("right_sha")), F.col("left_id") % F.lit(s.agg(F.max("id") + 1).first()[0] or 1) == F.col("right_id"))
    return K.cross_links(pairs, c.unionByName(s), ["nation", "segment"])


@query("""WITH k AS (SELECT 'p-' || p_partkey AS e, unnest(['title', 'type', 'size']) AS category, unnest([p_name, 'What is ' || p_type || '?', CASE WHEN p_size > 25 THEN 'How large is ' || p_name || '?' END]) AS prompt FROM part)
SELECT 'case-' || left(sha256('{"category":"' || category || '","expected":"' || e || '","prompt":"' || prompt || '"}'), 24) AS case_id, category, prompt, e AS expected FROM k WHERE prompt IS NOT NULL""")
def competency_suite(spark, sf_dir):
    return K.suite(_parts(spark, sf_dir), _categories())


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("entry_id"), "p_name", "p_type", "p_size")


def _categories():
    text = lambda *parts: F.concat(*parts)
    return {"title": F.col("p_name"), "type": text(F.lit("What is "), F.col("p_type"), F.lit("?")), "size": F.when(F.col("p_size") > 25, text(F.lit("How large is "), F.col("p_name"), F.lit("?")))}


@query("""SELECT category, prompt, count(*) AS n FROM (SELECT 'title' AS category, p_name AS prompt FROM part UNION ALL SELECT 'size', 'How large is ' || p_name || '?' FROM part WHERE p_size > 25) GROUP BY ALL""")
def blind_cases(spark, sf_dir):
    """Cases of a suite without their answers; the types' cases are open."""
    cases = K.suite(_parts(spark, sf_dir), _categories()).withColumn("split", F.when(F.col("category") == "type", "open").otherwise("blind"))
    return K.blind(cases, "split", ["expected", "case_id"]).groupBy("category", "prompt").agg(F.count("*").alias("n"))


# spans, grids, charts


@query("""WITH t AS (SELECT conv_id, turn, coalesce(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, coalesce(length(text), 0) + 1 AS n FROM conversations), e AS (SELECT conv_id, max(st + n) AS total FROM t GROUP BY 1)
SELECT conv_id, span, CASE span WHEN 0 THEN (SELECT count(*) FROM t WHERE t.conv_id = e.conv_id) ELSE (SELECT count(*) FROM t WHERE t.conv_id = e.conv_id AND st + n <= total - 1) END AS n_rows, span = 0 AS exact FROM e, (VALUES (0), (1)) s(span)""")
def span_tiling(spark, sf_dir):
    """Turns as rows of a transcript; one span is the whole conversation, the other lacks its last character."""
    turns = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0)) + 1
    end = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select("conv_id", (end - n).alias("row_start"), end.alias("row_end"))
    whole = turns.groupBy("conv_id").agg(F.sum(n).alias("total"))
    spans = whole.select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("span"), "total").select("conv_id", "span", F.lit(0).alias("start"), (F.col("total") - F.col("span")).alias("end"))
    return K.tiling(spans, rows, ["conv_id"])


@query("""WITH l AS (SELECT doc_id, line, coalesce(sum(length(c) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, length(c) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)),
m AS (SELECT doc_id, line, least(60, st + n) - greatest(20, st) AS common FROM l)
SELECT d.doc_id, 0 AS span, (SELECT line FROM m WHERE m.doc_id = d.doc_id AND common > 0 ORDER BY common DESC, line LIMIT 1)::INT AS line FROM documents d""")
def span_lines(spark, sf_dir):
    """The line that most of the characters 20 to 60 of a document are on."""
    from docsieve.operators import sequences

    docs = table(spark, sf_dir, "documents")
    lines = sequences.lines(docs, "doc_id").select("doc_id", "line", F.col("start").alias("line_start"), F.col("end").alias("line_end"))
    spans = docs.select("doc_id", F.lit(0).alias("span"), F.lit(20).alias("start"), F.lit(60).alias("end"))
    return K.nearest_line(spans, lines, ["doc_id"])


@query("""WITH t AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_returnflag AS text, l_quantity AS x, l_linenumber * 10.0::DOUBLE AS y FROM lineitem)
SELECT page, CASE WHEN y <= 20 THEN 0 WHEN y <= 45 THEN 1 ELSE 2 END AS row, CASE WHEN x <= 20 THEN 0 ELSE 1 END AS col, string_agg(text, ' ' ORDER BY x, y, id) AS text FROM t GROUP BY ALL""")
def grid_cells(spark, sf_dir):
    """Tokens of an order's page at the nearest of three rows (10, 30, 60) and two columns (10, 30)."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), nth.alias("id"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * F.lit(10.0)).alias("y"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    rows = pages.select("page", F.posexplode(F.array(F.lit(10.0), F.lit(30.0), F.lit(60.0))).alias("row", "at"))
    columns = pages.select("page", F.posexplode(F.array(F.lit(10.0), F.lit(30.0))).alias("col", "at"))
    return K.nearest_centres(tokens, rows, columns, ["page"])


@query("""SELECT p_partkey, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 1, 2]) AS col, unnest([2, 1, 1, 1]) AS row_span, unnest([1, 2, 1, 1]) AS col_span, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS text FROM part""")
def html_grids(spark, sf_dir):
    page = F.format_string("<p>x</p><table><tr><th rowspan=\"2\"><b>%s</b></th><td colspan='2'>%s</td></tr>\n<TR><td>%s</td><td > %s </td></TR></table><table><tr><td>z</td></tr></table>", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return K.html_grid(table(spark, sf_dir, "part").select("p_partkey", page.alias("html")), "p_partkey", "html")


@query("""SELECT p_partkey, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS col, unnest(['name', 'note', p_name, p_type || ', "' || p_size || '"' || chr(10) || 'x']) AS text FROM part WHERE p_partkey % 3 = 0""")
def delimited_tables(spark, sf_dir):
    """Parts as quoted CSV; those of two residues are ragged or ill quoted and give nothing."""
    good = F.format_string('﻿name,note\r\n%s,"%s, ""%s""\nx"\r\n', "p_name", "p_type", F.col("p_size").cast("string"))
    raw = F.when(F.col("p_partkey") % 3 == 0, good).when(F.col("p_partkey") % 3 == 1, F.lit("a,b\nc")).otherwise(F.lit('a,"b\nc'))
    return K.delimited_cells(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw")


@query(r"""WITH f AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<h[1-6]'))) AS label, 'heading' AS kind FROM pages UNION ALL SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/[a-z]+"'))), 'link' FROM pages)
SELECT page_id, kind, label FROM f UNION ALL SELECT page_id, 'page-review', '' FROM pages WHERE page_id NOT IN (SELECT page_id FROM f)""")
def page_tasks(spark, sf_dir):
    return K.page_tasks(table(spark, sf_dir, "pages"), "page_id", "html", {"heading": "<h[1-6]", "link": 'href="/[a-z]+"'})


# outlines

_RESOLVE = """WITH RECURSIVE ev AS (SELECT user_id AS book, event_id AS node, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS page, event_type FROM events), nodes AS (SELECT book, node, 'T' || node % 6 || ' ' || event_type AS title, page AS start_page FROM ev),
lines AS (SELECT book, page, 0 AS line, 'T' || node % 6 || ' ' || event_type AS x FROM ev UNION ALL SELECT book, page, 1, 'see T' || (node + 1) % 6 || ' click' FROM ev UNION ALL SELECT book, page, 2, 'T' || (node + 2) % 6 || ' view 7' FROM ev UNION ALL SELECT book, page, 3, 'T' || (node + 3) % 6 || ' error' FROM ev),
h AS (SELECT l.book, l.page, count(*) AS hits FROM lines l JOIN nodes n ON n.book = l.book AND (l.x = n.title OR starts_with(l.x, n.title || ' ')) GROUP BY ALL),
c AS (SELECT n.book, n.node, l.page, CASE WHEN starts_with(l.x, n.title || ' ') AND regexp_matches(substr(l.x, length(n.title) + 1), '\\s+\\d{1,4}$') THEN CASE WHEN line <= 2 THEN 18 ELSE 8 END WHEN l.x = n.title THEN CASE WHEN l.page = start_page AND coalesce(hits, 0) >= 3 AND line <= 8 THEN 12 WHEN l.page = start_page AND line <= 1 THEN 82 ELSE 100 END ELSE 20 END
  - 4 * abs(l.page - start_page) + CASE WHEN l.page > start_page THEN 10 ELSE 0 END AS score FROM nodes n JOIN lines l ON l.book = n.book AND l.page BETWEEN greatest(start_page - 1, 1) AND start_page + 3 AND contains(l.x, n.title) LEFT JOIN h ON h.book = l.book AND h.page = l.page),
b AS (SELECT book, node, max(score) AS top, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT c.book, c.node, count(*) AS n, min(page) AS page FROM c JOIN b ON b.book = c.book AND b.node = c.node AND score = top GROUP BY ALL)
SELECT nodes.book, nodes.node, CASE WHEN n = 1 THEN t.page ELSE start_page END AS selected_page, CASE WHEN n IS NULL THEN 'outline-fallback' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(k, 0) AS n_candidates
FROM nodes LEFT JOIN t ON t.book = nodes.book AND t.node = nodes.node LEFT JOIN b ON b.book = nodes.book AND b.node = nodes.node"""


@query(_RESOLVE)
def outline_resolutions(spark, sf_dir):
    """A user's events are pages of a book and headings of its outline; lines repeat, mention and list the titles of others."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("node"), nth.alias("page"), "event_type")
    at = lambda i: F.concat(F.lit("T"), (F.col("node") + i) % 6)
    title = F.concat(at(0), F.lit(" "), "event_type")
    pages = rows.select("book", "page", F.concat(title, F.lit("\n  see "), at(1), F.lit(" click\n"), at(2), F.lit(" view  7\r\n\n"), at(3), F.lit(" error")).alias("text"))
    return K.outline_resolutions(rows.select("book", "node", title.alias("title"), F.col("page").alias("start_page")), pages, book="book")


# sealed tables and catalogs


@query("SELECT 'nation' AS entity, count(*) AS n_rows, 'verified' AS state FROM nation UNION ALL SELECT 'supplier', count(*), 'verified' FROM supplier UNION ALL SELECT 'part', count(*), 'changed' FROM part WHERE p_size <> 3")
def sealed_tables(spark, sf_dir):
    """Three tables written with a lock on their contents; one is written again without some rows, which the lock shows."""
    base = graph.shared_folder(spark)
    path = f"{base}/sealed-{uuid.uuid4().hex}"
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "supplier", "part")}
    K.sealed(tables, path)
    tables["part"].filter("p_size <> 3").write.mode("overwrite").parquet(f"{path}/part")
    return K.verified(spark, path, list(tables))


@query("SELECT table_name AS entity, column_name AS field, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE 'double' END AS type, true AS nullable FROM (SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest(['INTEGER', 'VARCHAR', 'INTEGER']) AS data_type UNION ALL SELECT 'supplier', unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']), unnest(['BIGINT', 'VARCHAR', 'INTEGER', 'DOUBLE']))")
def schema_fields(spark, sf_dir):
    return K.schema_rows(spark, {t: table(spark, sf_dir, t) for t in ("nation", "supplier")})


@query("""WITH e AS (SELECT 'part' AS package, p_partkey AS id, 'parts' AS module FROM part UNION ALL SELECT 'supplier', s_suppkey, 'firms' FROM supplier UNION ALL SELECT 'customer', c_custkey, 'firms' FROM customer)
SELECT id, count(DISTINCT package) AS n_packages, string_agg(package, ',' ORDER BY package) AS packages FROM e GROUP BY 1 HAVING count(DISTINCT package) > 1""")
def id_collisions(spark, sf_dir):
    """A composite catalog of three packages: ids that more than one of them has."""
    side = lambda t, c, key: table(spark, sf_dir, t).select(F.lit(t).alias("package"), F.col(f"{c}_{key}").alias("id"))
    entries = side("part", "p", "partkey").unionByName(side("supplier", "s", "suppkey")).unionByName(side("customer", "c", "custkey"))
    found = entries.groupBy("id").agg(F.count_distinct("package").alias("n_packages"), F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))
    return found.filter("n_packages > 1")


@query("""SELECT c_nationkey AS source, count(DISTINCT kind) AS n_kinds, count(DISTINCT package) AS n_packages, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT c_nationkey, 'customer' AS kind, c_custkey % 4 AS package FROM customer UNION ALL SELECT s_nationkey, 'supplier', 4 FROM supplier) GROUP BY 1""")
def composed_sources(spark, sf_dir):
    """Nations as sources that packages of customers and suppliers require, grouped by source."""
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.lit("customer").alias("kind"), (F.col("c_custkey") % 4).alias("package"))
    both = one.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.lit("supplier").alias("kind"), F.lit(4).cast("long").alias("package")))
    return both.groupBy("source").agg(F.count_distinct("kind").alias("n_kinds"), F.count_distinct("package").alias("n_packages"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT o_orderkey, o_orderstatus, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey), '') AS evidence, count(l_partkey) AS n FROM orders LEFT JOIN e ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0 GROUP BY ALL""")
def object_reads(spark, sf_dir):
    """Every 50th order looked up among all, with its distinct parts as evidence."""
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    found = asked.join(lines, "o_orderkey", "left").groupBy("o_orderkey", "o_orderstatus").agg(F.array_sort(F.collect_list("l_partkey")).alias("e"), F.count("l_partkey").alias("n"))
    return found.select("o_orderkey", "o_orderstatus", F.array_join("e", ",").alias("evidence"), "n")


@query("""SELECT o_orderstatus AS package, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS dangling, count(*) FILTER (o_totalprice > 400000) AS out_of_range, CASE WHEN count(*) FILTER (c_custkey IS NULL) > 0 THEN 'invalid' ELSE 'valid' END AS state FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey GROUP BY 1""")
def package_integrity(spark, sf_dir):
    """Orders by status as packages: references without an end and values out of range, in one pass."""
    known = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "orders").join(known, "o_custkey", "left")
    out = rows.groupBy(F.col("o_orderstatus").alias("package")).agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("dangling"), F.count_if(F.col("o_totalprice") > 400_000).alias("out_of_range"))
    return out.withColumn("state", F.when(F.col("dangling") > 0, "invalid").otherwise("valid"))
