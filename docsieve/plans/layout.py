"""Queries on boxes, lines, tables and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import geometry as G
from docsieve.operators import layout as L
from docsieve.plans.registry import query, table

# fragments: a line item is a piece of text on the page of its order

_FRAGMENTS = """SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS id, CASE l_returnflag WHEN 'R' THEN 'Fig' WHEN 'A' THEN l_linenumber::VARCHAR ELSE '图' END AS text,
  8.0::DOUBLE AS font, (l_linenumber * 20)::DOUBLE AS x0, floor(l_quantity / 10) * 12 AS y0, (l_linenumber * 20)::DOUBLE + 8 AS x1, floor(l_quantity / 10) * 12 + 8 AS y1 FROM lineitem"""
_LINES = f"""f AS ({_FRAGMENTS}), g AS (SELECT *, lag(x1) OVER w AS lx1, lag(y0) OVER w AS ly0 FROM f WINDOW w AS (PARTITION BY page ORDER BY y0, x0, id)),
m AS (SELECT *, sum(CASE WHEN lx1 IS NULL OR abs(y0 - ly0) > 5.2 OR x0 - lx1 > 16 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING) - 1 AS line FROM g),
j AS (SELECT page, line::INT AS line, id, y0, x0, text, lag(text) OVER (PARTITION BY page, line ORDER BY y0, x0, id) AS last FROM m),
lines AS (SELECT m.page, m.line::INT AS line, min(m.x0) AS x0, min(m.y0) AS y0, max(m.x1) AS x1, max(m.y1) AS y1, count(*) AS n,
  string_agg(CASE WHEN j.last IS NULL OR j.text = '图' OR j.last = '图' THEN j.text ELSE ' ' || j.text END, '' ORDER BY m.y0, m.x0, m.id) AS text FROM m JOIN j USING (page, id) GROUP BY ALL)"""


def _lines(spark, sf_dir):
    from pyspark.sql.window import Window

    said = F.when(F.col("l_returnflag") == "R", "Fig").when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("string")).otherwise("图")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    x, y = (F.col("l_linenumber") * 20).cast("double"), F.floor(F.col("l_quantity") / 10) * F.lit(12.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), nth.alias("id"), said.alias("text"), F.lit(8.0).alias("font"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 8).alias("y1"))
    return L.lines_of(rows, ["page"])


@query(f"WITH {_LINES} SELECT page, line, text, x0, y0, x1, y1, n FROM lines")
def recombined_lines(spark, sf_dir):
    return _lines(spark, sf_dir).drop("font")


@query(f"""WITH RECURSIVE {_LINES}, nx AS (SELECT page, line, text, row_number() OVER (PARTITION BY page ORDER BY line) AS rn, lead(text) OVER w AS t2, coalesce(regexp_full_match(text, '(?i)\\s*(fig|图)\\s*') AND regexp_full_match(lead(text) OVER w, '(?i)\\s*[-A-Z0-9.]+\\s*')
  AND lead(y0) OVER w - y1 <= 17.6 AND abs(lead(x0) OVER w - x0) <= 24, false) AS fits FROM lines WINDOW w AS (PARTITION BY page ORDER BY line)),
walk AS (SELECT page, rn, line, text, t2, fits AS takes, false AS gone FROM nx WHERE rn = 1 UNION ALL SELECT nx.page, nx.rn, nx.line, nx.text, nx.t2, nx.fits AND NOT walk.takes, walk.takes FROM walk JOIN nx ON nx.page = walk.page AND nx.rn = walk.rn + 1)
SELECT page, line, CASE WHEN takes THEN CASE WHEN text LIKE '%图' OR t2 LIKE '图%' THEN text || t2 ELSE text || ' ' || t2 END ELSE text END AS text FROM walk WHERE NOT gone""")
def caption_lines(spark, sf_dir):
    """Lines with captions' words and the numbers under them put together."""
    return L.merge_captions(_lines(spark, sf_dir), ["page"])


@query("""WITH t AS (SELECT o_custkey AS book, o_orderkey AS id, (o_orderkey % 40)::INT AS page, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN 'Table (Continued)' ELSE upper(o_orderpriority) END AS label FROM orders),
n AS (SELECT *, lead(page) OVER w AS np, lead(id) OVER w AS to_id, lower(coalesce(lead(coalesce(label, '')) OVER w, '')) AS b, lower(coalesce(label, '')) AS a FROM t WINDOW w AS (PARTITION BY book ORDER BY page, coalesce(label, ''), id))
SELECT book, id AS from_id, to_id, a <> '' AND a = b AS same_label, contains(b, 'continu') AS wording FROM n WHERE np = page + 1 AND ((a <> '' AND a = b) OR contains(b, 'continu'))""")
def table_continuations(spark, sf_dir):
    label = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderpriority") == "1-URGENT", "Table (Continued)").otherwise(F.upper("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).cast("int").alias("page"), label.alias("label"))
    return L.table_continuations(rows, ["book"])


_CELLS = "SELECT o_orderkey AS page, c AS cell, (c % 3) * 40.0::DOUBLE AS x0, (c // 3) * 15.0::DOUBLE AS y0, (c % 3) * 40.0::DOUBLE + 30 AS x1, (c // 3) * 15.0::DOUBLE + 15 AS y1 FROM orders, range(9) s(c)"


@query(f"""WITH c AS ({_CELLS}), t AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS id, l_returnflag AS text, l_linenumber * 15.0::DOUBLE AS x0, l_quantity AS y0, l_linenumber * 15.0::DOUBLE + 12 AS x1, l_quantity + 6 AS y1 FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey * 10 + l_linenumber) = 1),
s AS (SELECT t.page, t.id, t.text, t.y0, t.x0, cell, (x0 + 6 BETWEEN c.x0 AND c.x1) AND (t.y0 + 3 BETWEEN c.y0 AND c.y1) AS i, greatest(least(t.x1, c.x1) - greatest(t.x0, c.x0), 0) * greatest(least(t.y1, c.y1) - greatest(t.y0, c.y0), 0) AS o FROM t JOIN (SELECT page, cell, x0 AS cx0, x0, y0, x1, y1 FROM c) c ON c.page = t.page)
SELECT page, cell::INT AS cell, string_agg(text, ' ' ORDER BY y0, x0, text) AS text, count(*) AS n FROM (SELECT * FROM s WHERE i OR o > 0 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY NOT i, -o, cell) = 1) GROUP BY ALL""".replace("(x0 + 6 BETWEEN", "(t.x0 + 6 BETWEEN"))
def cell_texts(spark, sf_dir):
    """The texts of an order's lines in the cells of a table of three by three."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell"))
    x, y = (F.col("cell") % 3) * F.lit(40.0), F.floor(F.col("cell") / 3) * F.lit(15.0)
    cells = orders.select("page", "cell", x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 15).alias("y1"))
    x, y = F.col("l_linenumber") * F.lit(15.0), F.col("l_quantity")
    key = F.col("l_partkey") * 10 + F.col("l_linenumber")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), key.alias("id"), F.col("l_returnflag").alias("text"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 6).alias("y1"))
    alone = boxes.groupBy("page", "id").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return L.cell_texts(boxes.join(alone, ["page", "id"], "left_semi"), cells, ["page"])


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS line, l_returnflag AS text, (l_linenumber * 5)::DOUBLE AS x0, l_quantity * 4 AS y0, (l_linenumber * 5)::DOUBLE + 60 AS x1, l_quantity * 4 + 6 AS y1 FROM lineitem WHERE l_quantity * 4 + 6 > 6 AND l_quantity * 4 <= 290),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1, line) AS rn FROM l), f AS (SELECT *, y1 AS bottom FROM r WHERE rn = 1 UNION ALL SELECT r.*, greatest(f.bottom, r.y1) FROM f JOIN r ON r.page = f.page AND r.rn = f.rn + 1 WHERE r.y0 - greatest(f.bottom, 10) <= 28)
SELECT page, 0 AS caption, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f GROUP BY page HAVING count(*) >= 2""")
def text_tables(spark, sf_dir):
    """Under a caption at the head of each order's page, its lines up to the first wide gap."""
    x, y = (F.col("l_linenumber") * 5).cast("double"), F.col("l_quantity") * 4
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("line"), F.col("l_returnflag").alias("text"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 6).alias("y1"))
    captions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(0).alias("caption"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(10.0).alias("y1"))
    return L.clusters_below(captions, lines, ["page"], height=800.0)


# outlines: a user's events are the nodes of a book's outline

_NODES = "SELECT user_id AS book, event_id AS node, event_type AS title, (event_id % 4)::INT AS depth, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 3)::INT AS start_page FROM events"


def _nodes(spark, sf_dir):
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("node"), F.col("event_type").alias("title"), (F.col("event_id") % 4).cast("int").alias("depth"), (nth * 3).cast("int").alias("start_page"))


@query(f"""WITH n AS ({_NODES}), p AS (SELECT n.*, (SELECT max(b.node) FROM n b WHERE b.book = n.book AND b.node < n.node AND b.depth < n.depth) AS parent, (SELECT min(b.start_page) FROM n b WHERE b.book = n.book AND b.node > n.node AND b.depth <= n.depth) AS nxt FROM n),
e AS (SELECT *, greatest(start_page, coalesce(least(nxt, 60), 60)) AS end_page, least(greatest(start_page, 10), 60) AS scope_start FROM p), c AS (SELECT book, parent AS node, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY ALL)
SELECT e.book, e.node, title, depth, parent, coalesce(n_children, 0) AS n_children, start_page, end_page, scope_start, greatest(scope_start, least(end_page, 60)) AS scope_end FROM e LEFT JOIN c ON c.book = e.book AND c.node = e.node""")
def outline_segments(spark, sf_dir):
    return L.segments(_nodes(spark, sf_dir), ["book"], first_page=F.lit(10), last_page=F.lit(60))


@query(f"""WITH n AS ({_NODES}), x AS (SELECT *, (start_page // 9)::INT AS p, 'view error click' AS t FROM n)
SELECT book, node, title, p AS start_page, row_number() OVER (PARTITION BY book ORDER BY p, nullif(instr(t, title), 0) NULLS LAST, node)::INT AS place FROM x""")
def physical_order(spark, sf_dir):
    rows = _nodes(spark, sf_dir).select("book", "node", "title", F.floor(F.col("start_page") / 9).cast("int").alias("start_page"), F.lit("view error click").alias("page_text"))
    return L.physical_order(rows, ["book"], "title", "page_text").drop("page_text")


_HEADINGS = """SELECT o_custkey AS book, o_orderkey AS page, k, CASE k WHEN 1 THEN (o_orderkey % 3 + 1) || '  Part' ELSE (o_orderkey % 3 + 1) || '.' || (o_orderkey % 2 + 1) || ' Chapter ' || chr((97 + o_orderkey % 5)::INT) || ' 12' END AS raw FROM orders, (VALUES (1), (2)) v(k)"""


@query(f"""WITH h AS ({_HEADINGS}), t AS (SELECT book, page, k, CASE k WHEN 1 THEN split_part(raw, ' ', 1) || ' Part' ELSE regexp_replace(raw, ' 12$', '') END AS title, k - 1 AS depth FROM h),
o AS (SELECT *, (row_number() OVER (PARTITION BY book ORDER BY page, k) - 1)::INT AS node FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY book, lower(title) ORDER BY page, k) = 1))
SELECT book, node, title, depth::INT AS depth, page, CASE WHEN depth = 1 THEN (SELECT max(p.node) FROM o p WHERE p.book = o.book AND p.node < o.node AND p.depth = 0) END::INT AS parent FROM o""")
def heading_fallback(spark, sf_dir):
    """Orders as pages of their customer's book, each with two headings, of which only the first of a title counts."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Intro\n"), (k % 3 + 1).cast("string"), F.lit("  Part\n7up\n"), (k % 3 + 1).cast("string"), F.lit("."), (k % 2 + 1).cast("string"), F.lit(" Chapter "), F.char((97 + k % 5).cast("int")), F.lit(" 12\r\nbody"))
    return L.heading_fallback(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), k.alias("page"), text.alias("text")), ["book"], "page", "text")


# boxes


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'bbox_scope_mismatch' WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 'bbox_object_mismatch' WHEN l_quantity < 3 THEN 'bbox_invalid' WHEN l_tax = 0 THEN 'bbox_render_mapping_unavailable'
WHEN 10000 / (20000 - 10000 + 100 * d * 1.0) < 0.0 OR (100 - d) * 100 / (20000 - (100 - d) * 100) < 0.95 THEN 'bbox_iou_below_threshold' WHEN d > 1 THEN 'bbox_edge_delta_above_threshold' ELSE 'geometric_equivalent' END AS reason FROM (SELECT *, l_discount * 50 AS d FROM lineitem)""")
def box_equivalence(spark, sf_dir):
    """A square of 100 against the same moved by a discount, under the rules in their order."""
    move = F.col("l_discount") * 50
    a = G.box(F.lit(0.0), F.lit(0.0), F.when(F.col("l_quantity") < 3, 0.0).otherwise(100.0), F.lit(100.0))
    b = G.box(move, F.lit(0.0), move + 100, F.lit(100.0))
    reason = L.equivalence(a, b, same_scope=F.col("l_returnflag") != "R", same_space=F.lit(True), same_object=~((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)), tolerance=F.when(F.col("l_tax") > 0, 1.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@query("""SELECT p_partkey, lower(p_type) = 'economy' AND (p_size % 3 = 0 OR p_size % 2 = 0) AS compatible FROM part""")
def object_compatibility(spark, sf_dir):
    own = F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t"))
    label = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 2 == 0, own).otherwise("other thing")
    return table(spark, sf_dir, "part").select("p_partkey", L.compatible(F.lower("p_type"), F.lit("economy"), label, F.col("p_name")).alias("compatible"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber % 4) * 90 AS rot, l_linenumber * 10.0::DOUBLE AS x0, l_quantity AS y0 FROM lineitem), s AS (SELECT *, x0 * 0.5 AS a0, y0 * 0.5 AS b0, (x0 + 30) * 0.5 AS a1, (y0 + 40) * 0.5 AS b1 FROM b),
t AS (SELECT *, CASE rot WHEN 90 THEN b0 WHEN 180 THEN 600 - a1 WHEN 270 THEN 600 - b1 ELSE a0 END AS px0, CASE rot WHEN 90 THEN 800 - a1 WHEN 180 THEN 800 - b1 WHEN 270 THEN a0 ELSE b0 END AS py0 FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(px0, 6) AS x0, round(py0, 6) AS y0, floor(round(px0, 6) * 2)::BIGINT AS crop_x0, floor(round(py0, 6) * 2)::BIGINT AS crop_y0 FROM t""")
def page_points(spark, sf_dir):
    """Pixel boxes of turned pages of 144 dots an inch in points, and the pixels that cover them."""
    x, y = F.col("l_linenumber") * F.lit(10.0), F.col("l_quantity")
    points = G.pixels_to_points(G.box(x, y, x + 30, y + 40), F.lit(144.0), (F.col("l_linenumber") % 4) * 90, F.lit(600.0), F.lit(800.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", points.alias("p"))
    crop = G.crop_pixels(F.col("p"), F.lit(144.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "p.x0", "p.y0", crop["x0"].alias("crop_x0"), crop["y0"].alias("crop_y0"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(2 * q + 1, 6) AS x0, round(3 * n - 4, 6) AS y0, round(2 * (q + 5) + 1, 6) AS x1, round(3 * (n + 7) - 4, 6) AS y1, round(q, 5) AS back FROM (SELECT *, l_quantity AS q, l_linenumber::DOUBLE AS n FROM lineitem)""")
def polygon_boxes(spark, sf_dir):
    """Triangles under a plane transform, their bounding boxes, and a corner taken back by the inverse."""
    matrix = [[2.0, 0.0, 1.0], [0.0, 3.0, -4.0], [0.0, 0.0, 1.0]]
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.project_polygon(matrix, F.array(point(x, y), point(x + 5, y + 2), point(x + 3, y + 7))).alias("t"))
    around = G.envelope(F.col("t"))
    back = G.project(G.inverse(matrix), F.col("t")[0]["x"], F.col("t")[0]["y"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(around[c].alias(c) for c in L.BOX), F.round(back["x"], 5).alias("back"))


# charts


@query("""SELECT p_partkey, 0 AS row, 0 AS "column", 'year' AS name, p_size::VARCHAR AS text FROM part UNION ALL SELECT p_partkey, 0, 1, 'price', p_name FROM part UNION ALL SELECT p_partkey, 1, 0, 'year', p_brand FROM part""")
def chart_tables(spark, sf_dir):
    return L.chart_cells(_charts(spark, sf_dir), "p_partkey", "raw")


@query("SELECT p_partkey, 'axis' AS label, p_type AS value FROM part UNION ALL SELECT p_partkey, 'ticks', '1, 2' FROM part UNION ALL SELECT p_partkey, 'unit', 'kg' FROM part")
def chart_labels(spark, sf_dir):
    return L.chart_labels(_charts(spark, sf_dir), "p_partkey", "raw")


def _charts(spark, sf_dir):
    """Each part as the text of a chart."""
    raw = F.format_string("Axes: %s\nTick : 1, 2\n| year | price |\n|---|:---:|\n| %s | %s |\nunit: kg\nlegend:\n| %s ||\nplain words", "p_type", F.col("p_size").cast("string"), "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


# groups


_ROWS = "SELECT l_orderkey AS page, l_orderkey * 100000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS id, l_quantity * 10 AS x0, l_quantity * 10 + 30 AS x1 FROM lineitem"
_NEAR = f"""r AS ({_ROWS}), m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR x0 - b >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS UNBOUNDED PRECEDING) AS g FROM m),
groups AS (SELECT page, min(id) AS root, count(*) AS n, min(x0) AS x0, 0.0::DOUBLE AS y0, max(x1) AS x1, 20.0::DOUBLE AS y1 FROM n GROUP BY page, g)"""


def _near(spark, sf_dir):
    """An order's lines as panels in one row; those less than 8 apart belong together."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    x = F.col("l_quantity") * 10
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 100_000_000 + nth).alias("id"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 30).alias("x1"), F.lit(20.0).alias("y1"))
    return L.near_groups(rows, ["page"], gap=8.0)


@query(f"WITH {_NEAR} SELECT * FROM groups")
def panel_groups(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"WITH {_NEAR} SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, (x1 - x0) * 20 DESC, root) = 1")
def ruling_tables(spark, sf_dir):
    """The best group of each page."""
    return L.best_group(_near(spark, sf_dir), ["page"])


@query("""SELECT page, title_id, CASE WHEN ok THEN 1 END AS line, CASE WHEN ok THEN 0.0::DOUBLE END AS x0, CASE WHEN ok THEN 20.0::DOUBLE END AS y0, CASE WHEN ok THEN 30.0::DOUBLE END AS x1, CASE WHEN ok THEN 28.0::DOUBLE END AS y1 FROM (SELECT p_partkey AS page, p_partkey AS title_id, p_partkey % 3 <> 0 AND p_type <> split_part(p_name, ' ', 1) AS ok FROM part)""")
def title_boxes(spark, sf_dir):
    """Each part is a page with its name on one line, or on two (every third), which leaves it without a place."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), "p_name", "p_type")
    lines = F.array(F.upper("p_type"), F.col("p_name"), F.when(F.col("page") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.lit("Foot")))
    cut = parts.select("page", F.posexplode(lines).alias("line", "x")).select("page", "line", F.posexplode(F.split(F.trim("x"), " ")).alias("nth", "word"))
    words = cut.select("page", "line", "nth", "word", (F.col("nth") * F.lit(15.0)).alias("x0"), (F.col("line") * F.lit(20.0)).alias("y0"), (F.col("nth") * F.lit(15.0) + 15).alias("x1"), (F.col("line") * F.lit(20.0) + 8).alias("y1"))
    titles = parts.select("page", F.col("page").alias("title_id"), F.upper("p_name").alias("title"))
    return L.title_boxes(titles, words, ["page"])
