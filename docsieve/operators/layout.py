"""Pages as laid out: lines from fragments, tables, outlines and their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import geometry as G
from docsieve.functions import text as T
from docsieve.operators import graph, matching
from docsieve.operators import sequences as S

BOX = ("x0", "y0", "x1", "y1")
#: A numbered heading, and the page number that may follow its title (fixed values).
HEADING, TRAILING_PAGE = r"^(\d+(?:\.\d+)*)\s+([A-Za-z][^\n]{2,})$", r"(?U)\s+\d{1,3}$"
#: The start of a table's caption: its word and a number token (fixed value).
TABLE_CAPTION = r"(?iU)^\s*(?:Table|Tab(?:le)?\.?|表)\s*(?:[A-Za-z]+|[IVXLCDM]+|\d+)(?:[.-](?:[A-Za-z]+|[IVXLCDM]+|\d+))*"


def same_line(a: Column, b: Column) -> Column:
    """Whether two fragments stand on one line: their middles differ by at most 0.65 of the smaller font (2 at least)."""
    font = F.least(F.greatest(a["font"], F.lit(1.0)), F.greatest(b["font"], F.lit(1.0)))
    return F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= F.greatest(F.lit(2.0), font * 0.65)


def adjacent(a: Column, b: Column) -> Column:
    """Whether ``b`` follows ``a`` with a gap of at most twice the larger font (2 at least)."""
    font = F.greatest(F.lit(1.0), a["font"], b["font"])
    return b["x0"] - a["x1"] <= F.greatest(F.lit(2.0), font * 2.0)


def lines_of(fragments: DataFrame, page: list[str]) -> DataFrame:
    """(page, line, text, x0, y0, x1, y1, font, n): fragments of a page in reading order, joined where one follows the other on a line.

    Fragments have id, text, font and a box. One window pass per page, then one
    aggregation; a page's fragments are one task's at a time.
    """
    w = Window.partitionBy(*page).orderBy(F.round("y0", 6), F.round("x0", 6), "id")
    own = F.struct(*BOX, "font")
    marked = fragments.withColumn("own", own).withColumn("last", F.lag("own").over(w))
    opens = F.when(F.col("last").isNull() | ~(same_line(F.col("last"), F.col("own")) & adjacent(F.col("last"), F.col("own"))), 1).otherwise(0)
    numbered = marked.withColumn("opens", opens).withColumn("line", (F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.round("y0", 6).alias("y"), F.round("x0", 6).alias("x"), "id", "text"))), lambda r: r["text"])
    joined = numbered.groupBy(*page, "line").agg(pieces.alias("pieces"), F.round(F.min("x0"), 6).alias("x0"), F.round(F.min("y0"), 6).alias("y0"), F.round(F.max("x1"), 6).alias("x1"), F.round(F.max("y1"), 6).alias("y1"), F.max("font").alias("font"), F.count("*").alias("n"))
    return joined.select(*page, "line", T.join_fragments(F.col("pieces")).alias("text"), *BOX, "font", "n")


def merge_captions(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, line, text): a line that is only a caption's word takes the number on the line under it, which goes.

    A line that went can't take the next one: runs of such pairs are told apart by their place in the run.
    """
    w = Window.partitionBy(*page).orderBy("line")
    here, below = F.struct("text", *BOX, "font"), F.lead(F.struct("text", *BOX, "font")).over(w)
    font = F.greatest(F.lit(1.0), F.col("here.font"))
    fits = (
        T.is_caption_prefix(F.col("here.text"))
        & F.col("below.text").rlike(r"(?i)^\s*[-A-Z0-9.]+\s*$")
        & (F.col("below.y0") - F.col("here.y1") <= F.greatest(F.lit(4.0), font * 2.2))
        & (F.abs(F.col("below.x0") - F.col("here.x0")) <= F.greatest(F.lit(3.0), font * 3.0))
    )
    marked = lines.select(*page, "line", here.alias("here"), below.alias("below")).withColumn("fits", F.coalesce(fits, F.lit(False)))
    run = F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = marked.withColumn("run", F.coalesce(run, F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*page, "run").orderBy("line"))
    takes = F.col("fits") & (nth % 2 == 1)
    taken = inside.withColumn("takes", takes).withColumn("gone", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    text = F.when(F.col("takes"), T.join_fragments(F.array("here.text", "below.text"))).otherwise(F.col("here.text"))
    return taken.filter(~F.col("gone")).select(*page, "line", text.alias("text"))


def table_continuations(tables: DataFrame, book: list[str]) -> DataFrame:
    """(book, from_id, to_id, same_label, wording): tables on consecutive pages with one label, or whose second says that it goes on."""
    w = Window.partitionBy(*book).orderBy("page", F.coalesce("label", F.lit("")), "id")
    fold = lambda c: T.fold(F.coalesce(F.col(c), F.lit("")))
    pairs = tables.select("*", F.lead("page").over(w).alias("next_page"), F.lead("id").over(w).alias("to_id"), F.coalesce(F.lead(F.coalesce("label", F.lit(""))).over(w), F.lit("")).alias("next_label"))
    pairs = pairs.select(*book, "page", "next_page", F.col("id").alias("from_id"), "to_id", fold("label").alias("a"), fold("next_label").alias("b"))
    same, wording = (F.col("a") != "") & (F.col("a") == F.col("b")), F.col("b").contains("continu") | F.col("b").contains("续")
    return pairs.filter((F.col("next_page") == F.col("page") + 1) & (same | wording)).select(*book, "from_id", "to_id", same.alias("same_label"), wording.alias("wording"))


def cell_texts(boxes: DataFrame, cells: DataFrame, page: list[str]) -> DataFrame:
    """(page, cell, text, n): each text box goes to the cell with its middle inside, else to the one that it overlaps most, else nowhere.

    Boxes have id, text and a box; cells have cell and a box. Ties go to the
    larger overlap, then to the first cell. Texts of a cell are joined downwards, then to the right.
    """
    a, b = G.box(*(f"t.{c}" for c in BOX)), G.box(*(f"c.{c}" for c in BOX))
    met = boxes.filter(F.trim("text") != "").alias("t").join(cells.alias("c"), page)
    x, y = (F.col("t.x0") + F.col("t.x1")) / 2, (F.col("t.y0") + F.col("t.y1")) / 2
    inside = x.between(F.col("c.x0"), F.col("c.x1")) & y.between(F.col("c.y0"), F.col("c.y1"))
    scored = met.select(*page, "t.id", "t.text", F.col("t.y0").alias("y"), F.col("t.x0").alias("x"), F.struct(F.when(inside, 0).otherwise(1).alias("out"), (-G.intersection(a, b)).alias("o"), F.col("c.cell").alias("cell")).alias("s"))
    best = scored.filter((F.col("s.out") == 0) | (F.col("s.o") < 0)).groupBy(*page, "id").agg(F.min(F.struct("s", F.trim("text").alias("text"), "y", "x")).alias("m"))
    row = F.struct("m.y", "m.x", "m.text")
    return best.groupBy(*page, F.col("m.s.cell").alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), " ").alias("text"), F.count("*").alias("n"))


def clusters_below(captions: DataFrame, lines: DataFrame, page: list[str], *, height: float) -> DataFrame:
    """(page, caption, n_lines, x0, y0, x1, y1): lines under a caption up to the first gap over 20 (or 0.035 of the height); two lines at least.

    Captions have caption and a box, lines line, text and a box. Lines that are table captions are passed over.
    """
    gap, reach = max(20.0, height * 0.035), height * 0.35
    below = captions.select(*page, "caption", F.col("y1").alias("top")).join(lines, page)
    below = below.filter((F.col("y1") > F.col("top") - max(2.0, height * 0.005)) & (F.col("y0") <= F.col("top") + reach) & (F.trim("text") != "") & ~F.col("text").rlike(TABLE_CAPTION))
    w = Window.partitionBy(*page, "caption").orderBy("y0", "x0", "x1", "y1", "line")
    bottom = F.greatest(F.col("top"), F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cut = below.withColumn("nth", F.row_number().over(w)).withColumn("far", F.when((F.col("nth") > 1) & (F.col("y0") - bottom > gap), 1).otherwise(0))
    held = cut.withColumn("ended", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("ended = 0")
    out = held.groupBy(*page, "caption").agg(F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.filter("n_lines >= 2")


def segments(nodes: DataFrame, book: list[str], *, first_page: Column, last_page: Column) -> DataFrame:
    """(book, node, title, depth, parent, n_children, start_page, end_page, scope_start, scope_end) of an outline in document order.

    Nodes have node (their order), title, depth (of any size) and start_page. A
    parent is the last node before with a smaller depth. A node ends on the page
    where the next of its depth or less starts; the scope clips both.
    """
    own = S.nearest_shallower(nodes.withColumn("node", F.col("node").cast("long")), book, ["node"], "depth", "node", "parent")
    own = S.nearest_shallower(own.withColumn("start_page", F.col("start_page").cast("int")), book, ["node"], "depth", "start_page", "next", ahead=True, equal=True)
    own = own.withColumn("end_page", F.greatest("start_page", F.coalesce(F.least("next", last_page), last_page)))
    own = own.withColumn("scope_start", F.least(F.greatest("start_page", first_page), last_page)).withColumn("scope_end", F.greatest("scope_start", F.least("end_page", last_page)))
    children = own.filter("parent IS NOT NULL").groupBy(*book, F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return own.join(children, [*book, "node"], "left").select(*book, "node", "title", "depth", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), "start_page", "end_page", "scope_start", "scope_end")


def physical_order(rows: DataFrame, book: list[str], title: str, page_text: str) -> DataFrame:
    """``rows`` plus ``place``: their order by first page and where the title stands in that page's text (nowhere: last)."""
    at = F.nullif(F.call_function("locate", F.col(title), F.col(page_text)), F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*book).orderBy("start_page", at.asc_nulls_last(), "node")))


def heading_fallback(pages: DataFrame, book: list[str], page: str, text: str) -> DataFrame:
    """(book, node, title, depth, page, parent): numbered headings in the first 24 lines of each page.

    A heading counts where it comes first in its book, whatever its case. Depth
    is the number of points in its number, without a bound. A parent is the last
    heading of the depth above, if no shallower one came after it.
    """
    lines = pages.select(*book, page, F.posexplode(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 24)).alias("line", "raw")).withColumn("raw", T.collapse_space(F.col("raw")))
    found = lines.select(*book, page, "line", F.regexp_extract("raw", HEADING, 1).alias("number"), F.regexp_extract("raw", HEADING, 2).alias("rest")).filter("number <> ''")
    found = found.withColumn("title", F.concat_ws(" ", "number", T.strip(F.regexp_replace("rest", TRAILING_PAGE, ""))))
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy(*book, F.lower("title")).orderBy(page, "line"))).filter("nth = 1")
    depth = (F.length("number") - F.length(F.regexp_replace("number", r"\.", ""))).cast("int")
    nodes = once.withColumn("depth", depth).withColumn("node", F.row_number().over(Window.partitionBy(*book).orderBy(page, "line")) - 1)
    above = S.nearest_shallower(nodes.withColumn("own", F.struct("node", "depth")), book, ["node"], "depth", "own", "above")
    parent = F.when(F.col("above.depth") == F.col("depth") - 1, F.col("above.node"))
    return above.select(*book, "node", "title", "depth", page, parent.alias("parent"))


def equivalence(a: Column, b: Column, *, same_scope: Column, same_space: Column, same_object: Column, tolerance: Column) -> Column:
    """Why two reviewers' boxes aren't the same, by the first rule that fails; geometric_equivalent if none does."""
    edges = F.greatest(*(F.abs(a[e] - b[e]) for e in BOX))
    ok = G.is_valid(a) & G.is_valid(b)
    return (
        F.when(~same_scope, "bbox_scope_mismatch").when(~same_space, "bbox_coordinate_space_mismatch").when(~same_object, "bbox_object_mismatch")
        .when(~F.coalesce(ok, F.lit(False)), "bbox_invalid").when(tolerance.isNull(), "bbox_render_mapping_unavailable")
        .when(G.iou(a, b) < 0.95, "bbox_iou_below_threshold").when(edges > tolerance, "bbox_edge_delta_above_threshold").otherwise("geometric_equivalent")
    )


def compatible(kind_a: Column, kind_b: Column, label_a: Column, label_b: Column) -> Column:
    """Objects of one kind whose labels agree in case and white space, or one of which has none."""
    norm = lambda c: T.collapse_space(T.fold(F.coalesce(c, F.lit(""))))
    return (kind_a == kind_b) & ((norm(label_a) == "") | (norm(label_b) == "") | (norm(label_a) == norm(label_b)))


def chart_cells(charts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, column, name, text): rows of a chart's text with pipes under the first one's names; rule lines and ``word: value`` lines are passed over."""
    named = r"(?i)^(?:axis|axes|ticks?|legend|series|unit|annotations?)\s*:"
    kept = F.filter(T.text_lines(F.col(text)), lambda x: x.contains("|") & ~x.rlike(named) & ~x.rlike(r"^\|?(?:\s*:?-{3,}:?\s*\|?)+$"))
    cells = F.transform(kept, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: T.strip(c)))
    rows = charts.select(key, cells.alias("t")).select(key, F.col("t")[0].alias("names"), F.posexplode(F.slice("t", 2, 1 << 20)).alias("row", "values"))
    return rows.select(key, "row", "names", F.posexplode("values").alias("column", "text")).select(key, "row", "column", F.get("names", F.col("column")).alias("name"), "text")


def chart_labels(charts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, value): a chart's lines of the form ``word: value``, synonyms under one label."""
    one = F.explode(T.text_lines(F.col(text)))
    pattern = r"(?i)^(axis|axes|ticks?|legend|series|unit|annotations?)\s*:\s*(.*)$"
    rows = charts.select(key, one.alias("x")).select(key, F.lower(F.regexp_extract("x", pattern, 1)).alias("label"), F.regexp_extract("x", pattern, 2).alias("value"))
    label = F.when(F.col("label").isin("axis", "axes"), "axis").when(F.col("label").startswith("tick"), "ticks").when(F.col("label").startswith("annotation"), "annotations").otherwise(F.col("label"))
    return rows.filter("label <> '' AND value <> ''").select(key, label.alias("label"), "value")


def near_groups(boxes: DataFrame, page: list[str], *, gap: float) -> DataFrame:
    """(page, root, n, x0, y0, x1, y1): groups of boxes of a page that lie within ``gap`` of each other, directly or through others, with their common box.

    ``root`` is the smallest id of the group; ids are unique over all pages.
    """
    half = gap / 2
    grown = boxes.select(*page, "id", (F.col("x0") - half).alias("x0"), (F.col("y0") - half).alias("y0"), (F.col("x1") + half).alias("x1"), (F.col("y1") + half).alias("y1"))
    pairs = matching.meeting(grown, grown, page).filter("a.id < b.id").select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    found = graph.components(graph.cut(pairs), boxes.select(F.col("id").alias("node")))
    return boxes.join(found.withColumnRenamed("node", "id"), "id").groupBy(*page, "root").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def best_group(groups: DataFrame, page: list[str]) -> DataFrame:
    """The group of each page with the most boxes, then the largest box, then the smallest root."""
    rank = Window.partitionBy(*page).orderBy(F.desc("n"), F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "root")
    return groups.withColumn("nth", F.row_number().over(rank)).filter("nth = 1").drop("nth")


def title_boxes(titles: DataFrame, words: DataFrame, page: list[str]) -> DataFrame:
    """(page, title_id, line, x0, y0, x1, y1): where a title's words stand as the words of one line; null where no line, or more than one, has just these.

    Titles are (page, title_id, title), words (page, line, nth, word, box).
    Lines are joined by their folded words, in order.
    """
    folded = lambda c: T.fold(F.col(c))
    row = F.transform(F.array_sort(F.collect_list(F.struct("nth", folded("word").alias("w")))), lambda r: r["w"])
    lines = words.groupBy(*page, "line").agg(F.array_join(row, " ").alias("x"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))
    once = lines.groupBy(*page, "x").agg(F.count("*").alias("n"), F.min(F.struct("line", *BOX)).alias("at")).filter("n = 1")
    wanted = titles.select(*page, "title_id", T.collapse_space(folded("title")).alias("x"))
    return wanted.join(once, [*page, "x"], "left").select(*page, "title_id", "at.*")
