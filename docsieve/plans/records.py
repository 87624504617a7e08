"""Queries on records, assertions, workpacks and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import geometry as G
from docsieve.functions import text as T
from docsieve.functions import units as U
from docsieve.operators import change_plan as C
from docsieve.operators import records as R
from docsieve.plans.registry import query, table

# forms of texts


@query(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')), '\s', '_', 'g') AS canonical, length(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\-–—]', '', 'g'))::INT AS n_letters FROM documents""")
def canonical_texts(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.canonical_text(text).alias("c"), T.compact(T.heading_form(text)).alias("h"))
    return rows.select("doc_id", F.regexp_replace("c", r"\s", "_").alias("canonical"), F.length("h").alias("n_letters"))


@query("""SELECT p_partkey, replace(replace(x, ' ', ''), '-', '') AS compact, array_to_string(list_filter(range(0, length(x)), lambda i: substr(x, i + 1, 1) NOT IN (' ', '-')), ',') AS pos FROM (SELECT p_partkey, p_name || ' - ' || p_type AS x FROM part)""")
def compact_maps(spark, sf_dir):
    """Texts without spaces and hyphens, and where their letters stood."""
    made = R.compact_map(F.concat("p_name", F.lit(" - "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("m")).select("p_partkey", "m.compact", F.array_join("m.pos", ",").alias("pos"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) || '-' || lower(replace(p_brand, '#', '')) || p_size || '%μ' AS form FROM part")
def allowed_forms(spark, sf_dir):
    said = F.concat(F.upper("p_name"), F.lit(" — "), "p_brand", F.lit("!\t("), "p_size", F.lit(")%µ"))
    return table(spark, sf_dir, "part").select("p_partkey", T.wide_fold(said).alias("x")).select("p_partkey", R.allowed_form(F.col("x")).alias("form"))


@query("SELECT p_partkey, CASE WHEN p_size::VARCHAR < '25.5' THEN p_size || ' kg,25.5' ELSE '25.5,' || p_size || ' kg' END AS tokens FROM part")
def numeric_tokens(spark, sf_dir):
    one = lambda v, u: F.struct(v.cast("string").alias("value"), F.lit(u).cast("string").alias("unit"))
    values = F.array(one(F.lit("25.5"), None), one(F.col("p_size"), "kg"), one(F.lit(None), "m"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.numeric_tokens(values), ",").alias("tokens"))


# objects


@query("""SELECT count(DISTINCT (l_orderkey, l_returnflag, l_quantity, l_linenumber)) AS n_ids, count(*) AS n FROM lineitem""")
def visual_ids(spark, sf_dir):
    """Ids of boxes: as many as there are different places and labels."""
    x, y = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    made = R.visual_id(F.col("l_orderkey"), F.lit("figure"), G.box(x, y, x + 1, y + 1), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(made.alias("id")).agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n"))


@query("SELECT l_suppkey, l_linenumber, round(72.0::DOUBLE / dpi, 9) AS scale, round(dpi / 72.0::DOUBLE, 9) AS inverse, ceil(600.0::DOUBLE * dpi / 72)::BIGINT AS pixel_width, ceil(800.5::DOUBLE * dpi / 72)::BIGINT AS pixel_height FROM (SELECT DISTINCT l_suppkey, l_linenumber, (72 + l_linenumber * 24)::DOUBLE AS dpi FROM lineitem)")
def transform_receipts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    made = R.transform_receipt((F.lit(72) + F.col("l_linenumber") * 24).cast("double"), F.lit(600.0), F.lit(800.5))
    return rows.select("l_suppkey", "l_linenumber", made.alias("t")).select("l_suppkey", "l_linenumber", "t.*")


@query("""SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'table' ELSE 'other' END AS kind, 'candidate' AS status, count(*) FILTER (l_quantity > 5) AS boxes, count(*) AS n FROM lineitem GROUP BY ALL""")
def candidate_rows(spark, sf_dir):
    """Vendor rows in the common form; boxes without an extent become null."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "TABULAR").otherwise("blob").alias("kind"), F.lit("verified").alias("status"), F.lit(5.0).alias("x0"), F.lit(0.0).alias("y0"), q.alias("x1"), F.lit(9.0).alias("y1"))
    made = R.candidate_rows(rows, {"tabular": "table"}, kind="kind")
    return made.groupBy("l_returnflag", "kind", "status").agg(F.count("x0").alias("boxes"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_custkey AS page, o_orderkey AS id, lower(o_orderpriority) AS t FROM orders), o AS (SELECT c_custkey AS page, 'the 5-low  and 1-urgent ones' AS t FROM customer WHERE c_acctbal > 0)
SELECT n.page, id, count(*) AS n FROM n JOIN o ON o.page = n.page WHERE contains(replace(o.t, '  ', ' '), n.t) GROUP BY ALL""")
def contained_texts(spark, sf_dir):
    """Priorities of orders that lie in the text which OCR has of their customer's page."""
    native = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    seen = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("page"), F.col("c_custkey").alias("id"), F.lit("The 5-LOW  and 1-Urgent ones").alias("text"))
    return R.contained(native, seen, ["page"], "text")


@query("""SELECT o_custkey AS page, 'page' AS entry, o_custkey::VARCHAR AS ref FROM orders UNION ALL SELECT o_custkey, 'route', o_orderstatus FROM orders UNION ALL SELECT c_custkey, 'object', c_name FROM customer UNION ALL SELECT c_custkey, 'kind', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'chart', 'k' || c_custkey FROM customer WHERE c_acctbal < 0""")
def visual_index(spark, sf_dir):
    routes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("route"))
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_name").alias("id"), F.col("c_mktsegment").alias("kind"), "c_acctbal")
    return R.visual_index(routes, objects, objects.filter("c_acctbal < 0").select("page", F.concat(F.lit("k"), "page").alias("id")))


# assertions and coverage

_ASSERTED = """a AS (SELECT p_partkey, 'statement' AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'proposal' ELSE 'object' END AS origin FROM part UNION ALL SELECT p_partkey, 'numeric', p_size::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'proposal' ELSE 'object' END FROM part
UNION ALL SELECT p_partkey, 'numeric', '7', 'proposal' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'unit', 'kg', 'object' FROM part WHERE p_partkey % 2 = 1)"""


def _assertions(spark, sf_dir):
    """Parts with even numbers have a proposal, the others speak for themselves."""
    none = F.lit(None).cast("array<string>")
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    objects = parts.select("p_partkey", F.array("p_name").alias("statement"), F.array(size).alias("numeric"), F.array(F.lit("kg")).alias("unit"), none.alias("assumption"))
    proposals = parts.filter("p_partkey % 2 = 0").select("p_partkey", F.array("p_type").alias("statement"), F.array(size, F.lit("7")).alias("numeric"), none.alias("unit"), none.alias("assumption"))
    return R.assertions(objects, proposals, key="p_partkey")


@query(f"WITH {_ASSERTED} SELECT p_partkey, kind, value, origin FROM a")
def atomic_assertions(spark, sf_dir):
    return _assertions(spark, sf_dir)


@query(f"""WITH {_ASSERTED}, d AS (SELECT DISTINCT p_partkey, kind, value FROM a) SELECT p_partkey, count(*) AS n, count(*) FILTER (kind = 'numeric' OR p_partkey % 3 = 0) AS supported, CASE WHEN count(*) FILTER (kind = 'numeric' OR p_partkey % 3 = 0) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM d GROUP BY 1""")
def assertion_coverage(spark, sf_dir):
    made = _assertions(spark, sf_dir)
    return R.assertion_coverage(made, made.filter("kind = 'numeric' OR p_partkey % 3 = 0"), key="p_partkey")


@query("SELECT p_brand, count(*) FILTER (p_size > 20) AS present, count(*) AS expected, round(count(*) FILTER (p_size > 20) / count(*), 6) AS share FROM part GROUP BY 1")
def draft_coverage(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    extra = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("p_partkey"))
    return R.draft_coverage(parts, parts.filter("p_size > 20").select("p_partkey").unionByName(extra), "p_brand", "p_partkey")


@query("""WITH g AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS i FROM lineitem WHERE l_linestatus = 'O'), p AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS i FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'N'), n AS (SELECT DISTINCT s, i FROM g WHERE s <> 'N' UNION SELECT s, i FROM p WHERE s = 'N'),
b AS (SELECT coalesce(n.s, p.s) AS s, n.i AS g, p.i AS p FROM n FULL JOIN p ON p.s = n.s AND p.i = n.i) SELECT s AS l_returnflag, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS n, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (g IS NULL) AS surplus, count(*) FILTER (p IS NULL OR g IS NULL) = 0 AS comparable FROM b GROUP BY 1""")
def split_checks(spark, sf_dir):
    """Parts by flag, gold from open lines and predictions from closed ones; those of flag N are the same on both sides."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_linestatus")
    return R.split_check(rows.filter("l_linestatus = 'O' OR l_returnflag = 'N'"), rows.filter("l_linestatus = 'F' OR l_returnflag = 'N'"), "l_returnflag", "l_partkey")


# graphs from records


@query("""SELECT 'o' || o_orderkey AS src, o_custkey::VARCHAR AS dst, 'customer' AS relation FROM orders UNION SELECT 'o' || l_orderkey, l_partkey::VARCHAR, 'part' FROM lineitem UNION SELECT 'o' || o_orderkey, o_orderstatus, 'status' FROM orders WHERE o_orderstatus <> 'P'""")
def auto_edges(spark, sf_dir):
    """Edges from the reference columns of orders: their customer, their parts, and the status of those that have one."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    rows = table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left").select(F.concat(F.lit("o"), "o_orderkey").alias("key"), "o_custkey", "parts", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return R.auto_edges(rows, "key", {"o_custkey": "customer", "parts": "part", "status": "status"})


@query("""WITH o AS (SELECT o_orderkey AS node, o_orderkey % 3 = 0 AS i, o_orderkey % 5 = 0 AS e FROM orders) SELECT node, CASE WHEN i OR e THEN 'changed' ELSE 'unchanged' END AS change, i AS identity_drift, e AS evidence_drift, CASE WHEN i OR e THEN 'rebuild,re-review' ELSE '' END AS actions FROM o""")
def snapshot_actions(spark, sf_dir):
    """Two snapshots of orders as statements: a third got another customer, a fifth another price."""
    orders = table(spark, sf_dir, "orders")
    newer = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(F.col("o_totalprice")))

    def shot(df):
        rows = R.snapshot(df, "o_orderkey", "semantic_assertion", ["o_custkey", "o_orderstatus"], ["o_totalprice"])
        none = F.array().cast("array<string>")
        return rows.select("node", "kind", F.col("content_sha256").alias("content"), F.col("identity_sha256").alias("identity"), F.col("evidence_sha256").alias("evidence"), F.lit("p").alias("protocol"), F.lit("").alias("inputs"), F.lit(2).alias("reviewers"), F.create_map(F.lit("read"), F.lit(True)).alias("capabilities"), F.lit("").alias("tag"), none.alias("required_receipts"), none.alias("receipts"))

    states = C.node_states(shot(orders), shot(newer))
    differs = lambda f: F.col(f"o.{f}") != F.col(f"n.{f}")
    asked = F.when(F.col("change") == "unchanged", "").otherwise(F.array_join(C.required_actions(F.col("n.kind")), ","))
    return states.select("node", "change", differs("identity").alias("identity_drift"), differs("evidence").alias("evidence_drift"), asked.alias("actions"))


@query("""WITH r AS (SELECT l_suppkey * 1000000 + l_partkey AS source, l_linenumber * 10 AS f, (l_linenumber * 10 + l_quantity % 12)::INT AS l FROM lineitem), m AS (SELECT *, max(l) OVER (PARTITION BY source ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT source, min(f) AS first, max(l) AS last, count(*) AS n, CASE WHEN bool_or(coalesce(f > b + 1, false)) THEN 'rejected' ELSE 'merged' END AS state FROM m GROUP BY 1""")
def source_merges(spark, sf_dir):
    f = F.col("l_linenumber") * 10
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("source"), f.alias("f"), (f + F.col("l_quantity") % 12).cast("int").alias("l"))
    return R.source_merges(rows, "source", "f", "l")


# requests and workpacks


@query("""SELECT c_custkey, 'scope_repeated:' || c_mktsegment AS issue FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'scope_unknown:MACHINERY' FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, 'fact_disputed:t' FROM customer WHERE c_custkey % 3 > 0""")
def request_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    fact = lambda v: F.struct(F.lit("t").alias("name"), v.cast("string").alias("value"))
    asked = rows.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", "c_mktsegment")).otherwise(F.array("c_mktsegment")).alias("scope"), F.array(fact(F.lit(0)), fact(F.col("c_custkey") % 3)).alias("facts"))
    return R.request_issues(asked, rows.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("scope")), key="c_custkey")


@query("""WITH p AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM conversations),
e AS (SELECT conv_id, max(turn) AS lp, max_by(n, turn) AS ln, max_by(base + n, turn) AS total FROM p GROUP BY 1), h AS (SELECT *, lead(turn) OVER w AS np, lead(base) OVER w AS nb FROM p WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT h.conv_id, turn AS unit, turn AS first_page, 3 AS first_at, coalesce(np, lp) AS last_page, CASE WHEN np IS NULL THEN ln ELSE 0 END AS last_at, coalesce(nb, total) - base - 3 AS n_chars FROM h JOIN e ON e.conv_id = h.conv_id)
SELECT *, CASE WHEN n_chars > 700 THEN 'oversize' WHEN n_chars <= 0 THEN 'empty' ELSE 'ready' END AS state FROM u""")
def workpack_units(spark, sf_dir):
    """The user's turns open units; the first three characters are the heading."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "role", "text")
    headings = turns.filter("role = 'user'").select("conv_id", F.col("page").alias("unit"), "page", F.lit(0).alias("at"), F.lit(3).alias("length"))
    return R.workpack_units(turns, headings, "conv_id", most=700)


@query("""WITH r AS (SELECT l_orderkey, bool_and(l_linestatus = 'O') AS good FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'obj-' || left(sha256('{"item":' || o_orderkey || '}'), 24) AS id FROM orders JOIN r ON l_orderkey = o_orderkey WHERE good AND o_orderstatus <> 'P'""")
def promoted_items(spark, sf_dir):
    """Orders whose lines are all open; pending ones leak."""
    orders = table(spark, sf_dir, "orders")
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "O", "accepted").otherwise("rejected").alias("verdict"))
    return R.promoted(orders, said, orders.filter("o_orderstatus = 'P'"), key="o_orderkey", prefix="obj")


# calculations


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN NULL ELSE round((l_extendedprice * 1000 + 2 * l_quantity) / nullif(l_linenumber - 1, 0), 6) END AS value, CASE WHEN l_quantity > 45 THEN 'gate_closed' WHEN l_linenumber = 1 THEN 'no_value' ELSE 'computed' END AS state FROM lineitem""")
def calculations(spark, sf_dir):
    """A formula over quantities brought to base units, run only where its gate is open; ``calculation_receipts`` replays stored ones."""
    scale = float(U.parse_unit("km")[0])
    given = {"d": F.col("l_extendedprice") * scale, "n": F.col("l_quantity"), "k": F.col("l_linenumber").cast("double")}
    tree = ["divide", ["add", ["symbol", "d"], ["multiply", ["number", "2"], ["symbol", "n"]]], ["subtract", ["symbol", "k"], ["number", "1"]]]
    gate = F.col("l_quantity") <= 45
    value = F.when(gate, F.round(U.compile_formula(tree, given), 6))
    state = F.when(~gate, "gate_closed").when(value.isNull(), "no_value").otherwise("computed")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"), state.alias("state"))
