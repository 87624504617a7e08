"""Queries on identities, evidence, versions and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import changes
from docsieve.operators import provenance as V
from docsieve.plans.registry import query, table

# identity


@query("""SELECT s_suppkey, id, sha256('{"id":"' || id || '","s_name":"' || s_name || '","review":' || CASE WHEN s_suppkey % 2 = 0 THEN '"open"' ELSE 'null' END || '}') AS content_sha256
FROM (SELECT *, 'scr-' || left(sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}'), 24) AS id FROM supplier)""")
def record_ids(spark, sf_dir):
    """Ids that follow from the name and nation alone; the content's hash covers the review state too."""
    rows = table(spark, sf_dir, "supplier").withColumn("review", F.when(F.col("s_suppkey") % 2 == 0, "open"))
    return V.bind(rows, "scr", ["s_name", "s_nationkey"], ["s_name", "review"]).select("s_suppkey", "id", "content_sha256")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'node_id:n' || p_partkey WHEN p_partkey % 3 = 1 THEN 'id:' || p_partkey ELSE 'anonymous:' || left(sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}'), 24) END AS key,
CASE p_type WHEN 'ECONOMY' THEN 'claim' WHEN 'STANDARD' THEN 'data-table' ELSE lower(p_type) END AS kind FROM part""")
def stable_keys(spark, sf_dir):
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", F.when(k == 0, F.concat(F.lit("n"), "p_partkey")).when(k == 1, "").alias("node_id"), F.when(k < 2, F.col("p_partkey")).alias("id"))
    said = F.when(F.col("p_type") == "STANDARD", " Data_Table ").otherwise(F.col("p_type"))
    return rows.select("p_partkey", V.stable_key(["node_id", "id"], ["p_name", "p_size"]).alias("key"), V.kind_of(said, {"economy": "claim"}, "object").alias("kind"))


@query("""WITH h AS (SELECT n_name, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS h FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT n_name, left(h, 2) AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT n_name, sum(n)::BIGINT AS n_rows, sha256(string_agg(part || d, '' ORDER BY part)) AS fingerprint FROM p GROUP BY 1""")
def row_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return V.set_fingerprint(rows, ["n_name"], ["c_custkey", "c_mktsegment"])


# versions


def _packages(spark, sf_dir):
    """Two versions of a package of customers, suppliers and parts; the new one lost customers in debt, got nations and changed sizes over 40."""
    kind = lambda t, key, body, note: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(key).cast("long").alias("id"), F.col(body).cast("string").alias("body"), F.lit(note).alias("status"))
    old = kind("customer", "c_custkey", "c_mktsegment", "open").unionByName(kind("supplier", "s_suppkey", "s_name", "open")).unionByName(kind("part", "p_partkey", "p_size", "open"))
    lost = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    new = old.join(lost, ["kind", "id"], "left_anti").withColumn("body", F.when((F.col("kind") == "part") & (F.try_to_number("body", F.lit("999")) > 40), "40").otherwise(F.col("body"))).withColumn("status", F.lit("sealed"))
    return old, new.unionByName(kind("nation", "n_nationkey", "n_name", "sealed"))


_CHANGES = """SELECT 'customer' AS kind, c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'removed' ELSE 'unchanged' END AS change FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'unchanged' FROM supplier
UNION ALL SELECT 'part', p_partkey, CASE WHEN p_size > 40 THEN 'changed' ELSE 'unchanged' END FROM part UNION ALL SELECT 'nation', n_nationkey, 'added' FROM nation"""


@query(_CHANGES)
def inventory_diff(spark, sf_dir):
    """Records of four kinds in two versions; the status, which the new version set throughout, doesn't count."""
    return V.inventory_diff(*_packages(spark, sf_dir), ignored=["status"])


@query(f"SELECT kind, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged FROM ({_CHANGES}) GROUP BY 1")
def change_report(spark, sf_dir):
    found = V.inventory_diff(*_packages(spark, sf_dir), ignored=["status"])
    return found.groupBy("kind").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")))


@query("""WITH o AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag <> 'A')
SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst""")
def edge_diff(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return V.edge_diff(edges.filter("l_returnflag <> 'R'"), edges.filter("l_returnflag <> 'A'"))


@query("""WITH a AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN o THEN 'unknown' WHEN n IS NULL THEN 'unchanged' WHEN n % 2 = 0 THEN 'applied' ELSE 'stale' END AS outcome, CASE WHEN NOT o THEN CASE WHEN n % 2 = 0 THEN 'VIP' ELSE c_mktsegment END END AS c_mktsegment
FROM (SELECT c_custkey, c_mktsegment, n, false AS o FROM customer LEFT JOIN a USING (c_custkey) UNION ALL SELECT -1 - s_suppkey, NULL, 0, true FROM supplier)""")
def keyed_overrides(spark, sf_dir):
    """Customers with orders get a new segment if the update knows the old one (it does where their number is even)."""
    rows = table(spark, sf_dir, "customer")
    asked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).join(rows, "c_custkey")
    known = F.when(F.col("n") % 2 == 0, F.sha2("c_mktsegment", 256)).otherwise(F.sha2(F.lit("?"), 256))
    updates = asked.select("c_custkey", known.alias("before_sha256"), F.lit("VIP").alias("c_mktsegment"))
    updates = updates.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("").alias("before_sha256"), F.lit("VIP").alias("c_mktsegment")))
    return V.overrides(rows, updates, "c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'same' WHEN c_custkey % 4 = 1 THEN 'collision' ELSE 'kept' END AS outcome, c_mktsegment, c_nationkey FROM customer
UNION ALL SELECT -1 - s_suppkey, 'added', 'NEW', s_nationkey FROM supplier""")
def package_extension(spark, sf_dir):
    """A package of customers extended by rows that are new, the same, or collide with what is there."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    more = base.filter("c_custkey % 4 < 2").withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 1, -1).otherwise(F.col("c_nationkey")))
    more = more.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.col("s_nationkey").alias("c_nationkey")))
    return changes.insert_only(base, more, "c_custkey")


@query("""WITH s AS (SELECT l_suppkey AS package, l_partkey AS source, md5(l_returnflag) AS h, l_quantity::INT AS f, (l_quantity + 1)::INT AS l FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f, l, package) AS rn FROM s),
o AS (SELECT a.source, count(*) AS n FROM m a JOIN (SELECT a.source, a.rn, max(struct_pack(l := b.l, p := b.package)) AS r FROM m a JOIN m b ON a.source = b.source AND b.rn < a.rn GROUP BY ALL) b ON a.source = b.source AND a.rn = b.rn WHERE a.f <= b.r.l AND b.r.p <> a.package GROUP BY 1)
SELECT source, 'overlap' AS issue, n FROM o UNION ALL SELECT source, 'hash', count(DISTINCT h) FROM s GROUP BY 1 HAVING count(DISTINCT h) > 1""")
def package_sources(spark, sf_dir):
    """Parts as sources that suppliers' packages claim by pages."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("source"), F.md5(F.col("l_returnflag").cast("binary")).alias("sha256"), F.col("l_quantity").cast("int").alias("first_page"), (F.col("l_quantity") + 1).cast("int").alias("last_page"))
    return V.page_scope_conflicts(rows)


# evidence

_SHA = """sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}')"""


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS package, {_SHA} AS sha FROM orders WHERE o_orderkey % 10 <> 3), d AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 10 <> 3),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus AS package, CASE WHEN l_linenumber = 2 THEN 'old' ELSE {_SHA} END AS sha FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN d.o_orderkey IS NOT NULL THEN 'ambiguous' WHEN r.sha <> o.sha THEN 'drift' ELSE 'resolved' END AS state
FROM r LEFT JOIN o ON o.o_orderkey = l_orderkey AND o.package = r.package LEFT JOIN d ON d.o_orderkey = l_orderkey""")
def citation_states(spark, sf_dir):
    """Lines cite orders by package, id and hash; some orders are gone, some held twice, some cited under an old hash."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("package"), V.record_hash("o_custkey", "o_orderstatus").alias("object_sha256"))
    held = orders.filter("object_id % 10 <> 3")
    held = held.unionByName(held.filter("object_id % 11 = 0"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object_id"), "l_linenumber", "l_partkey")
    cited = lines.join(orders, "object_id").withColumn("object_sha256", F.when(F.col("l_linenumber") == 2, "old").otherwise(F.col("object_sha256")))
    return V.citations(cited, held, package=["package"]).select(F.col("object_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "state")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS object_id, l_partkey AS evidence_id FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS object_id, l_suppkey AS source_id FROM lineitem)
SELECT object_id, evidence_id, EXISTS (SELECT 1 FROM s WHERE s.object_id = o.object_id AND s.source_id = evidence_id % 10) AS source_ok FROM o WHERE (object_id + evidence_id) % 2 = 0""")
def evidence_pairs(spark, sf_dir):
    """Orders name their parts as evidence, and parts name back those orders that make an even sum with them."""
    lines = table(spark, sf_dir, "lineitem")
    objects = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("evidence_ids"), F.collect_set("l_suppkey").alias("source_ids"))
    anchors = lines.filter("(l_orderkey + l_partkey) % 2 = 0").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_orderkey").alias("supports")).withColumn("source_id", F.col("id") % 10)
    return V.evidence_refs(objects, anchors)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN length(text) < 40 THEN 'outside' WHEN doc_id % 6 = 1 THEN 'drift' ELSE 'verified' END AS state FROM documents""")
def span_states(spark, sf_dir):
    """Anchors of 30 characters from the eleventh on, against the pages that are there."""
    docs = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 6 == 1, "changed").otherwise(F.substring("text", 11, 30))
    spans = docs.select("doc_id", F.lit(10).alias("start"), F.lit(40).alias("end"), F.sha2(said, 256).alias("sha256"))
    return V.span_checks(spans, docs.filter("doc_id % 6 <> 0"), page="doc_id", text="text").select("doc_id", "state")


@query(r"""WITH r AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), c AS (SELECT *, CASE WHEN turn = 0 THEN 5 ELSE 0 END AS lo, CASE WHEN turn = last THEN least(60, length(text)) ELSE length(text) END AS hi FROM r),
b AS (SELECT *, substr(text, lo + 1, greatest(hi - lo, 0)) AS raw FROM c), s AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body, lo + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS st FROM b)
SELECT conv_id AS range_id, conv_id, turn, st::INT AS start, (st + length(body))::INT AS "end", sha256(body) AS sha256 FROM s WHERE body <> ''""")
def focus_spans(spark, sf_dir):
    """A range per conversation, from the sixth character of its first turn to the sixtieth of its last."""
    turns = table(spark, sf_dir, "conversations")
    ranges = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("first_page"), F.max("turn").alias("last_page")).withColumns({"range_id": F.col("conv_id"), "first_at": F.lit(5), "last_at": F.lit(60)})
    return V.focus_spans(ranges, turns, book="conv_id", page="turn", text="text")


@query("""SELECT conv_id, turn, coalesce(right(lag(text) OVER w, 40), '') AS "before", coalesce(left(lead(text) OVER w, 40), '') AS "after" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_windows(spark, sf_dir):
    return V.context_windows(table(spark, sf_dir, "conversations"), book="conv_id", page="turn", text="text", characters=40)


# reviews


@query("""WITH e AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT l_orderkey AS k, count(*) AS n, min(l_orderkey % 7 = 0) AS other FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(e.k, a.k) AS o_orderkey, CASE WHEN e.k IS NULL THEN 'surplus' WHEN a.k IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN other THEN 'different' ELSE 'equal' END AS state
FROM e FULL JOIN (SELECT * FROM a UNION ALL SELECT -1 - s_suppkey, 1, false FROM supplier) a ON a.k = e.k""")
def fragment_coverage(spark, sf_dir):
    """Orders as the queue of a review, their returned lines as what the reviewers handed in."""
    queue = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("unit"))
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_orderkey") % 7 == 0, -1).otherwise(F.col("l_orderkey") % 5).cast("long").alias("unit"))
    more = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit(0).cast("long").alias("unit"))
    return V.coverage(queue, done.unionByName(more), "o_orderkey", ["unit"])


@query("""SELECT c_custkey, 'title' AS field, CASE c_custkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'eliminated' ELSE 'substantive' END AS state FROM customer
UNION ALL SELECT c_custkey, 'note', CASE WHEN c_acctbal < 0 THEN 'substantive' ELSE 'same' END FROM customer""")
def field_disputes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    left = rows.select("c_custkey", F.col("c_name").alias("title"), F.when(F.col("c_acctbal") >= 0, "x").alias("note"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), "c_name", F.lit("\t\r\n"))).otherwise(F.upper("c_name"))
    return V.field_disputes(left, rows.select("c_custkey", said.alias("title"), F.lit("x").alias("note")), "c_custkey", ["title", "note"])


@query("SELECT l_suppkey, count(*) AS n_reviews FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 'fine' ELSE l_returnflag END AS r FROM lineitem) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT r) < 2")
def blanket_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, "fine").otherwise(F.col("l_returnflag")).alias("rationale"))
    return V.blanket_reviews(rows, "l_suppkey", "rationale")


@query("SELECT o_orderkey, unnest(['anna', 'ben']) AS reviewer FROM orders")
def review_queues(spark, sf_dir):
    return V.assigned(table(spark, sf_dir, "orders"), ["carl", "ben", "anna"], 2, "o_orderkey")
