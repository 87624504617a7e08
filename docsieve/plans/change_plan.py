"""Queries on changes of a dependency graph: places, customers, suppliers and orders before and after.

Nations that 5 divides get another content, nation 3 moves to the next region
(edges change, no node does), a third of nation 4's customers go with all their
edges, nations that 7 divides get a new customer, some receipts are lost, and
some suppliers change in what their nodes allow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import change_plan as C
from docsieve.operators import graph
from docsieve.plans.registry import query, table

_PLAIN = "'a' AS content, 'a' AS ident, 'p' AS protocol, 2 AS reviewers, false AS execute, '' AS tag, false AS short"
_GRAPHS = f"""WITH RECURSIVE
same AS (SELECT 'r:' || r_regionkey AS node, 'source' AS kind, {_PLAIN} FROM region UNION ALL SELECT 'o:' || o_orderkey, 'semantic_assertion', {_PLAIN} FROM orders UNION ALL SELECT DISTINCT 'k:' || c_mktsegment, 'package', {_PLAIN} FROM customer),
n0 AS (FROM same UNION ALL SELECT 'n:' || n_nationkey, 'page', {_PLAIN} FROM nation UNION ALL SELECT 'c:' || c_custkey, 'segment', {_PLAIN} FROM customer UNION ALL SELECT 'x:' || n_nationkey, 'receipt', {_PLAIN} FROM nation WHERE n_nationkey % 9 = 0
  UNION ALL SELECT 's:' || s_suppkey, 'support', 'a', 'a', 'p', 2, false, '', s_suppkey % 50 = 10 FROM supplier),
kept AS (SELECT * FROM customer WHERE c_nationkey <> 4 OR c_custkey % 3 <> 0),
n1 AS (FROM same UNION ALL SELECT 'n:' || n_nationkey, 'page', CASE WHEN n_nationkey % 5 = 0 THEN 'b' ELSE 'a' END, CASE WHEN n_nationkey % 10 = 5 THEN 'b' ELSE 'a' END, 'p', 2, false, CASE WHEN n_nationkey = 10 THEN 'manual_fix' ELSE '' END, false FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'segment', {_PLAIN} FROM kept UNION ALL SELECT 'c:new' || n_nationkey, 'segment', {_PLAIN} FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'x:' || n_nationkey, 'receipt', {_PLAIN} FROM nation WHERE n_nationkey % 18 = 9
  UNION ALL SELECT 's:' || s_suppkey, 'support', 'a', 'a', CASE WHEN s_suppkey % 50 = 9 THEN 'q' ELSE 'p' END, CASE WHEN s_suppkey % 50 = 8 THEN 1 ELSE 2 END, s_suppkey % 50 = 7, '', s_suppkey % 50 = 10 FROM supplier),
placed AS (SELECT 'n:' || s_nationkey AS src, 's:' || s_suppkey AS dst FROM supplier),
e0 AS (FROM placed UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation UNION ALL SELECT 'x:' || n_nationkey, 'n:' || n_nationkey FROM nation WHERE n_nationkey % 9 = 0 UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'c:' || c_custkey, 'k:' || c_mktsegment FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders),
e1 AS (FROM placed UNION ALL SELECT 'r:' || CASE WHEN n_nationkey = 3 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END, 'n:' || n_nationkey FROM nation UNION ALL SELECT 'x:' || n_nationkey, 'n:' || n_nationkey FROM nation WHERE n_nationkey % 18 = 9 UNION ALL SELECT 'n:' || n_nationkey, 'c:new' || n_nationkey FROM nation WHERE n_nationkey % 7 = 0
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM kept UNION ALL SELECT 'c:' || c_custkey, 'k:' || c_mktsegment FROM kept UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders WHERE 'c:' || o_custkey IN (SELECT 'c:' || c_custkey FROM kept)),
st AS (SELECT coalesce(a.node, b.node) AS node, coalesce(b.kind, a.kind) AS kind, a.kind AS ok, b.kind AS nk, a.ident AS oi, b.ident AS ni, a.protocol AS op, b.protocol AS np, a.reviewers AS orv, b.reviewers AS nrv, b.execute AND NOT a.execute AS raised, coalesce(b.short, false) AS short, coalesce(b.tag, '') AS tag,
  CASE WHEN a.node IS NULL THEN 'added' WHEN b.node IS NULL THEN 'removed' WHEN (a.content, a.protocol, a.reviewers, a.execute) = (b.content, b.protocol, b.reviewers, b.execute) THEN 'unchanged' ELSE 'changed' END AS change FROM n0 a FULL JOIN n1 b ON a.node = b.node),
ed AS (SELECT * FROM ((FROM e0 EXCEPT FROM e1) UNION ALL (FROM e1 EXCEPT FROM e0))),
ends AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed),
ro AS (SELECT node, kind, CASE WHEN change = 'unchanged' THEN 'changed' ELSE change END AS change, CASE WHEN change = 'unchanged' THEN 'typed_edge_changed' WHEN tag <> '' THEN tag WHEN change = 'added' THEN 'node_added' WHEN change = 'removed' THEN 'node_deleted' WHEN kind = 'page' THEN 'page_text_or_structure_changed' ELSE kind || '_changed' END AS reason FROM st WHERE change <> 'unchanged' OR node IN (FROM ends)),
hit1 AS (SELECT node AS root, node FROM ro UNION SELECT root, dst FROM hit1 JOIN e1 ON src = node),
hit0 AS (SELECT node AS root, node FROM ro WHERE change = 'removed' UNION SELECT root, dst FROM hit0 JOIN e0 ON src = node),
ca AS (SELECT h.node, root, reason FROM hit1 h JOIN ro ON ro.node = root UNION SELECT node, root, 'node_deleted' FROM hit0),
vi AS (SELECT node, 'original_node_missing' AS code, '' AS detail FROM st WHERE nk IS NULL AND ok IN ('source', 'receipt') UNION ALL SELECT node, 'stable_id_semantic_drift', '' FROM st WHERE oi <> ni UNION ALL SELECT node, 'protocol_identity_changed', '' FROM st WHERE op <> np
  UNION ALL SELECT node, 'reviewer_requirement_narrowed', '' FROM st WHERE nrv < orv UNION ALL SELECT node, 'capability_escalation', 'execute' FROM st WHERE raised UNION ALL SELECT node, 'required_receipt_missing', 'q' FROM st WHERE short)"""
_ASKED = "CASE kind WHEN 'semantic_assertion' THEN 'rebuild,re-review' WHEN 'support' THEN 'rebuild,re-review' WHEN 'package' THEN 'repackage' WHEN 'receipt' THEN 'rebuild' ELSE 're-extract,rebuild' END"
_GATE = "CASE kind WHEN 'source' THEN 'source-identity' WHEN 'semantic_assertion' THEN 'independent-semantic-review' WHEN 'support' THEN 'independent-semantic-review' WHEN 'package' THEN 'package-integrity' WHEN 'receipt' THEN 'receipt-validation' ELSE 'structure-resolution' END"


def _id(kind, key):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _graphs(spark, sf_dir):
    """(old nodes, new nodes, old edges, new edges)."""
    region, nation, customer, supplier, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders"))

    def nodes(df, node, kind, **own):
        a = F.lit("a")
        fields = {"content": a, "identity": a, "evidence": a, "protocol": F.lit("p"), "inputs": a, "reviewers": F.lit(2), "tag": F.lit(""), "execute": F.lit(False), "required_receipts": F.array().cast("array<string>"), "receipts": F.array().cast("array<string>")} | own
        execute = fields.pop("execute")
        return df.select(node.alias("node"), F.lit(kind).alias("kind"), *(c.alias(n) for n, c in fields.items()), F.create_map(F.lit("execute"), execute, F.lit("read"), F.lit(True)).alias("capabilities"))

    def edges(df, src, dst):
        return df.select(F.concat(src, F.lit(">"), dst).alias("edge"), src.alias("src"), dst.alias("dst"))

    def union(first, *more):
        for df in more:
            first = first.unionByName(df)
        return first

    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    kept = customer.filter("c_nationkey <> 4 OR c_custkey % 3 <> 0")
    same = union(nodes(region, _id("r", "r_regionkey"), "source"), nodes(orders, _id("o", "o_orderkey"), "semantic_assertion"), nodes(customer.select("c_mktsegment").distinct(), _id("k", "c_mktsegment"), "package"))
    wanted = {"required_receipts": F.when(s % 50 == 10, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>"))}
    old = union(
        same, nodes(nation, _id("n", "n_nationkey"), "page"), nodes(customer, _id("c", "c_custkey"), "segment"), nodes(nation.filter("n_nationkey % 9 = 0"), _id("x", "n_nationkey"), "receipt"), nodes(supplier, _id("s", "s_suppkey"), "support", **wanted)
    )
    b = lambda when: F.when(when, "b").otherwise("a")
    new = union(
        same,
        nodes(nation, _id("n", "n_nationkey"), "page", content=b(n % 5 == 0), identity=b(n % 10 == 5), tag=F.when(n == 10, "manual_fix").otherwise("")),
        nodes(kept, _id("c", "c_custkey"), "segment"),
        nodes(nation.filter("n_nationkey % 7 = 0"), F.concat(F.lit("c:new"), n.cast("string")), "segment"),
        nodes(nation.filter("n_nationkey % 18 = 9"), _id("x", "n_nationkey"), "receipt"),
        nodes(supplier, _id("s", "s_suppkey"), "support", protocol=F.when(s % 50 == 9, "q").otherwise("p"), reviewers=F.when(s % 50 == 8, 1).otherwise(2), execute=s % 50 == 7, **wanted),
    )
    placed = edges(supplier, _id("n", "s_nationkey"), _id("s", "s_suppkey"))
    from_customers = lambda df: union(edges(df, _id("n", "c_nationkey"), _id("c", "c_custkey")), edges(df, _id("c", "c_custkey"), _id("k", "c_mktsegment")), edges(orders.join(df.hint("merge"), orders["o_custkey"] == df["c_custkey"]), _id("c", "o_custkey"), _id("o", "o_orderkey")))
    receipts = lambda when: edges(nation.filter(when), _id("x", "n_nationkey"), _id("n", "n_nationkey"))
    moved = nation.withColumn("n_regionkey", F.when(n == 3, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey")))
    regions = lambda df: edges(df, _id("r", "n_regionkey"), _id("n", "n_nationkey"))
    fresh = edges(nation.filter("n_nationkey % 7 = 0"), _id("n", "n_nationkey"), F.concat(F.lit("c:new"), n.cast("string")))
    return old, new, union(placed, regions(nation), receipts("n_nationkey % 9 = 0"), from_customers(customer)), union(placed, regions(moved), receipts("n_nationkey % 18 = 9"), fresh, from_customers(kept))


def _found(spark, sf_dir):
    old, new, old_edges, new_edges = _graphs(spark, sf_dir)
    states = graph.cut(C.node_states(old, new))
    return states, graph.cut(C.roots(states, C.edge_changes(old_edges, new_edges))), old_edges, new_edges


@query(f"{_GRAPHS} SELECT node, kind, change, reason FROM ro")
def change_roots(spark, sf_dir):
    return _found(spark, sf_dir)[1]


@query(f"""{_GRAPHS} SELECT node, kind, {_ASKED} AS required_actions, string_split({_ASKED}, ',')[-1] AS final_action, {_GATE} AS final_gate FROM st WHERE node IN (SELECT node FROM ca)""")
def invalidation_plan(spark, sf_dir):
    """What each node that a change reaches asks for."""
    return C.invalidations(*_found(spark, sf_dir)).select("node", "kind", F.array_join("required_actions", ",").alias("required_actions"), "final_action", "final_gate")


@query(f"{_GRAPHS} SELECT node, root, reason FROM ca")
def invalidation_causes(spark, sf_dir):
    return C.causes(*_found(spark, sf_dir)[1:]).select("node", "root", "reason")


@query(f"""{_GRAPHS}, w AS (SELECT node, [node] AS back FROM ro UNION ALL SELECT dst, list_prepend(dst, back) FROM w JOIN e1 ON src = w.node),
k AS (SELECT node, back, row_number() OVER (PARTITION BY node ORDER BY len(back), back) AS nth FROM w) SELECT node, nth::INT AS nth, array_to_string(list_reverse(back), '>') AS path FROM k WHERE nth <= 32""")
def invalidation_paths(spark, sf_dir):
    """The 32 shortest ways of a change to each node; packages have as many ways as customers."""
    _, found, _, new_edges = _found(spark, sf_dir)
    return C.cause_paths(found, new_edges)


@query(f"{_GRAPHS} SELECT node, code, detail, CASE WHEN code <> 'required_receipt_missing' THEN reason END AS reason FROM vi LEFT JOIN ro USING (node)")
def change_violations(spark, sf_dir):
    return C.violations(*_found(spark, sf_dir)[:2])


@query(f"""{_GRAPHS}, f AS (SELECT node, list_filter([CASE WHEN node IN (SELECT node FROM ca) THEN 'dependency_invalidated' END, CASE WHEN node IN (SELECT node FROM vi WHERE code <> 'required_receipt_missing') THEN 'fail_closed_identity_or_policy' END, CASE WHEN change <> 'unchanged' THEN 'node_changed' END, CASE WHEN short THEN 'required_receipt_missing' END], lambda x: x IS NOT NULL) AS r FROM st WHERE nk IS NOT NULL)
SELECT node, len(r) = 0 AS eligible, CASE WHEN len(r) = 0 THEN 'inputs_protocol_dependencies_unchanged' ELSE array_to_string(r, ',') END AS reason_codes FROM f""")
def reuse_plan(spark, sf_dir):
    states, found, old_edges, new_edges = _found(spark, sf_dir)
    plan = C.reuse(states, C.invalidations(states, found, old_edges, new_edges), C.violations(states, found))
    return plan.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query(f"""{_GRAPHS}, i AS (SELECT unnest(string_split({_ASKED}, ',')) AS action, {_GATE} AS gate FROM st WHERE node IN (SELECT node FROM ca)), a AS (SELECT action, count(*) AS n_nodes, list_sort(list(DISTINCT gate)) AS g FROM i GROUP BY 1)
SELECT list_position(['re-extract', 'rebuild', 're-review', 'retest', 'repackage', 'reseal', 'recertify', 'recompose'], action)::INT AS place, action, n_nodes, array_to_string(g, ',') AS gates,
CASE WHEN action IN ('re-review', 'repackage') OR list_has_any(g, ['structure-resolution', 'independent-semantic-review']) THEN 'paused' ELSE 'allowed-local-deterministic' END AS execution FROM a""")
def change_actions(spark, sf_dir):
    return C.action_plan(C.invalidations(*_found(spark, sf_dir))).withColumn("gates", F.array_join("gates", ","))


@query(f"""{_GRAPHS} SELECT 'nodes:' || change AS part, count(*) AS n FROM st GROUP BY 1 UNION ALL SELECT 'edges:' || change, count(*) FROM (SELECT CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM e0 a FULL JOIN e1 b ON a.src = b.src AND a.dst = b.dst) GROUP BY 1
UNION ALL SELECT 'roots:' || reason, count(*) FROM ro GROUP BY 1 UNION ALL SELECT 'causes', count(*) FROM ca UNION ALL SELECT 'violations:' || code, count(*) FROM vi GROUP BY 1""")
def snapshot_comparison(spark, sf_dir):
    """The whole comparison of two snapshots, by what its tables hold."""
    t = C.compare(*_graphs(spark, sf_dir))
    count = lambda df, part: df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    by = lambda name, c: count(t[name], F.concat(F.lit(f"{name}:"), c))
    return by("nodes", "change").unionByName(by("edges", "change")).unionByName(by("roots", "reason")).unionByName(count(t["causes"], F.lit("causes"))).unionByName(by("violations", "code"))
