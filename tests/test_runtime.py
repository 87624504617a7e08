"""Change plans, closures, hashed graphs, calculations, schemas and outlines on small odd inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docsieve.functions import schemas
from docsieve.operators import calculation as N
from docsieve.operators import change_plan as C
from docsieve.operators import closure as L
from docsieve.operators import graph, merkle
from docsieve.operators import packages as K
from docsieve.sources import outlines


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges_of(spark, pairs):
    return frame(spark, pairs, "src string, dst string")


# paths and reach


def test_paths_are_the_shortest_of_all(spark):
    """A layered graph has 3 ** 5 ways; only the best are ever kept."""
    pairs = [(f"{i}{a}", f"{i + 1}{b}") for i in range(5) for a in "abc" for b in "abc"] + [("0a", "3b"), ("4c", "end")]
    ends = frame(spark, [("5a",), ("end",)], "node string")
    got = graph.shortest_paths(edges_of(spark, pairs), ends, most=7)
    links, ways = {}, {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)

    def walk(path):
        if path[-1] in ("5a", "end"):
            ways.setdefault(path[0], []).append(path)
        for b in links.get(path[-1], []):
            walk([*path, b])

    for node in {n for p in pairs for n in p}:
        walk([node])
    expected = {(n, ">".join(p), i) for n, ps in ways.items() for i, p in enumerate(sorted(ps, key=lambda p: (len(p), p))[:7], 1)}
    assert {(r["node"], ">".join(r["path"]), r["nth"]) for r in got.collect()} == expected


def test_ways_back_to_themselves_end(spark):
    loop = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    assert {tuple(r) for r in K.paths_to_roots(loop, frame(spark, [("a",), ("b",), ("c",)], "node string")).collect()} == {("a", "a>b>c", 1), ("b", "b>c", 1), ("c", "c", 1)}
    assert {tuple(r) for r in graph.downstream(loop, frame(spark, [("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_many_written_rows_ask_for_merge_joins(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")]
    monkeypatch.setattr(graph, "MOST_SENT", 1)
    plans, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    found = graph.downstream(edges_of(spark, pairs), frame(spark, [("a",), ("x",)], "node string"))
    assert {tuple(r) for r in found.collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert plans[2].count("SortMergeJoin") == 2 and "Broadcast" not in plans[2]


# change plans

NODE = "node string, kind string, content string, identity string, evidence string, protocol string, inputs string, reviewers int, capabilities map<string,boolean>, tag string, required_receipts array<string>, receipts array<string>"


def node(name, kind="page", content="a", **own):
    row = {"identity": "i", "evidence": "e", "protocol": "p", "inputs": "", "reviewers": 2, "capabilities": {"x": False}, "tag": None, "required_receipts": [], "receipts": []} | own
    return (name, kind, content, *row.values())


def graphs(spark, old, new, old_pairs, new_pairs):
    edge = lambda pairs: frame(spark, [(f"{a}>{b}", a, b) for a, b in pairs], "edge string, src string, dst string")
    return frame(spark, old, NODE), frame(spark, new, NODE), edge(old_pairs), edge(new_pairs)


def test_states_of_all_nodes_are_not_broadcast(spark):
    """Their files are far smaller than their rows, so that Spark would take them for small."""
    states, found = (graph.cut(df) for df in plan_tables(spark))
    links = edges_of(spark, [("a", "b")]).withColumn("edge", F.lit("e"))
    joined = C.invalidations(states, found, links, links), C.violations(states, found)
    for df, nodes in zip(joined, ({"a", "b"}, {"a"}), strict=True):
        assert {r["node"] for r in df.collect()} == nodes
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def plan_tables(spark):
    plain = lambda node, protocol: (node, "page", "x", "x", "x", protocol, "x", 1, {}, "", [], [])
    states = C.node_states(frame(spark, [plain("a", "p"), plain("b", "p"), plain("c", "p")], NODE), frame(spark, [plain("a", "q"), plain("b", "p"), plain("c", "p")], NODE))
    none = edges_of(spark, []).withColumn("edge", F.lit("e"))
    return states, C.roots(states, C.edge_changes(none, none))


def test_edges_alone_invalidate_both_ends(spark):
    same = [node(n) for n in "abcd"]
    t = C.compare(*graphs(spark, same, same, [("a", "b"), ("b", "c")], [("a", "b"), ("d", "c")]))
    assert {(r["node"], r["change"], r["reason"]) for r in t["roots"].collect()} == {(n, "changed", "typed_edge_changed") for n in "bcd"}
    assert {r["node"] for r in t["invalidations"].collect()} == {"b", "c", "d"}
    assert {(r["node"], r["eligible"], tuple(r["reason_codes"])) for r in t["reuse"].collect()} == {("a", True, ("inputs_protocol_dependencies_unchanged",)), *((n, False, ("dependency_invalidated",)) for n in "bcd")}
    assert t["violations"].count() == 0


def test_actions_gates_and_violations_by_kind(spark):
    old = [node("s", "source"), node("m", "model", content="1"), node("f", "formula_ast"), node("w", "alignment_candidate"), node("q", "odd kind"), node("k", "package", required_receipts=["r1", "r2"], receipts=["r1"])]
    new = [node("m", "model", content="2", identity="j", evidence="o", reviewers=1, capabilities={"x": True}, tag="swap"), *old[2:]]
    t = C.compare(*graphs(spark, old, new, [("s", "m"), ("m", "f"), ("f", "w"), ("w", "q"), ("q", "k")], [("m", "f"), ("f", "w"), ("w", "q"), ("q", "k")]))
    found = {r["node"]: (list(r["required_actions"]), r["final_action"], r["final_gate"]) for r in t["invalidations"].collect()}
    assert found == {
        "s": (["re-extract", "rebuild"], "rebuild", "source-identity"),
        "m": (["re-extract", "rebuild", "re-review", "repackage", "recompose"], "recompose", "model-contract"),
        "f": (["rebuild", "re-review", "retest"], "retest", "formula-review-and-execution-gates"),
        "w": (["re-review", "recompose"], "recompose", "independent-semantic-review"),
        "q": (["rebuild"], "rebuild", "unknown-node"),
        "k": (["repackage"], "repackage", "package-integrity"),
    }
    assert {(r["node"], r["code"], r["detail"]) for r in t["violations"].collect()} == {
        ("s", "original_node_missing", ""), ("m", "stable_id_semantic_drift", ""), ("m", "stable_id_evidence_drift", ""), ("m", "reviewer_requirement_narrowed", ""), ("m", "capability_escalation", "x"), ("k", "required_receipt_missing", "r2"),
    }
    causes = {(r["node"], r["root"], r["reason"]) for r in t["causes"].collect()}
    assert ("m", "s", "node_deleted") in causes and ("k", "m", "swap") in causes and ("k", "s", "node_deleted") in causes
    assert [(r["action"], r["execution"]) for r in t["actions"].orderBy("place").collect()] == [("re-extract", "allowed-local-deterministic"), *((a, "paused") for a in ("rebuild", "re-review", "retest", "repackage", "recompose"))]
    assert {r["path"] for r in t["paths"].filter("node = 'f'").collect()} == {"m>f"}


def test_reasons_and_empty_graphs(spark):
    reason = lambda k: spark.range(1).select(C.change_reason(F.lit(k)).alias("r")).first()[0]
    assert [reason(k) for k in ("source", "config", "parser", "visual_gold", "table_cell", "unknown", "else")] == ["source_identity_changed", "configuration_changed", "parser_changed", "visual_gold_changed", "artifact_changed", "artifact_changed", "artifact_changed"]
    assert set(C.KIND_ACTIONS) == set(C.KIND_GATES)
    t = C.compare(*graphs(spark, [], [], [], []))
    assert all(df.count() == 0 for df in t.values())


# closures


def plain_closure(links, sizes, seeds, max_hops, max_objects, max_bytes):
    queue, seen, out, nodes, spent = [(s, 0) for s in seeds], set(), [], 0, 0
    while queue:
        n, d = queue.pop(0)
        if n in seen:
            continue
        seen.add(n)
        if n not in sizes:
            state = "missing"
        elif d > max_hops:
            state = "hop_limit"
        elif nodes >= max_objects:
            state = "object_limit"
        elif spent + sizes[n] > max_bytes // 2:
            state = "byte_limit"
        else:
            state, nodes, spent = "taken", nodes + 1, spent + sizes[n]
            queue += [(m, d + 1) for m in links.get(n, [])]
        out.append((n, d, len(out) + 1, state))
    return out


@pytest.mark.parametrize("limits", [(3, 64, 1 << 20), (2, 9, 400), (4, 1000, 700), (0, 5, 1000)])
def test_closures_pop_a_queue(spark, limits):
    dice = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    links = {n: [m for m in dice.sample([*names, "gone"], 4) if m != n] for n in names}
    sizes = {n: dice.randint(5, 60) for n in names}
    edges = frame(spark, [(a, b, i) for a, bs in links.items() for i, b in enumerate(bs)] * 2, "src string, dst string, nth long")
    asked = {r: dice.sample(names, 3) for r in ("q1", "q2", "q3")} | {"q4": ["gone"]}
    seeds = frame(spark, [(r, s, i) for r, ss in asked.items() for i, s in enumerate(ss)], "request string, node string, nth long")
    closed = L.budgeted(edges, seeds, frame(spark, list(sizes.items()), "node string, bytes long"), max_hops=limits[0], max_objects=limits[1], max_bytes=limits[2])
    got = {(r["request"], r["node"], r["hop"], r["place"], r["state"]) for r in closed.collect()}
    assert got == {(r, *x) for r, ss in asked.items() for x in plain_closure(links, sizes, ss, *limits)}
    ledger = L.gap_ledger(closed, most=2).filter("request = 'q1'").collect()
    gaps = [x for x in plain_closure(links, sizes, asked["q1"], *limits) if x[3] != "taken"]
    assert [(r["nth"], r["node"]) for r in sorted(ledger, key=lambda r: (r["node"] is None, r["nth"])) if r["node"]] == [(i, g[0]) for i, g in enumerate(gaps[:2], 1)]
    assert [r["nth"] for r in ledger if r["node"] is None] == ([len(gaps) - 2] if len(gaps) > 2 else [])


# hashed graphs


def test_hashes_break_upwards_only(spark):
    nodes = frame(spark, [(n, n) for n in "abcdexy"], "node string, content string")
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("x", "y"), ("y", "x")])
    stored = merkle.rolled(nodes, edges)
    assert {r["node"]: r["level"] for r in stored.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "x": None, "y": None}
    assert {tuple(r) for r in merkle.breaks(stored, nodes, edges).collect()} == {("x", None, "unhashed", False), ("y", None, "unhashed", False)}
    sound = edges.filter("src NOT IN ('x', 'y')")
    stored = merkle.rolled(nodes, sound)
    now = nodes.withColumn("content", F.when(F.col("node") == "b", "B").otherwise(F.col("content")))
    assert {tuple(r) for r in merkle.breaks(stored, now, sound).collect()} == {("b", 1, "content", True), ("c", 2, "inherited", False)}
    assert {tuple(r) for r in merkle.breaks(stored, nodes, sound.unionByName(edges_of(spark, [("d", "b")]))).collect()} == {("b", 1, "inputs", True), ("c", 2, "inherited", False)}
    assert merkle.rolled(nodes.limit(0), edges.limit(0)).count() == 0


# calculations


def test_calculations_gate_and_refuse(spark):
    f = [N.Formula("b", "m", ["add", ["symbol", "a"], ["symbol", "x"]], {"a": "m", "x": "m"}), N.Formula("a", "km", ["multiply", ["symbol", "x"], ["number", "2"]], {"x": "km"})]
    facts = frame(spark, [(1, "x", 3.0, "cm"), (2, "x", 1.0, "h"), (3, "other", 1.0, "m"), (4, "x", None, "m"), (5, "x", 1.0, "m"), (5, "x", 1.0, "m")], "request int, symbol string, value double, unit string")
    rows = {(r["request"], r["formula"]): (r["value"], r["state"], r["detail"]) for r in N.run(facts, f).collect()}
    assert rows[1, "b"][0] == pytest.approx(0.09) and rows[1, "b"][1] == "computed" and rows[5, "b"][0] == pytest.approx(3.0)
    assert rows[2, "a"] == (None, "blocked", "unit:x") and rows[2, "b"] == (None, "blocked", "blocked:a,unit:x")
    assert rows[3, "a"] == rows[4, "a"] == (None, "blocked", "missing:x")
    closed = N.run(facts, f, gate=F.element_at("facts", F.lit("x"))["value"] > 2)
    assert {r["state"] for r in closed.filter("request <> 1").collect()} == {"gate_closed"} and closed.filter("state = 'computed'").count() == 2
    with pytest.raises(ValueError, match="depend on each other"):
        N.in_order([N.Formula("a", "m", ["symbol", "b"], {"b": "m"}), N.Formula("b", "m", ["symbol", "a"], {"a": "m"})])
    with pytest.raises(ValueError, match="dimension"):
        N.in_order([N.Formula("a", "m", ["symbol", "b"], {"b": "m"}), N.Formula("b", "s", ["symbol", "c"], {"c": "s"})])
    with pytest.raises(ValueError, match="not in"):
        N.in_order([N.Formula("a", "s", ["symbol", "b"], {"b": "m"})])


# schemas and outlines


def test_schemas_bound_what_leads_into_itself(spark):
    deep = {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "additionalProperties": False, "required": ["n"], "properties": {"n": {"oneOf": [{"type": "null"}, {"$ref": "#/$defs/n"}]}}}}}
    nested = lambda k: '{"n":' * k + "null" + "}" * k
    rows = frame(spark, [(1, nested(3)), (2, nested(4)), (3, "[]"), (4, None), (5, ""), (6, '"x"'), (7, " " * 50 + nested(1))], "id int, raw string")
    got = rows.select("id", schemas.violation(F.try_parse_json("raw"), deep, max_depth=2).alias("v"))
    assert {r["id"]: r["v"] for r in got.filter("id < 4").collect()} == {1: None, 2: "$.n:oneOf", 3: "$:type"}
    flat = {"enum": ["x", 1, 2.5, True, None]}
    values = frame(spark, [(i, v) for i, v in enumerate(['"x"', "1", "1.0", "2.5", "true", "null", "false", '"1"', "{}", "[1]"])], "id int, raw string")
    kept = {r["id"] for r in schemas.checked(values, "id", "raw", flat).filter("state = 'valid'").collect()}
    assert kept == {0, 1, 3, 4, 5}
    assert {r["id"]: r["state"] for r in schemas.checked(rows, "id", "raw", flat, max_bytes=40).collect()} == {1: "broken", 2: "broken", 3: "broken", 4: "invalid", 5: "invalid", 6: "valid", 7: "too_large"}
    for bad in ({"$ref": "http://x"}, {"type": "object", "properties": {}}, {"const": [1]}):
        with pytest.raises(ValueError):
            rows.select(schemas.violation(F.try_parse_json("raw"), bad))


def test_outlines_of_any_depth(spark):
    entry = None
    for i in range(30, 0, -1):
        entry = {"title": f"t{i}", "page": i, "items": [entry] if entry else "none"}
    rows = frame(spark, [(1, json.dumps([entry, 5, {"page": 2, "items": []}])), (2, "{}"), (3, "no"), (4, "[]"), (5, None)], "book int, raw string")
    got = sorted(tuple(r) for r in outlines.flattened(rows, "book", "raw").collect())
    assert got == [(1, i, i, i - 1 if i else None, f"t{i + 1}", i + 1) for i in range(30)] + [(1, 30, 0, None, None, 2)]
