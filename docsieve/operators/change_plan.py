"""What a change of a dependency graph invalidates: roots, causes, paths, actions, gates, reuse and violations.

Nodes are rows (node, kind, content, identity, evidence, protocol, inputs,
reviewers, capabilities, tag, required_receipts, receipts), edges (edge, src,
dst): src feeds dst, so what changes reaches along edges. Graphs have no cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators import graph
from docsieve.operators import packages as K

# Order of actions, actions and last gate of each kind of node, actions and gates that wait for a person.
ACTION_ORDER = ("re-extract", "rebuild", "re-review", "retest", "repackage", "reseal", "recertify", "recompose")
KIND_ACTIONS = {
    "source": "re-extract rebuild",
    "page": "re-extract rebuild",
    "segment": "re-extract rebuild",
    "parser": "re-extract rebuild",
    "model": "re-extract rebuild re-review recompose repackage",
    "config": "re-extract rebuild re-review recompose repackage",
    "render": "re-extract rebuild re-review recompose repackage",
    "locator": "re-extract rebuild re-review",
    "visual_object": "re-review rebuild",
    "visual_relation": "re-review rebuild",
    "table_grid": "re-review rebuild",
    "semantic_assertion": "re-review rebuild",
    "support": "re-review rebuild",
    "review_plan": "re-review rebuild",
    "review_session": "re-review rebuild",
    "review_attestation": "re-review rebuild",
    "composer": "recompose rebuild",
    "alignment_candidate": "recompose re-align re-review",
    "semantic_difference": "recompose re-review",
    "composer_conflict": "recompose re-review",
    "unit_map": "recompose re-review",
    "composer_review_plan": "re-review recompose",
    "composer_review": "re-review recompose",
    "composer_receipt": "rebuild recompose",
    "formula_ast": "re-review rebuild retest",
    "formula_test": "retest rebuild",
    "test": "retest rebuild",
    "competency": "retest rebuild",
    "runtime": "re-extract rebuild re-review recompose repackage",
    "runtime_qualification": "re-extract rebuild re-review recompose repackage",
    "runtime_result": "re-extract rebuild re-review recompose repackage",
    "worker": "re-extract rebuild re-review recompose repackage",
    "raster_crop": "re-extract rebuild re-review recompose repackage",
    "ocr_observation": "re-extract rebuild re-review recompose repackage",
    "ocr_transcript": "re-extract rebuild re-review recompose repackage",
    "scan_structure": "re-extract rebuild re-review recompose repackage",
    "scan_review": "re-review rebuild recompose repackage",
    "scan_transform": "re-extract rebuild re-review recompose repackage",
    "scan_backend_receipt": "re-extract rebuild re-review recompose repackage",
    "visual_candidate": "re-review rebuild recompose repackage",
    "visual_gap": "re-review rebuild recompose repackage",
    "visual_conflict": "re-review rebuild recompose repackage",
    "table_cell": "re-review rebuild",
    "review_overlay": "re-review rebuild repackage",
    "visual_policy": "rebuild re-review recompose repackage",
    "visual_census": "re-extract rebuild re-review recompose repackage",
    "visual_routing": "re-extract rebuild re-review recompose repackage",
    "visual_budget": "re-extract rebuild re-review recompose repackage",
    "visual_index": "rebuild re-review recompose repackage",
    "visual_coverage": "rebuild re-review recompose repackage",
    "visual_chart_candidate": "re-review rebuild recompose repackage",
    "visual_benchmark": "rebuild re-review repackage",
    "visual_gold": "re-review rebuild",
    "visual_mode_result": "re-extract rebuild re-review repackage",
    "visual_evaluation": "rebuild re-review",
    "cost_ledger": "rebuild",
    "seal": "reseal",
    "host_certificate": "recertify",
    "composite": "recompose",
    "module": "rebuild repackage",
    "package": "repackage",
    "artifact": "rebuild",
    "receipt": "rebuild",
    "unknown": "rebuild",
}
KIND_GATES = {
    "source": "source-identity",
    "page": "structure-resolution",
    "segment": "structure-resolution",
    "parser": "parser-contract",
    "model": "model-contract",
    "config": "configuration-contract",
    "render": "visual-review",
    "locator": "structure-resolution",
    "visual_object": "independent-visual-review",
    "visual_relation": "independent-visual-review",
    "table_grid": "independent-visual-review",
    "semantic_assertion": "independent-semantic-review",
    "support": "independent-semantic-review",
    "review_plan": "review-plan-freeze",
    "review_session": "independent-review",
    "review_attestation": "independent-review",
    "composer": "composer-boundary",
    "alignment_candidate": "independent-semantic-review",
    "semantic_difference": "independent-semantic-review",
    "composer_conflict": "independent-review",
    "unit_map": "independent-review",
    "composer_review_plan": "review-plan-freeze",
    "composer_review": "independent-review",
    "composer_receipt": "composer-boundary",
    "formula_ast": "formula-review-and-execution-gates",
    "formula_test": "independent-formula-test",
    "test": "competency",
    "competency": "competency",
    "runtime": "runtime-rebuild",
    "runtime_qualification": "runtime-qualification",
    "runtime_result": "runtime-rebuild",
    "worker": "runtime-rebuild",
    "raster_crop": "visual-review",
    "ocr_observation": "ocr-candidate",
    "ocr_transcript": "ocr-candidate",
    "scan_structure": "structure-resolution",
    "scan_review": "independent-review",
    "scan_transform": "visual-review",
    "scan_backend_receipt": "receipt-validation",
    "visual_candidate": "independent-visual-review",
    "visual_gap": "independent-visual-review",
    "visual_conflict": "independent-visual-review",
    "table_cell": "independent-visual-review",
    "review_overlay": "independent-visual-review",
    "visual_policy": "visual-policy-selection",
    "visual_census": "visual-census-routing",
    "visual_routing": "visual-census-routing",
    "visual_budget": "visual-budget",
    "visual_index": "independent-visual-review",
    "visual_coverage": "visual-budget",
    "visual_chart_candidate": "independent-visual-review",
    "visual_benchmark": "benchmark-orchestration",
    "visual_gold": "independent-review",
    "visual_mode_result": "runtime-rebuild",
    "visual_evaluation": "independent-review",
    "cost_ledger": "runtime-rebuild",
    "seal": "seal",
    "host_certificate": "host-certification",
    "composite": "composer-boundary",
    "module": "module-rebuild",
    "package": "package-integrity",
    "artifact": "artifact-rebuild",
    "receipt": "receipt-validation",
    "unknown": "unknown-node",
}
PAUSE_ACTIONS = ("re-review", "retest", "repackage", "reseal", "recertify", "recompose")
PAUSE_GATES = (
    "structure-resolution", "ocr-candidate", "visual-review", "independent-visual-review", "independent-semantic-review",
    "review-plan-freeze", "independent-review", "formula-review-and-execution-gates", "independent-formula-test",
    "competency", "seal", "host-certification", "composer-boundary", "execution", "signing",
)
# Reasons that aren't the kind followed by "_changed"; kinds without a reason of their own are artifacts.
REASONS = {"source": "source_identity_changed", "page": "page_text_or_structure_changed", "segment": "segment_structure_changed", "config": "configuration_changed", "locator": "heading_locator_changed", "test": "competency_test_changed"}
ARTIFACTS = (
    "worker", "raster_crop", "ocr_observation", "visual_candidate", "visual_gap", "table_cell", "review_overlay", "visual_policy", "visual_census",
    "visual_routing", "visual_budget", "visual_index", "visual_coverage", "visual_chart_candidate", "visual_conflict", "artifact", "receipt", "unknown",
)
FIELDS = ("kind", "content", "identity", "evidence", "protocol", "inputs", "reviewers", "capabilities", "tag")


def _looked_up(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), key), F.lit(default))


def required_actions(kind: Column) -> Column:
    """The actions of a kind of node, in ACTION_ORDER; what isn't in that order isn't asked for."""
    asked = F.split(_looked_up(KIND_ACTIONS, kind, "rebuild"), " ")
    return F.filter(F.array(*map(F.lit, ACTION_ORDER)), lambda a: F.array_contains(asked, a))


def change_reason(kind: Column) -> Column:
    """Why a node of a kind that is there before and after counts as changed."""
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in REASONS.items() for x in p)), kind), F.concat(kind, F.lit("_changed")))
    return F.when(kind.isin(*(k for k in KIND_ACTIONS if k not in ARTIFACTS)), own).otherwise("artifact_changed")


def node_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, o, n, change): each node's fields before and after, and whether it was added, removed, changed or unchanged.

    A node counts as changed if its content, protocol, inputs, number of
    reviewers or capabilities differ. A null is a value like any other.
    """
    both = old.select("node", F.struct(*FIELDS).alias("o")).join(new.select("node", F.struct(*FIELDS, "required_receipts", "receipts").alias("n")), "node", "full_outer")
    same = F.lit(True)
    for f in ("content", "protocol", "inputs", "reviewers"):
        same &= F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    entries = lambda s: F.array_sort(F.map_entries(F.col(f"{s}.capabilities")))
    same &= entries("o").eqNullSafe(entries("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.withColumn("change", change)


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(edge, src, dst, change): edges that were added, removed or unchanged, by their ids."""
    side = lambda df, s: df.select("edge", F.struct("src", "dst").alias(s)).dropDuplicates(["edge"])
    both = side(old, "o").join(side(new, "n"), "edge", "full_outer")
    end = F.coalesce("n", "o")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged")
    return both.select("edge", end["src"].alias("src"), end["dst"].alias("dst"), change.alias("change"))


def roots(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kind, change, reason): nodes from which a change spreads: those that differ, and both ends of edges that do.

    ``states`` and ``edges`` are what :func:`node_states` and :func:`edge_changes` give.
    """
    touched = edges.filter("change <> 'unchanged'")
    ends = touched.select(F.col("src").alias("node")).unionByName(touched.select(F.col("dst").alias("node"))).distinct().withColumn("end", F.lit(True))
    found = states.join(ends, "node", "left").filter("change <> 'unchanged' OR end")
    field = lambda f: F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}"))
    kind, tag = F.coalesce(field("kind"), F.lit("unknown")), F.when(F.col("n").isNull(), F.col("o.tag")).otherwise(F.col("n.tag"))
    reason = (
        F.when(F.col("change") == "unchanged", "typed_edge_changed").when(tag != "", tag).when(F.col("change") == "added", "node_added")
        .when(F.col("change") == "removed", "node_deleted").otherwise(change_reason(kind))
    )
    return found.select("node", kind.alias("kind"), F.when(F.col("change") == "unchanged", "changed").otherwise(F.col("change")).alias("change"), reason.alias("reason"))


def violations(states: DataFrame, found: DataFrame) -> DataFrame:
    """(node, code, detail, reason): what must stop a build: a source or receipt that is gone, an id that means something
    else now, another protocol, fewer reviewers, a capability that was denied, receipts that are asked for and missing."""
    s = states.join(found.select("node", "reason").hint("merge"), "node", "left")
    text = F.lit("")
    same = lambda f: F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    row = lambda when, code, detail=text: F.when(when, F.array(F.struct(F.lit(code).alias("code"), detail.alias("detail"))))
    raised = F.filter(F.map_keys("n.capabilities"), lambda c: F.element_at("n.capabilities", c) & ~F.element_at("o.capabilities", c))
    missing = F.array_sort(F.array_except("n.required_receipts", F.coalesce("n.receipts", F.array().cast("array<string>"))))
    rows = [
        row(F.col("n").isNull() & F.col("o.kind").isin("source", "receipt"), "original_node_missing"),
        row(both & ~same("identity"), "stable_id_semantic_drift"),
        row(both & ~same("evidence"), "stable_id_evidence_drift"),
        row(both & ~same("protocol"), "protocol_identity_changed"),
        row(both & (F.col("n.reviewers") < F.col("o.reviewers")), "reviewer_requirement_narrowed"),
        F.when(both, F.transform(raised, lambda c: F.struct(F.lit("capability_escalation").alias("code"), c.alias("detail")))),
    ]
    none = F.array().cast("array<struct<code:string,detail:string>>")
    of_roots = F.when(F.col("reason").isNotNull(), F.concat(*(F.coalesce(r, none) for r in rows)))
    every = F.concat(F.coalesce(of_roots, none), F.coalesce(row(F.size(missing) > 0, "required_receipt_missing", F.array_join(missing, ",")), none))
    return s.select("node", "reason", F.inline(every)).select("node", "code", "detail", F.when(F.col("code") != "required_receipt_missing", F.col("reason")).alias("reason"))


def causes(found: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(node, root, reason, hops): every root that reaches a node along the new edges, and removed ones along the old edges too.

    One row for each pair, never an array: a node that gathers a whole graph may
    have as many causes as there are roots. Every hop joins only the pairs that
    are new, as many hops as the longest shortest way has.
    """
    now = graph.reach(new_edges, found.select("node")).withColumnRenamed("seed", "root").join(found.select(F.col("node").alias("root"), "reason"), "root")
    gone = graph.reach(old_edges, found.filter("change = 'removed'").select("node")).withColumnRenamed("seed", "root").withColumn("reason", F.lit("node_deleted"))
    return now.unionByName(gone).groupBy("node", "root", "reason").agg(F.min("hops").alias("hops"))


def invalidations(states: DataFrame, found: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(node, kind, hops, required_actions, final_action, final_gate) of every node that a root reaches, the roots at hop 0.

    Nodes alone go along, not pairs, so the work follows the edges. The actions
    are those of the node's kind; of both kinds where it has another one now and
    a removed root reaches it as well.
    """
    now = graph.downstream(new_edges, found.select("node"))
    gone = graph.downstream(old_edges, found.filter("change = 'removed'").select("node"))
    hit = now.select("node", "hops", F.lit(True).alias("now"), F.lit(False).alias("gone")).unionByName(gone.select("node", "hops", F.lit(False).alias("now"), F.lit(True).alias("gone")))
    hit = hit.groupBy("node").agg(F.min("hops").alias("hops"), F.bool_or("now").alias("now"), F.bool_or("gone").alias("gone"))
    # all nodes: by the size of their files Spark would take them for small and send them through the driver
    rows = hit.join(states.select("node", F.col("o.kind").alias("o"), F.col("n.kind").alias("n")).hint("merge"), "node")
    of = lambda there, kind: F.when(there, required_actions(F.coalesce(kind, F.lit("unknown")))).otherwise(F.array().cast("array<string>"))
    first = F.coalesce(F.when(F.col("now"), F.coalesce("n", "o")).otherwise(F.col("o")), F.lit("unknown"))
    asked = F.concat(of(F.col("now"), F.coalesce("n", "o")), of(F.col("gone"), F.col("o")))
    actions = F.filter(F.array(*map(F.lit, ACTION_ORDER)), lambda a: F.array_contains(asked, a))
    return rows.select(
        "node",
        first.alias("kind"),
        "hops",
        actions.alias("required_actions"),
        F.coalesce(F.try_element_at(actions, F.lit(-1)), F.lit("rebuild")).alias("final_action"),
        _looked_up(KIND_GATES, first, "unknown-node").alias("final_gate"),
    )


def cause_paths(found: DataFrame, edges: DataFrame, *, most: int = K.MAX_PATHS) -> DataFrame:
    """(node, nth, path): ways from a root to a node as ``a>b>c``, shortest first, ``most`` for each node; see :func:`graph.shortest_paths`."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = graph.shortest_paths(back, found.select("node"), most=most)
    return ways.select("node", "nth", F.array_join(F.reverse("path"), ">").alias("path"))


def reuse(states: DataFrame, invalid: DataFrame, broken: DataFrame) -> DataFrame:
    """(node, eligible, reason_codes) of every node that is there now: whether what was built of it may be taken again."""
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    receipts = broken.filter("code = 'required_receipt_missing'")
    rows = states.filter("n IS NOT NULL").join(flag(invalid, "hit"), "node", "left").join(flag(broken.filter("code <> 'required_receipt_missing'"), "unsafe"), "node", "left").join(flag(receipts, "short"), "node", "left")
    codes = F.array_compact(F.array(F.when(F.col("hit"), "dependency_invalidated"), F.when(F.col("unsafe"), "fail_closed_identity_or_policy"), F.when(F.col("change") != "unchanged", "node_changed"), F.when(F.col("short"), "required_receipt_missing")))
    none = F.size(codes) == 0
    return rows.select("node", none.alias("eligible"), F.when(none, F.array(F.lit("inputs_protocol_dependencies_unchanged"))).otherwise(codes).alias("reason_codes"))


def action_plan(invalid: DataFrame) -> DataFrame:
    """(place, action, n_nodes, gates, execution): what has to be done, in order; paused where an action or a gate waits for a person."""
    rows = invalid.select("final_gate", F.explode("required_actions").alias("action")).groupBy("action").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_set("final_gate")).alias("gates"))
    waits = F.col("action").isin(*PAUSE_ACTIONS) | F.arrays_overlap("gates", F.array(*map(F.lit, PAUSE_GATES)))
    place = F.array_position(F.array(*map(F.lit, ACTION_ORDER)), F.col("action")).cast("int")
    return rows.select(place.alias("place"), "action", "n_nodes", "gates", F.when(waits, "paused").otherwise("allowed-local-deterministic").alias("execution"))


def compare(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> dict[str, DataFrame]:
    """All tables of a comparison by name. What several of them read is written out once.

    Graphs with cycles, repeated nodes or edges without ends are for
    ``packages.graph_issues`` to tell; here a node that repeats counts once for
    each pair of its rows. Empty graphs give empty tables.
    """
    states = graph.cut(node_states(old_nodes, new_nodes))
    changed = edge_changes(old_edges, new_edges)
    found = graph.cut(roots(states, changed))
    invalid = graph.cut(invalidations(states, found, old_edges, new_edges))
    broken = violations(states, found)
    return {
        "nodes": states.select("node", "change"),
        "edges": changed,
        "roots": found,
        "invalidations": invalid,
        "causes": causes(found, old_edges, new_edges),
        "paths": cause_paths(found, new_edges),
        "violations": broken,
        "reuse": reuse(states, invalid, broken),
        "actions": action_plan(invalid),
    }
