"""Odd inputs of the operators whose queries only see well-formed tables."""

import random

import pytest
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import assessment, graph, layout, matching, packages, provenance, records, sequences


def test_components_of_chains_stars_and_loners(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for e in edges for i in e] + [(500,)], "node long")
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long"), nodes).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {500: 500}
    assert graph.components(spark.createDataFrame([], "src long, dst long"), nodes.limit(0)).count() == 0


def test_boxes_meet_once_however_they_lie(spark):
    rng = random.Random(4)
    boxes = [(k % 3, k, x, y, x + rng.choice([0.5, 3, 40]), y + rng.choice([0.1, 7, 90])) for k in range(120) for x, y in [(rng.uniform(-50, 50), rng.uniform(-50, 50))]] + [(0, 999, 1.0, 1.0, 1.0, 1.0)]
    rows = spark.createDataFrame(boxes, "page int, id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in matching.meeting(rows, rows, ["page"]).filter("a.id < b.id").collect())
    meets = lambda a, b: a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    assert got == sorted((a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and meets(a, b))


@pytest.mark.parametrize("seed", range(3))
def test_sieve_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    boxes = [(0, k, x, 0.0, x + 10, 10.0) for k in range(60) for x in [rng.uniform(0, 60)]]
    rows = spark.createDataFrame(boxes, "page int, id long, x0 double, y0 double, x1 double, y1 double")
    iou = lambda a, b: max(0.0, 10 - abs(a[2] - b[2])) / (20 - max(0.0, 10 - abs(a[2] - b[2])))
    kept, expected = [], {}
    for b in boxes:
        first = next((k for k in kept if iou(k, b) >= 0.4), None)
        expected[b[1]] = (first or b)[1]
        kept += [] if first else [b]
    assert {r["id"]: r["kept_id"] for r in matching.deduplicate_boxes(rows, ["page"], least=0.4).collect()} == expected


def test_nested_json_of_any_form(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": null, "c": [true]}], "d": {}}'), (2, "broken {"), (3, None), (4, '"x"'), (5, '{"a":{"b":{"c":{"d":{"e":1}}}}}')], "key long, raw string")
    got = sorted((r["key"], r["path"], r["value"]) for r in packages.json_paths(rows, "key", "raw").collect())
    assert got == [(1, "a[0]", "1"), (1, "a[1].c[0]", "true"), (4, "", "x"), (5, "a.b.c.d", '{"e":1}')]


def test_tables_in_pages_and_pastes(spark):
    html = "<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td colspan=2>c</td></tr><tr></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "no table"), (3, None), (4, "<table></table>")], "id int, html string")
    got = sorted(tuple(r) for r in packages.html_grid(pages, "id", "html").collect())
    assert got == [(1, 0, 0, 3, 1, "a"), (1, 0, 1, 1, 1, "b"), (1, 1, 1, 1, 2, "c")]
    pastes = spark.createDataFrame([(1, 'a,"b ""q"""\r\n1,2'), (2, "a,b\n1"), (3, None), (4, ""), (5, 'a,"b')], "id int, raw string")
    assert sorted(tuple(r) for r in packages.delimited_cells(pastes, "id", "raw").collect()) == [(1, 0, 0, "a"), (1, 0, 1, 'b "q"'), (1, 1, 0, "1"), (1, 1, 1, "2")]


def test_budget_and_sample_of_one_large_key(spark):
    rows = spark.createDataFrame([(None if i % 2 else "k", i, 3 if i % 5 else None) for i in range(400)], "k string, i long, cost long")
    out = sequences.within_budget(rows, ["k"], ["i"], "cost", 10, "i").collect()
    assert len(out) == 400 and all(not r["taken"] for r in out if r["cost"] is None)
    for k in (None, "k"):
        assert sum(r["cost"] for r in out if r["k"] == k and r["taken"]) == 9
    got = sequences.even_sample(rows.select("k", "i"), ["k"], ["i"], 5).collect()
    assert sorted(r["nth"] for r in got if r["k"] == "k") == [0, 50, 100, 149, 199]
    assert sequences.even_sample(rows.select("k", "i").limit(0), ["k"], ["i"], 5).count() == 0


def test_two_reviewers_and_nulls(spark):
    left = spark.createDataFrame([(1, "a b", None), (2, None, "x")], "item int, title string, note string")
    right = spark.createDataFrame([(1, " a  b\r\n", "y"), (2, None, "X")], "item int, title string, note string")
    got = {(r["item"], r["field"]): r["state"] for r in provenance.field_disputes(left, right, "item", ["title", "note"]).collect()}
    assert got == {(1, "title"): "eliminated", (1, "note"): "substantive", (2, "title"): "same", (2, "note"): "substantive"}


def test_decimals_and_permissions_by_the_letter(spark):
    rows = spark.createDataFrame([("+1.50",), (".5",), ("1e2",), ("1e-3",), ("",), ("1.2.3",), ("NaN",), (None,), ("-0.0",)], "x string")
    assert [r[0] for r in rows.select(assessment.decimal_text(F.col("x"))).collect()] == ["1.5", "0.5", "100", "0.001", None, None, None, None, "0"]
    held = assessment.permitted(F.lit(None).cast("timestamp"), F.current_timestamp(), F.current_timestamp())
    assert spark.range(1).select(held).first()[0] is False


def test_texts_of_many_scripts(spark):
    rows = spark.createDataFrame([("Ｐlasma  Currentの磁場",), ("a-b c",), (None,), ("",)], "x string").select("x", T.wide_fold(F.col("x")).alias("f"))
    got = rows.select(T.surface_forms(F.col("f")), T.composite_tokens(F.col("f")), records.compact_map(F.col("x"))).collect()
    assert got[0][0] == ["plasmacurrent磁場"] and got[0][1] == ["plasma", "current", "磁場"]
    assert (got[1][2]["compact"], got[1][2]["pos"]) == ("abc", [0, 2, 4])
    assert got[3][0] == [] and got[3][1] == []


def test_lines_and_captions_of_one_page(spark):
    rows = [(1, 1, "图", 8.0, 0.0, 0.0, 8.0, 8.0), (1, 2, "2", 8.0, 9.0, 0.5, 17.0, 8.5), (1, 3, "Table", 8.0, 0.0, 20.0, 30.0, 28.0), (1, 4, "4-1", 8.0, 2.0, 32.0, 20.0, 40.0), (1, 5, "far", 8.0, 90.0, 32.0, 99.0, 40.0)]
    lines = layout.lines_of(spark.createDataFrame(rows, "page int, id int, text string, font double, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert [r["text"] for r in lines.orderBy("line").collect()] == ["图2", "Table", "4-1", "far"]
    assert [r["text"] for r in layout.merge_captions(lines, ["page"]).orderBy("line").collect()] == ["图2", "Table 4-1", "far"]
