"""Operators on small hand-made tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import predicates, text, units
from docsieve.operators import alignment, changes, composition, graph, matching, planning, retrieval, sequences
from docsieve.plans import queries
from docsieve.sources import records
from docsieve.streaming import incremental


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_floor_ties_and_limit(spark):
    scored = spark.createDataFrame([(1, 5, 100), (1, 4, 100), (1, 6, 30), (1, 7, 29), (2, 1, 11), (3, 1, 12)], "query_id int, entry_id int, score int")
    assert values(retrieval.top_hits(scored, 3)) == [(1, 4, 100, 1), (1, 5, 100, 2), (1, 6, 30, 3), (3, 1, 12, 1)]
    assert values(retrieval.top_hits(scored, 1)) == [(1, 4, 100, 1), (3, 1, 12, 1)]


def test_stopwords_alone_find_nothing(spark):
    entries = spark.createDataFrame([(1, "the heat flux"), (2, None)], "id int, title string")
    posted = retrieval.postings(entries, "id", {"title": 12})
    asked = spark.createDataFrame([(1, "is it the"), (2, "Heat flux of steel")], "q int, text string")
    assert values(retrieval.scores(asked, posted, query_id="q", prompt="text")) == [(2, 1, 24)]
    titles = entries.select(F.col("id").alias("entry_id"), F.lit("heat flux").alias("title"))
    assert values(retrieval.scores(asked, posted, query_id="q", prompt="text", titles=titles)) == [(2, 1, 104)]
    assert values(retrieval.weighted_terms(posted).select("entry_id", F.map_keys("weighted_terms").alias("k"))) == [(1, ["flux", "heat"])]


def test_named_entries_need_no_common_term(spark):
    entries = spark.createDataFrame([("K-17", "heat flux"), ("K-18", "the is"), ("Ä9", None)], "id string, title string")
    posted = retrieval.postings(entries, "id", {"title": 12})
    names = lambda c: entries.selectExpr("id AS entry_id", f"{c} AS name")
    asked = spark.createDataFrame([(1, "see k-17, please"), (2, "Heat flux of ä9"), (3, "what The\n{IS}"), (4, "no"), (5, None)], "q int, text string")
    found = retrieval.catalog_scores(asked, posted, ids=names("id"), titles=names("title"), query_id="q", prompt="text")
    assert values(found, "query_id", "entry_id", "score") == [(1, "K-17", 1000), (2, "K-17", 104), (2, "Ä9", 1000), (3, "K-18", 80)]


def test_verbatim_copies_in_other_scripts(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    russian, accented = " ".join(f"слово{chr(0x430 + i)}" for i in range(25)), " ".join(f"Größe-{chr(97 + i)} l'été{chr(97 + i)}" for i in range(11))
    sources = spark.createDataFrame([(1, han), (2, russian.upper()), (3, accented), (4, None)], "s int, text string")
    spaced = "序" + "、\n".join(han[5:30]) + "。end"
    texts = [(1, spaced), (2, han[:23]), (3, "так: " + russian[: russian.rindex(" ")]), (4, " ".join(russian.split()[:20])), (5, accented.upper()), (6, None), (7, "")]
    outputs = spark.createDataFrame(texts, "o int, text string")
    found = retrieval.verbatim_copies(sources, outputs, source_id="s", output_id="o")
    assert values(found, "output_id", "n_windows", "first_source") == [(1, 2, 1), (3, 4, 2), (5, 2, 3)]


def test_verbatim_copies_query_takes_texts_as_they_are(spark, tmp_path):
    words = " ".join(f"straße{chr(97 + i)}" for i in range(22))
    wide, odd = "".join(chr(0xFF76 + i % 10) for i in range(30)), "".join(chr(0xE000 + i) for i in range(30))
    spark.createDataFrame([(1, words), (2, wide), (3, odd), (4, None)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, words.replace("ß", "ss")), (2, words.replace("ß", "\u1e9e").upper()), (3, words.upper()), (4, wide), (5, odd), (6, words.replace("s", "\u0130")), (7, None)]
    spark.createDataFrame(texts, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = values(queries.verbatim_copies(spark, str(tmp_path)), "output_id", "n_windows", "first_source")
    assert found == sorted(db.execute(queries.ORACLES["verbatim_copies"]).fetchall()) == [(2, 2, 1), (5, 7, 3)]


def test_equal_query_texts_are_scored_once_and_all_answered(spark):
    asked = spark.createDataFrame([(i, "asia china") for i in range(50)] + [(99, "asia japan"), (100, "mars")], "q int, place string")
    entries = spark.createDataFrame([(1, "asia japan"), (2, "asia china"), (3, "asia china")], "e int, place string")
    found = values(retrieval.overlap_search_by_text(asked, entries, query_id="q", entry_id="e", text="place", tokens=F.split("place", " "), limit=2))
    assert found == sorted([(i, e, 2, e - 1) for i in range(50) for e in (2, 3)] + [(99, 1, 2, 1), (99, 2, 1, 2)], key=repr)


def test_cycles_roots_and_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("y", "z")], "src string, dst string")
    assert values(graph.cyclic_nodes(edges)) == [("a",), ("b",)]
    seeds = spark.createDataFrame([("x",)], "node string")
    assert values(graph.reach(edges, seeds, 1)) == [("x", "x", 0), ("x", "y", 1)]
    assert values(graph.affected(edges, spark.createDataFrame([("z",), ("y",)], "node string"), 5)) == [("x", 1, 2), ("y", 1, 1)]
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(100, 101), (101, 100)], "node int, parent int")
    assert values(graph.roots(parents)) == sorted([(i, 0, i) for i in range(20)] + [(100, None, None), (101, None, None)], key=repr)
    assert values(graph.adjacency(edges)) == [("a", ["b"]), ("b", ["a", "c"]), ("x", ["y"]), ("y", ["z"])]


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, body string")
    more = spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "id int, body string")
    assert values(changes.insert_only(base, more, "id")) == [(1, "a", "kept"), (2, "b", "same"), (3, None, "collision"), (4, "d", "added")]
    rows = spark.createDataFrame([(1, 1, 5), (1, 6, 9), (1, 11, 12), (2, 3, 1)], "k int, a int, b int")
    assert values(changes.merge_intervals(rows, ["k"], "a", "b")) == [(1, 1, 9, 2), (1, 11, 12, 1), (2, 3, 1, 1)]
    assert values(changes.repeated_keys(rows, "k")) == [(1, 3)]


def test_even_sample_rounds_half_up(spark):
    rows = spark.range(30).select(F.lit(1).alias("k"), "id")
    for target in (2, 5, 12, 29, 30, 40):
        expected = sorted({int(np.floor(i * 29 / (target - 1) + 0.5)) for i in range(target)}) if target < 30 else list(range(30))
        assert sorted(r[0] for r in values(sequences.even_sample(rows, ["k"], ["id"], target), "id")) == expected


def test_budget_lets_smaller_rows_pass(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 4), (1, 4, 2)], "k int, nth int, cost int")
    assert values(sequences.within_budget(rows, ["k"], ["nth"], "cost", 10, "nth"), "item", "spent", "taken") == [(1, 5, True), (2, 5, False), (3, 9, True), (4, 9, False)]


def test_interpolation_stays_inside(spark):
    curve = spark.createDataFrame([("c", 0.0, 0.0), ("c", 10.0, 100.0)], "k string, x double, y double")
    asked = spark.createDataFrame([("c", x) for x in (-1.0, 0.0, 2.5, 10.0, 11.0)] + [("d", 1.0)], "k string, x double")
    assert values(sequences.interpolate(curve, asked, "k")) == [("c", 0.0, 0.0), ("c", 10.0, 100.0), ("c", 2.5, 25.0)]


def plain_match(gold, predicted, least):
    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(w, 0) * max(h, 0)
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)

    pairs = sorted(((-iou(g, p), g[0], p[0]) for g in gold for p in predicted if iou(g, p) > 0))
    used_g, used_p, out = set(), set(), []
    for v, g, p in pairs:
        if g not in used_g and p not in used_p:
            used_g.add(g)
            used_p.add(p)
            out.append((g, p, round(-v, 9), -v >= least))
    return out + [(g[0], None, None, False) for g in gold if g[0] not in used_g] + [(None, p[0], None, False) for p in predicted if p[0] not in used_p]


def test_greedy_matching(spark):
    rng = np.random.default_rng(2)
    made = lambda n: [(i, *map(float, xy), *map(float, xy + rng.integers(2, 9, 2))) for i, xy in enumerate(rng.integers(0, 20, (n, 2)))]
    gold, predicted = made(25), made(30)
    schema = "id long, x0 double, y0 double, x1 double, y1 double"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("page", F.lit(1))
    got = matching.match(frame(predicted), frame(gold), ["page"]).collect()
    assert sorted(((r["gold_id"], r["predicted_id"], None if r["iou"] is None else round(r["iou"], 9), r["matched"]) for r in got), key=repr) == sorted(plain_match(gold, predicted, 0.5), key=repr)
    alone = matching.match(frame(predicted).limit(0), frame(gold), ["page"])
    assert alone.count() == 25 and alone.filter("matched").count() == 0
    kept = {r["id"]: r["kept_id"] for r in matching.deduplicate_boxes(frame(gold + [(100, *gold[3][1:])]), ["page"]).collect()}
    assert kept[100] == kept[3] == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("Ｆｌｕｘ  ﬁ x", " Fig. ", "热传导", "p\n\n 12 \n")], "a string, b string, c string, d string")
    row = df.select(text.canonical_text(F.col("a")), text.is_caption_prefix(F.col("b")), text.char_ngrams(F.col("c"), 2), text.printed_page_label(F.col("d"))).first()
    assert tuple(row) == ("Flux fi x", True, ["热传", "传导"], "12")
    other = spark.createDataFrame([("fig. 3", "- iv -", "\n\t a b \n")], "a string, b string, c string")
    assert tuple(other.select(text.is_caption_prefix(F.col("a")), text.printed_page_label(F.col("b")), text.metric_text(F.col("c"))).first()) == (False, None, "a b")
    math = spark.createDataFrame([(r"\vec{B} and B' = x_{ij} \times α₀, word", "ab_c of 磁场 the d", "café")], "a string, b string, c string")
    got = math.select(text.math_tokens(F.col("a")), text.terms(F.col("b")), text.terms(F.col("c"))).first()
    assert got[0] == sorted(["\\vec{B}", "B'", "x_{ij}", "\\times", "α₀"]) and got[1] == ["ab_c", "磁场"] and got[2] == ["caf"]
    words = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    assert words.select(text.edit_distance_words(F.col("a"), F.col("b"))).first()[0] == 2
    js = spark.createDataFrame([('{"b":1,"a":null}',), ('{"a":NaN}',), (None,)], "j string").select(text.canonical_json(F.col("j"))).collect()
    assert [r[0] for r in js] == ['{"a":null,"b":1}', None, None]


def test_units_and_formulas(spark):
    assert units.unit_factor("kJ", "N*m") == 1000.0 and units.unit_factor("kJ", "W") is None
    assert units.dimension(["sqrt", ["divide", ["symbol", "e"], ["symbol", "m"]]], {"e": "J", "m": "kg"})[:3] == (1, 0, -1)
    with pytest.raises(ValueError):
        units.dimension(["add", ["symbol", "e"], ["symbol", "m"]], {"e": "J", "m": "kg"})
    df = spark.createDataFrame([("1", "3"), ("1", "0"), (None, "2")], "a string, b string")
    exact = [r[0] for r in df.select(units.evaluate_exactly(["divide", ["symbol", "a"], ["symbol", "b"]], a=F.col("a"), b=F.col("b"))).collect()]
    assert exact == ["0." + "3" * 50, None, None]


def test_conditions_are_kleene(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, None), (True, True)], "a boolean, b boolean")
    both = predicates.outcome(predicates.compile_predicate(["all", ["eq", "a", True], ["eq", "b", True]], {"a": F.col("a"), "b": F.col("b")}))
    assert [r[0] for r in df.select(both).collect()] == ["unknown", "violated", "unknown", "satisfied"]


def test_version_ranges(spark):
    cases = [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", ">=1.0.0 <2.0.0", True), ("1.0", "*", False), ("9.9.9", "*", True)]
    df = spark.createDataFrame(cases, "v string, r string, e boolean")
    assert df.filter(text.satisfies(F.col("v"), F.col("r")) != F.col("e")).count() == 0


def test_strict_reader_inventory_and_create_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert values(records.read_jsonl(spark, str(tmp_path / "in"), schema)) == [(1,), (2,)]
    (tmp_path / "in/b.jsonl").write_text('{"id": "x"\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "in"), schema).collect()
    assert records.read_jsonl(spark, str(tmp_path / "in"), schema, strict=False).filter("_corrupt is not null").select("id", "_corrupt").collect()[0][1] == '{"id": "x"'
    assert records.inventory(spark, str(tmp_path / "in")).count() == 2
    records.write_new(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception):
        records.write_new(spark.range(3), str(tmp_path / "out"))


def test_ragged_pastes_give_no_cells(spark):
    df = spark.createDataFrame([(1, "a\tb\nc"), (2, "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |")], "k int, raw string")
    assert values(records.pasted_cells(df, "k", "raw")) == [(2, 0, 0, "a|b"), (2, 0, 1, "c"), (2, 1, 0, "1"), (2, 1, 1, "2")]


def test_routing_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pages = spark.createDataFrame([(1, "<p></p>"), (2, "<b>few words</b>"), (3, "long enough text " * 5)], "page_id long, html string")
    for batch in (pages, pages.selectExpr("page_id + 10 as page_id", "html")):
        batch.write.mode("append").parquet(source)
        incremental.write_routes(incremental.page_stream(spark, source, pages.schema), out, state).awaitTermination()
    assert values(spark.read.parquet(out), "page_id", "route") == [(1, "ocr"), (11, "ocr"), (12, "review"), (13, "native"), (2, "review"), (3, "native")]


def test_resume(spark):
    regions = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "region int, binding string")
    state = spark.createDataFrame([(1, "h1", "complete"), (2, "old", "complete"), (3, "h3", "failed")], "region int, binding string, status string")
    assert values(incremental.pending(regions, state, "region", "binding")) == [(2, "h2"), (3, "h3")]
    assert values(incremental.stale(state, regions, "region", "binding"), "region") == [(2,)]
    actions = spark.createDataFrame([("j", 1, "scan", "complete"), ("j", 3, "seal", "open"), ("j", 2, "review", "open"), ("k", 1, "scan", "complete")], "job string, action_order int, action string, status string")
    assert values(incremental.next_action(actions, "job")) == [("j", "review"), ("k", None)]


def test_candidates_by_terms_groups_and_statement(spark):
    kind = "ref int, terms array<string>, groups array<string>"
    left = spark.createDataFrame([(1, ["a", "b", "c"], None), (2, ["x"], ["g"]), (3, None, None), (4, [], [])], kind)
    right = spark.createDataFrame([(1, ["a", "b", "d"], None), (2, ["c"], []), (3, ["y"], ["g"]), (4, ["z"], None)], kind)
    explicit = spark.createDataFrame([(4, 4, "equivalent")], "left_ref int, right_ref int, relation string")
    found = alignment.candidates(left, right, least=0.5, explicit=explicit)
    assert values(found) == [(1, 1, ["a", "b"], [], 0.5, "related_candidate"), (2, 3, [], ["g"], 0.0, "related_candidate"), (4, 4, [], [], 0.0, "equivalent_candidate")]
    assert values(alignment.candidates(left, right), "left_ref", "right_ref") == [(1, 1), (1, 2), (2, 3)]
    assert values(alignment.candidates(left.limit(0), right)) == []


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5, 1.0])
def test_candidates_equal_all_pairs(spark, least):
    rng = np.random.default_rng(5)
    sides = [[(i, sorted({f"t{int(x)}" for x in rng.integers(0, 12, rng.integers(1, 7))})) for i in range(40)] for _ in "lr"]
    left, right = (spark.createDataFrame([(i, t, []) for i, t in s], "ref int, terms array<string>, groups array<string>") for s in sides)
    score = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
    want = sorted((i, j) for i, a in sides[0] for j, b in sides[1] if score(a, b) > 0 and score(a, b) >= least)
    assert sorted(values(alignment.candidates(left, right, least=least), "left_ref", "right_ref")) == want


def test_shared_concepts_keep_contained_groups_and_stated(spark, tmp_path):
    long = "heat flux " + " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, "heat flux"), (2, "alone")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, "other"), (5, long), (98, "none"), (3, "else")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert values(queries.aligned_concepts(spark, str(tmp_path))) == []
    assert values(queries.shared_concepts(spark, str(tmp_path)), "left_ref", "right_ref", "shared", "n_groups", "relation") == [
        (1, 5, 2, 0, "related_candidate"), (1, 98, 0, 1, "related_candidate"), (2, 2, 0, 1, "equivalent_candidate")
    ]


def test_counted_pairs_equal_candidates(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 7)
    monkeypatch.setattr(alignment, "PART_ROWS", 11)
    rng = np.random.default_rng(8)
    some = lambda n, most: sorted({f"ü{int(x)}" for x in rng.integers(0, n, rng.integers(0, most))})
    sides = [[(i if s == "l" else f"r{i}", some(40, 7) if i % 10 else None, some(30, 3)) for i in range(40)] for s in "lr"]
    left, right = (spark.createDataFrame(s, f"ref {kind}, terms array<string>, groups array<string>") for s, kind in zip(sides, ("int", "string"), strict=True))
    stated = spark.createDataFrame([(i, f"r{i % 9}", "equivalent") for i in range(0, 40, 3)] + [(77, "r1", "equivalent")], "left_ref int, right_ref string, relation string")
    want = alignment.candidates(left, right, explicit=stated).select("left_ref", "right_ref", F.size("shared_terms").alias("shared"), F.size("shared_groups").alias("n_groups"), "score", "relation")
    want, found = values(want), alignment.counted(left, right, explicit=stated)
    assert 100 < len(want) < 1500 and values(found) == want
    assert found.columns == ["left_ref", "right_ref", "shared", "n_groups", "score", "relation"]


def test_differences_and_unit_maps(spark):
    kind = "ref int, d string, s array<string>, units array<struct<name:string,dimension:string,scale:double>>"
    left = spark.createDataFrame([(1, "x", ["p", "q"], [("m", "length", 1.0), ("kg", "mass", 1.0)]), (2, None, None, None)], kind)
    right = spark.createDataFrame([(1, "y", ["q", "p"], [("km", "length", 1000.0)]), (2, "z", None, [])], kind)
    pairs = spark.createDataFrame([(1, 1), (2, 2)], "left_ref int, right_ref int")
    found = alignment.differences(pairs, left, right, {"definition": "d", "symbol": "s"})
    assert values(found, "left_ref", "kind", "conflict") == [(1, "definition", False), (2, "definition", False)]
    assert values(alignment.unit_maps(pairs, left, right)) == [(1, 1, "kg", "km", "dimension", None), (1, 1, "m", "km", "unit", 0.001)]


def test_headings_are_located(spark):
    pages = [
        (1, 1, "Contents\nHeat Flux 2\nMass 9"), (1, 2, "2 Heat Flux\nplain words on heat\nmore"), (1, 3, "HEAT-\nFLUX\nand a line on heat flux here"),
        (1, 4, None), (1, 5, "one\nsteady  state\nmiddle\nsteady state\nlast"), (2, 1, "a\nb\nthe ﬂow rate\nin it\nx\ny"),
    ]
    pages = spark.createDataFrame(pages, "book int, page int, text string")
    segments = spark.createDataFrame([(1, 1, "Heat Flux", 2), (1, 2, "Steady state", 5), (1, 3, "nowhere", 3), (2, 1, "flow rate", 1), (2, 2, None, 1), (2, 3, "- ", 1)], "book int, segment int, title string, first_page int")
    found = planning.heading_candidates(pages, segments)
    assert values(found.filter("book = 1 AND segment = 1"), "page", "line", "boundary", "role", "method", "score") == [
        (1, 1, "exact-line", "body-heading", "normalized-exact", 161),
        (2, 0, "exact-line", "body-heading", "normalized-exact", 169),
        (3, 0, "exact-line", "body-heading", "dehyphenated-line-match", 153),
        (3, 2, "substring", "body-text", "unicode-ligature-equivalent", 56),
    ]
    assert values(found.filter("book = 2"), "line", "at", "boundary", "method") == [(2, 5, "line-boundary", "unicode-ligature-equivalent")]
    assert values(planning.resolve_headings(segments, found)) == [
        (1, 1, "resolution-required", "ambiguous", None, None, 8), (1, 2, "resolution-required", "ambiguous", None, None, 4), (1, 3, "resolution-required", "missing", None, None, None),
        (2, 1, "resolved", "unique", 1, 2, None), (2, 2, "resolution-required", "missing", None, None, None), (2, 3, "resolution-required", "missing", None, None, None),
    ]
    assert values(planning.heading_candidates(pages.limit(0), segments)) == []


def test_heading_places_equal_a_plain_search(spark, sf):
    from docsieve.plans import queries as plans

    pages, segments = plans._book(spark, sf)
    dense = lambda t: "".join(c for c in (t or "").casefold() if not c.isspace() and c != "-")
    texts = {(r.book, r.page): dense(r.text) for r in pages.collect()}
    want = []
    for s in segments.collect():
        for page in range(s.first_page - 1, s.first_page + 3):
            whole, title, at = texts.get((s.book, page), ""), dense(s.title), -1
            while title and (at := whole.find(title, at + len(title) if at >= 0 else 0)) >= 0:
                want.append((s.book, s.segment, page, at))
    assert sorted(want) == sorted(values(planning.heading_candidates(pages, segments), "book", "segment", "page", "at"))


def test_book_plan(spark):
    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate(["cover page", "long enough text", "", "see figure below", "after all text", "preface of more"], 1)] + [(2, 1, "no segments at all")], "book int, page int, text string")
    kind = "book int, segment string, parent string, title string, first_page int, last_page int"
    segments = spark.createDataFrame([(1, "a", None, "Heat", 2, 3), (1, "b", "a", "Index", 2, 2), (1, "c", "lost", "Flow", 4, 4)], kind)
    figure = F.contains("text", F.lit("figure"))
    plan = planning.page_plan(pages, segments, least_chars=5, visual=figure)
    assert [r[2] for r in values(plan)] == ["context-only", "compile", "ocr-candidate", "visual-review", "gap", "context-only", "context-only"]
    resolved = spark.createDataFrame([(1, s, "resolved") for s in "abc"], "book int, segment string, status string")
    assert [r[2:] for r in values(planning.segment_plan(pages, segments, resolved, least_chars=5, visual=figure))] == [("ocr-candidate", "candidate-only"), ("non-knowledge", "not-started"), ("visual-review", "candidate-only")]
    assert {r[2] for r in values(planning.segment_plan(pages, segments, resolved.limit(0), least_chars=5, visual=figure))} == {"ocr-candidate", "gap"}
    assert values(planning.modules(pages, segments, chunk=2)) == [(1, "a", 2, 3, 2, 2), (1, "c", 4, 4, 1, 1), (1, "context-0001", 1, 5, 2, 0), (1, "context-0002", 6, 6, 1, 0), (2, "context-0001", 1, 1, 1, 0)]


def test_dependency_issues(spark):
    modules = spark.createDataFrame([("a", "1.2.3"), ("b", "2.0.0"), ("c", "bad"), ("d", None)], "module string, version string")
    wants = [("a", "b", "^2.0.0"), ("b", "a", "~1.3.0"), ("c", "a", "*"), ("a", "lost", "*"), ("a", "d", "*"), ("ghost", "a", "*"), ("c", "b", None)]
    found = composition.dependency_issues(modules, spark.createDataFrame(wants, "module string, dependency string, wanted string"))
    assert values(found) == sorted([("a", "d", "mismatch"), ("a", "lost", "unresolved"), ("a", None, "cycle"), ("b", "a", "mismatch"), ("b", None, "cycle"), ("c", "b", "mismatch"), ("c", None, "invalid-version"), ("d", None, "invalid-version")], key=repr)


def test_contested_sources(spark):
    kind = "source string, package string, first_page int, last_page int"
    claims = [("s", "p", 1, 5), ("s", "p", 4, 9), ("s", "q", 9, 12), ("s", "r", 13, 20), ("t", "p", 1, 2), ("t", "p", 1, 2), ("u", "p", None, None), ("u", "q", 3, 3), (None, "p", 1, 1), ("s", None, 1, 99)]
    found = composition.contested_sources(spark.createDataFrame(claims, kind))
    assert values(found) == [("s", "p", 1, 9), ("s", "q", 9, 12), ("u", "p", None, None), ("u", "q", 3, 3)]
    assert values(composition.contested_sources(spark.createDataFrame([], kind))) == []


def test_depths_have_no_bound(spark):
    from docsieve.operators import layout, sequences

    chain = [(1, i, i) for i in range(40)] + [(1, 40, 17), (1, 41, 0), (2, 1, None), (2, 2, 5), (2, 3, 5)]
    rows = spark.createDataFrame(chain, "book int, node int, depth int").repartition(3)
    up = {(r["book"], r["node"]): r["up"] for r in sequences.nearest_shallower(rows, ["book"], ["node"], "depth", "node", "up").collect()}
    assert up == {(1, 0): None} | {(1, i): i - 1 for i in range(1, 40)} | {(1, 40): 16, (1, 41): None, (2, 1): None, (2, 2): None, (2, 3): None}
    ends = {(r["book"], r["node"]): r["next_place"] for r in sequences.section_ends(rows, ["book"], ["node"], "depth", "node").collect()}
    assert ends == {(1, 0): 41} | {(1, i): 41 if i < 17 else 40 for i in range(1, 40)} | {(1, 40): 41, (1, 41): None, (2, 1): None, (2, 2): 3, (2, 3): None}
    text = "\n".join(".".join(["1"] * i) + f" Part {'x' * i}" for i in range(1, 13)) + "\n1.1.9.9 Lost way\n1.2 Next one\n1.2.1.1 No parent"
    got = layout.heading_fallback(spark.createDataFrame([(1, 1, text)], "book int, page int, text string"), ["book"], "page", "text").orderBy("node").collect()
    assert [r["parent"] for r in got] == [None, *range(11), 2, 0, None]


def test_grids_hold_cells_not_spans(spark):
    from docsieve.operators import packages

    html = '<table><tr><td rowspan="100000000">a</td><td colspan="200000000">b</td></tr><tr><td>c</td></tr><tr><td rowspan=2>d</td><td>e</td></tr><tr><td>f</td></tr></table>'
    rows = packages.html_grid(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").collect()
    assert [(r["row"], r["col"], r["text"]) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (2, 1, "d"), (2, 2, "e"), (3, 2, "f")]


def test_boxes_of_all_sizes_meet(spark):
    """A page-sized box meets all boxes once; small ones meet their neighbours alone."""
    import random

    from docsieve.operators import matching
    from pyspark.sql import functions as F

    r = random.Random(5)
    side = lambda: r.choice([0.0, 0.5, 3.0, 4.0, 20.0, 130.0])
    rows = []
    for i in range(150):
        x, y = r.uniform(-50, 550), r.uniform(-50, 750)
        rows.append((i % 2, i, x, y, x + side(), y + side()))
    rows += [(0, 900, 0.0, 0.0, 600.0, 800.0), (0, 901, 0.0, 0.0, 600.0, 800.0), (1, 902, 8.0, 8.0, 4.0, 9.0)]
    boxes = spark.createDataFrame(rows, "page int, id long, x0 double, y0 double, x1 double, y1 double")
    meets = lambda a, b: a[0] == b[0] and all(x[2] <= x[4] for x in (a, b)) and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    expected = sorted((a[1], b[1]) for a in rows for b in rows if meets(a, b))
    assert sorted(tuple(x) for x in matching.meeting(boxes, boxes, ["page"]).select("a.id", "b.id").collect()) == expected and len(expected) > 300
    few = boxes.filter("id % 3 = 0")
    assert sorted(tuple(x) for x in matching.meeting(few, boxes, ["page"]).select("a.id", "b.id").collect()) == [p for p in expected if p[0] % 3 == 0]

    grid = spark.range(4_000).select(F.lit(1).alias("page"), "id", *(v.cast("double").alias(n) for n, v in (("x0", F.col("id") % 50 * 10), ("y0", F.floor(F.col("id") / 50) * 10), ("x1", F.col("id") % 50 * 10 + 9), ("y1", F.floor(F.col("id") / 50) * 10 + 9))))
    whole = spark.createDataFrame([(1, 9_999, 0.0, 0.0, 500.0, 800.0)], grid.schema)
    met = matching.meeting(grid.unionByName(whole), grid.unionByName(whole), ["page"])
    assert met.count() == 3 * 4_000 + 1


def test_metric_suite_of_few_items(spark):
    """No bundle gives no row; repeated or missing items make a bundle invalid; ratios over nothing are null."""
    from docsieve.operators import metrics

    fields = "present boolean, box struct<x0:double,y0:double,x1:double,y1:double>, row_count int, column_count int, spans string, cells string, numbers array<string>, units array<string>, axes array<string>, ticks string, legend string, series string, values string"
    costs = ", ".join(f"{c} long" for c in (*metrics.SUMMED, *metrics.LARGEST))
    said = (False, None, None, None, None, None, None, None, None, None, None, None, None)
    gold = spark.createDataFrame([("b", "calibration", i, "chart", *said) for i in "xy"], f"book string, split string, item string, kind string, {fields}")
    row = lambda mode, item: ("b", "calibration", item, mode, *said, *range(8))
    schema = f"book string, split string, item string, mode string, {fields}, {costs}"
    assert metrics.evaluate(gold, spark.createDataFrame([], schema), ["book"]).count() == 0
    out = metrics.evaluate(gold, spark.createDataFrame([row("off", "x"), row("off", "y"), row("auto", "x"), row("auto", "x"), row("full", "x")], schema), ["book"]).collect()
    assert len(out) == 90 and {r["status"] for r in out if r["mode"] != "off"} == {"invalid"}
    off = {r["metric"]: r["value"] for r in out if r["mode"] == "off"}
    assert off["object_detection_f1"] is None and off["bbox_iou"] is None and off["chart_axis_candidate_recall"] is None and off["chart_tick_candidate_exactness"] is None
    assert off["numeric_exactness"] == 1 and off["hallucinated_numeric_count"] == 0 and off["elapsed_ms"] == 0 and off["cold_start_ms"] == 4
