"""The stored index against scoring everything."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import stored_index as I

WEIGHTED = "array<struct<term:string,weight:int>>"


def plain(entries, questions, limit):
    """(question, entry, score, matched, place) of every pair with a common term."""
    out = []
    for q, wanted, scope in questions:
        scored = []
        for e, terms, kind in entries:
            if e is None or scope is not None and kind not in scope:
                continue
            common = {t: w for t, w in terms or [] if t in set(wanted or [])}
            if common:
                scored.append((-sum(common.values()), hashlib.sha256(str(e).encode()).hexdigest(), e, sorted(common)))
        out += [(q, e, -s, m, i + 1) for i, (s, _, e, m) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def frames(spark, entries, questions):
    e = spark.createDataFrame(entries, f"entry_id long, words {WEIGHTED}, kind string")
    q = spark.createDataFrame(questions, "q long, wanted array<string>, scope array<string>")
    return e, q


def found(index, questions, limit, first):
    allowed = F.expr("scope IS NULL OR array_contains(scope, kind)")
    rows = I.search(index, questions, query_id="q", terms=F.col("wanted"), limit=limit, allowed=allowed, first_postings=first)
    return sorted((r["query_id"], r["entry_id"], r["score"], r["matched"], r["place"]) for r in rows.collect())


@pytest.mark.parametrize("first", [0, 10_000])
def test_search_is_exact_whatever_its_first_pass_reads(spark, tmp_path, first):
    rng = random.Random(first)
    words = [f"w{i}" for i in range(30)]
    # w0 to w2 are in nearly every entry, so that they open no new pairs once a bound is known
    entries = [(i, [(w, rng.choice([1, 1, 4, 9])) for j, w in enumerate(words) if rng.random() < (0.9 if j < 3 else 0.1)], rng.choice("abc")) for i in range(120)]
    questions = [(i, rng.sample(words, rng.randint(1, 9)) + ["nowhere"] + words[:2], rng.choice([None, ["a"], ["a", "b"], []])) for i in range(25)] + [(90, [], None), (91, None, None)]
    e, q = frames(spark, entries, questions)
    index = I.build(e.filter("entry_id < 70"), str(tmp_path / "i"), entry_id="entry_id", terms=F.col("words"), attributes=["kind"], buckets=8)
    index = I.append(index, e.filter("entry_id >= 70"), entry_id="entry_id", terms=F.col("words"))
    expected = plain(entries, questions, 4)
    assert found(index, q, 4, first) == expected
    index = I.merged(I.opened(spark, str(tmp_path / "i")))
    assert (index.version, len(index.segments)) == (3, 1)
    assert found(I.opened(spark, str(tmp_path / "i")), q, 4, first) == expected
    assert I.stale(index, e, entry_id="entry_id", terms=F.col("words")).isEmpty()


def test_only_buckets_of_the_question_are_read(spark, tmp_path):
    entries = [(i, [(f"t{i}", 1), ("common", 1)], "a") for i in range(200)]
    e, q = frames(spark, entries, [(1, ["t7"], None)])
    index = I.build(e, str(tmp_path / "i"), entry_id="entry_id", terms=F.col("words"), attributes=["kind"], buckets=16)
    rows = I.search(index, q, query_id="q", terms=F.col("wanted"), limit=3)
    assert [(r["entry_id"], r["matched"]) for r in rows.collect()] == [(7, ["t7"])]
    bucket = index.terms().filter("term = 't7'").first()["bucket"]
    read = rows._jdf.queryExecution().executedPlan().toString()
    scan = index.postings().filter(F.col("bucket").isin([bucket]))
    assert {r[0].split("bucket=")[1].split("/")[0] for r in scan.select(F.input_file_name()).collect()} == {str(bucket)}
    assert "PartitionFilters" in read and f"= {bucket})" in read


def test_a_common_term_opens_no_pairs(spark, tmp_path):
    """The rare term of weight 9 fills the places; the 3,000 entries with the common one alone can't get in."""
    entries = [(i, [("common", 1)] + ([("rare", 9)] if i < 5 else []), "a") for i in range(3000)]
    e, q = frames(spark, entries, [(1, ["common", "rare"], None)])
    index = I.build(e, str(tmp_path / "i"), entry_id="entry_id", terms=F.col("words"), attributes=["kind"])
    got = found(index, q, 3, 0)
    assert got == plain(entries, [(1, ["common", "rare"], None)], 3) and all(r[2] == 10 for r in got)


def test_odd_inputs(spark, tmp_path):
    e, q = frames(spark, [], [(1, ["a"], None)])
    index = I.build(e, str(tmp_path / "none"), entry_id="entry_id", terms=F.col("words"), attributes=["kind"])
    assert found(index, q, 3, 0) == [] and index.entries().isEmpty()
    entries = [(1, [("a", 1)], None), (2, [], "k"), (3, None, "k"), (None, [("a", 1)], "k")]
    e, _ = frames(spark, entries, [])
    terms = F.coalesce("words", F.array().cast(WEIGHTED))
    index = I.append(index, e, entry_id="entry_id", terms=terms)
    assert found(index, q, 3, 0) == [(1, 1, 1, ["a"], 1)]
    assert sorted(r["entry_id"] for r in index.entries().collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        I.append(index, e, entry_id="entry_id", terms=terms)
    with pytest.raises(ValueError):
        I.build(e.unionByName(e), str(tmp_path / "twice"), entry_id="entry_id", terms=terms)
    with pytest.raises(Exception, match="(?i)exist"):
        I.build(e, str(tmp_path / "none"), entry_id="entry_id", terms=terms)


def test_words_glyphs_and_ids(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "Field strength \\mathbf{B}"), ("o2", "field only"), ("o3", None)], "id string, text string")
    index = I.build(rows, str(tmp_path / "i"), entry_id="id", terms=I.science_terms(F.col("text"), F.col("id")))
    asked = spark.createDataFrame([(1, "field \\mathbf{B}"), (2, "o3"), (3, None)], "q long, prompt string")
    got = I.search(index, asked, query_id="q", terms=I.science_question(F.col("prompt")), limit=8)
    assert sorted((r["query_id"], r["entry_id"], r["score"]) for r in got.collect()) == [(1, "o1", 6), (1, "o2", 1), (2, "o3", 100)]
