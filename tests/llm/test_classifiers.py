import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import labelled, quality_classifier, queries, toxicity

BIG = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    scores = query(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").filter("held_out")
    return [(r["score"], r["predicted"], r[label]) for r in scores.collect()]


@pytest.mark.parametrize("query, label, least", [(queries.op7_toxicity, "toxic", 0.9), (queries.op9_quality_classifier, "quality", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    rows = held_out(spark, query, label)
    assert len(rows) > 30 and sum(p == y for _, p, y in rows) / len(rows) >= least


@pytest.mark.parametrize("model", [toxicity, quality_classifier])
def test_odd_rows(spark, odd, nothing, model):
    rows = [("good words here", 0), ("bad nasty thing", 1)] * 30 + [("", 0)]
    own = model.fit(rows)
    out = model.score(odd, own)
    assert out.columns == [*odd.columns, "_score"] and out.count() == odd.count()
    assert all(0 <= r[0] <= 1 for r in out.select("_score").collect())
    equal = out.filter(F.coalesce("text", F.lit("")) == "").select("_score").distinct()
    assert equal.count() == 1
    assert model.score(nothing, own).count() == 0
    assert [r[0] for r in model.score(odd, model.fit([])).select("_score").distinct().collect()] == [0.5]


def test_one_class_only():
    assert quality_classifier.score_text(quality_classifier.fit([("a b", 1)] * 20), "a b") > 0.5


def test_texts_without_spaces_count_beyond_their_start():
    rng = random.Random(3)
    text = lambda alphabet: "同" * 30 + "".join(rng.choices(alphabet, k=400))
    good, junk = "山川草木花鳥風月", "買売金銭札束賭博"
    model = quality_classifier.fit([(text(x), y) for _ in range(60) for x, y in ((junk, 0), (good, 1))])
    one = lambda t: quality_classifier.score_text(model, t)
    assert all(one(text(good)) > 0.9 and one(text(junk)) < 0.1 for _ in range(10))
    tail = lambda alphabet: "同" * 100_000 + "".join(rng.choices(alphabet, k=100_000))
    assert one(tail(good)) > one(tail(junk))


ODD = ["", " ", "a", "a a", "ab  c\td", " x ", "漢字 かな " * 9, "w" * 50, "one two two three\n" * 5, "é ñ\x0bq\x1fz 🙂"]


def plain_features(text):
    """Counts of whole words, pairs of words and n-grams inside marked words, by their strings."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = Counter(("w", w) for w in words) + Counter(("p", "=" if a == b else (a, b)) for a, b in zip(words, words[1:], strict=False))
    for w in words:
        marked = f" {w} "
        out.update(("n", marked[i : i + n]) for n in quality_classifier.NGRAMS for i in range(len(marked) - n + 1))
    return out


@pytest.mark.parametrize("text", ODD)
def test_features_are_words_pairs_and_ngrams(text):
    whole = np.sort(np.concatenate(list(quality_classifier.features(text))))
    for size in (1, 2, 3, 7, 64):
        assert (np.sort(np.concatenate(list(quality_classifier.features(text, size)))) == whole).all()
    expected = plain_features(text) or Counter({"": 1})
    # one bucket for each string, but for the few that meet by chance
    assert len(whole) == sum(expected.values())
    assert abs(len(np.unique(whole)) - len(expected)) <= 1 + len(expected) // 100


def test_quality_score_is_the_softmax_of_the_average():
    model = quality_classifier.fit([("good words here", 1), ("bad bad thing", 0)] * 30)
    for text in ODD:
        ids, share = quality_classifier.bag(text)
        logit = float((model.weights[ids].astype(float) * share).sum() + model.bias)
        assert quality_classifier.score_text(model, text) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def plain_logit(model, text):
    """Convolutions over all words by loops."""
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]
    x = []
    for w in words:
        (h,) = np.concatenate([p for p, _ in toxicity.parts_of(w)])
        a, b = toxicity._rows(h[None])[0]
        x.append(np.concatenate([model.table[a], model.table[b]]))
    x += [np.zeros(toxicity.DIM)] * (2 if x else 3)
    total = model.bias
    for j, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            r = [sum(float(x[i + k] @ model.filters[j][k][:, f]) for k in range(width)) + model.biases[j, f] for i in range(len(x) - 2)]
            total += max(0.0, max(r)) * model.out[j, f]
    return float(total)


def test_toxicity_forward_pass_and_parts():
    model = toxicity.fit([("fine words all around", 0), ("you awful rotten thing", 1)] * 40)
    text = "some words " * 50 + "awful, rotten! " + "more words " * 50
    for t in (text, "", "Awful", "fine words", "you awful", "ÄÖ x " * 3):
        raw = toxicity.logit(model, [w for w, _ in toxicity.parts_of(t)])
        assert raw == pytest.approx(plain_logit(model, t), abs=1e-4)
        for size in (1, 5, 100):
            assert toxicity.score_text(model, t, size) == pytest.approx(toxicity.score_text(model, t), abs=1e-6)
    assert toxicity.score_text(model, text) > 0.5 > toxicity.score_text(model, "fine words here")


def test_languages_are_told_by_their_characters():
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    model = toxicity.fit([(text(x), i % 2) for i in range(40) for x in ("abcdef", "ghijkl")])
    own = [{model.language(toxicity._unit(sum(c for _, c in toxicity.parts_of(text(x))))) for _ in range(20)} for x in ("abcdef", "ghijkl")]
    assert not own[0] & own[1]


def test_long_labelled_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "long words " * 30_000), (2, "x" * 100_000), (3, "short"), (3, "other"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    got = sorted(labelled.sample(docs, labels, "quality"), key=lambda r: len(r[0]))
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    assert [len(t) for t, _ in got] == sorted({1: 330_000, 2: 100_000, 3: 5, 4: 0}[i] for i in kept)
    assert sum(len(t) for t, _ in labelled.sample(docs, labels, "quality", most_bytes=100_010)) <= 100_010


def test_sample_is_bounded_and_leaves_folds_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}" if i % 5 else None, "x") for i in range(200)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 3 if i % 3 < 2 else None) for i in range(300)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", per_class=20)
    assert len(got) <= 40 and {y for _, y in got} == {0, 1}
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _ in got if t)
    assert labelled.sample(docs.limit(0), labels, "toxic") == [] and labelled.sample(docs, labels.limit(0), "toxic") == []
