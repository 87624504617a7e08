import hashlib
import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from docsieve.llm import bpe, labelled, mixing, quality_classifier, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "toxicity", "simhash_dedup", "mixing", "byte_bpe"]
    good = cp.quality(spark, docs, SF).persist()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    model = toxicity.learn(good, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = cp.clean(spark, good, SF).persist()
    expected = sorted(r["doc_id"] for r in good.collect() if toxicity.score_text(model, r["text"] or "") < cp.MOST_TOXIC)
    assert sorted(r["doc_id"] for r in clean.collect()) == expected
    one = cp.deduplicate(spark, clean, SF).persist()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in simhash.groups(clean).collect()})
    mixed = cp.mix(spark, one, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(mixing.sized_documents(one)).collect() if r["copies"]}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == copies
    last = cp.tokens(spark, mixed, SF)
    assert Counter(r["doc_id"] for r in last.collect()) == copies


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, nothing, k):
    assert cp.STAGES[k][1](spark, nothing, SF).count() == 0


def test_stages_decide_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(18)], "doc_id long, quality int, toxic int")
    rows, sample = odd.collect(), [(t, y) for t, y in labelled.sample(odd, labels, "quality")]
    text = lambda r: r["text"] or ""
    own = cp._labels
    cp._labels = lambda spark, sf_dir: labels
    try:
        good, clean = cp.quality(spark, odd, SF), cp.clean(spark, odd, SF)
        models = quality_classifier.fit(sample, prior=0.5), toxicity.fit(labelled.sample(odd, labels, "toxic"))
        assert Counter(map(tuple, good.collect())) == Counter(tuple(r) for r in rows if quality_classifier.score_text(models[0], text(r)) >= cp.LEAST_QUALITY)
        assert Counter(map(tuple, clean.collect())) == Counter(tuple(r) for r in rows if toxicity.score_text(models[1], text(r)) < cp.MOST_TOXIC)
    finally:
        cp._labels = own
    one = cp.deduplicate(spark, odd, SF).collect()
    assert not Counter(map(tuple, one)) - Counter(map(tuple, rows))
    assert len({simhash.fingerprint(text(r)) for r in rows}) >= len(one) == simhash._grouped(odd, "doc_id", "text", simhash.BITS, simhash.SHINGLE).select("root").distinct().count()
    mixed, key = cp.mix(spark, odd, SF), lambda r: (r["doc_id"], r["source"], r["text"])
    taken = Counter()
    for r in mixing.copies(mixing.sized_documents(odd)).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", text(r)))] += 1
    assert got == +taken and {key(r) for r in mixed.collect()} <= set(map(key, rows))
    coder = bpe.coder(*bpe._known(cp.VOCABULARY, None))
    last = cp.tokens(spark, odd, SF).collect()
    assert Counter(tuple(r["token_ids"]) for r in last) == Counter(tuple(coder.encode(text(r))) for r in rows)
    for r in last:
        assert r["n_tokens"] == len(r["token_ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(coder.decode(r["token_ids"])).hexdigest()


def test_run(spark):
    out = cp.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    key = ("doc_id", "ids_sha256", "decoded_sha256")
    assert Counter(out.select(*key).collect()) == Counter(docs.select(*key).collect()) and out.count() > 20
