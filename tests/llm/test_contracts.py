"""The opN queries as they are registered, row by row against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from docsieve.llm import language_model, mixing, queries
from pyspark.sql import functions as F
from test_plain_versions import WORD, plain_components, plain_feature, plain_print, plain_signals, plain_targets, plain_verdicts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def types(df, **expected):
    own = dict(df.dtypes)
    assert {c: own.get(c) for c in expected} == expected


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_op1(spark, texts):
    df = queries.op1_sharding(spark, SF)
    types(df, size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    rows, slots = df.collect(), defaultdict(list)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items())
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, texts):
    df = queries.op2_audio(spark, SF)
    types(df, n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        counts, numbers = plain_feature(payload)
        *whole, rest = r["feature"].split(";")
        assert tuple(map(int, whole)) == counts and max(abs(float(v) - n) for v, n in zip(rest.split(","), numbers, strict=True)) < 2e-3


def test_op3(spark, docs, texts):
    of = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    df = queries.op3_quality_rules(spark, SF)
    types(df, n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    rows = df.collect()
    signals = [plain_signals(texts[r["doc_id"]]) for r in rows]
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows] == signals
    assert [r["base_failed"] for r in rows] == [n[0] < 20 or 100 * n[4] > 30 * n[0] for n in signals]
    assert [r["kept"] for r in rows] == plain_verdicts([(*of[r["doc_id"]], n) for r, n in zip(rows, signals, strict=True)])


def test_op4(spark, texts):
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = queries.op4_bpe(spark, SF)
    types(df, n_tokens="bigint", ids_sha256="string", decoded_sha256="string", n_chars="bigint")
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = plain.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert (r["decoded_sha256"], r["n_chars"]) == (hashlib.sha256(text.encode()).hexdigest(), len(text))


def test_op5(spark, docs, texts):
    df = queries.op5_mixing(spark, SF)
    types(df, size="bigint", source_size="bigint", target="double", taken="bigint")
    of, rows = {r["doc_id"]: r["source"] for r in docs.collect()}, df.collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[of[r["doc_id"]]] += r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
    targets = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[of[r["doc_id"]]] and math.isclose(r["target"], targets[of[r["doc_id"]]], rel_tol=1e-9)
    assert {r["doc_id"]: r["taken"] for r in queries.op5_mixing(spark, SF).collect()} == {r["doc_id"]: r["taken"] for r in rows}


def test_op5_leaves_expectations_unchanged(spark):
    """Sources of the same weight and documents are draws of one mix: over them, copies come to the share that was asked for.

    No document has over half a hundredth of its source's target, so that none is evened out afterwards.
    """
    sizes = [3, 5, 8, 13]
    rows = [(f"s{i:04d}", n) for i in range(60) for n in sizes * 200]
    docs = spark.createDataFrame([(k, s, "w " * n) for k, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    by = defaultdict(list)
    for r in mixing.copies(mixing.sized_documents(docs)).collect():
        assert 13 <= mixing.SHARE * r["target"]
        by[r["target"] / r["source_size"], r["size"]].append(r["copies"])
    assert len(by) == 3 * len(sizes)
    for (f, _), own in by.items():
        assert len(own) == 4000 and abs(sum(own) / len(own) - f) < 4 * 0.5 / len(own) ** 0.5


def test_op6(spark, tmp_path):
    pages = [(1, "u", "same"), (2, "u", "same"), (7, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 200_000), (6, None, "alone")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = queries.op6_warc(spark, str(tmp_path))
    types(df, page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    expected = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == max(g) else "revisit", None if i == max(g) else max(g)) for p, g in groups.items() for i in g]
    assert sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == sorted(expected)


@pytest.mark.parametrize("query, least", [(queries.op7_toxicity, 0.5), (queries.op9_quality_classifier, 0.3)])
def test_op7_and_op9(spark, docs, texts, query, least):
    df = query(spark, SF)
    types(df, held_out="boolean", score="double", predicted="int")
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = defaultdict(set)
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)
        by_text[texts[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_op8(spark, texts):
    df = queries.op8_simhash(spark, SF)
    types(df, fingerprint="string", component_id="bigint")
    prints = {i: plain_print(t) for i, t in texts.items()}
    expected = plain_components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()} == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}


def plain_scores(texts):
    """{id: log10 probability} by dictionaries of words and pairs; the weights come from the same maximisation over plainly counted cells."""
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in texts.items()}
    pairs_of = lambda own: list(zip(["\n", *own[:-1]], own, strict=True))

    def counts(ids):
        words, pairs = Counter(), Counter()
        for i in ids:
            words.update(tokens[i])
            pairs.update(pairs_of(tokens[i]))
        return words, pairs, sum(words.values())

    train = [i for i in texts if crc(i, 10)]
    words, pairs, n = counts(train)
    rest, rest_pairs, m = counts([i for i in train if crc(i, 10) != 1])
    v, cells = len(words), Counter()
    bucket = lambda c: min(c.bit_length(), 15)
    step = lambda p: round(-8 * math.log10(p)) if p > 0 else -1
    for i in train:
        if crc(i, 10) == 1:
            for a, b in pairs_of(tokens[i]):
                cells[bucket(rest[a]), step(rest_pairs[a, b] / max(rest[a], 1)), step(rest[b] / max(m, 1))] += 1
    w = language_model.em([(*k, c) for k, c in sorted(cells.items())], v)
    out = {}
    for i, own in tokens.items():
        total = 0.0
        for a, b in pairs_of(own):
            x = w[bucket(words[a])]
            total += math.log10(x[0] * pairs[a, b] / max(words[a], 1) + x[1] * words[b] / n + x[2] / (v + 1))
        out[i] = total
    return out


def test_op10(spark, texts):
    df = queries.op10_language_model(spark, SF)
    types(df, held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")
    expected, rows = plain_scores(texts), df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], 10) == 0)
        # steps that fall on the edge between two cells may go either way
        assert math.isclose(r["score"], expected[r["doc_id"]], rel_tol=1e-4)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "en", "s", "one two three"), ("b", None, "s", "one two two"), (None, "en", None, None), (None, "en", None, None)], "doc_id string, lang string, source string, text string")
    assert sorted(str(r[0]) for r in language_model.score(docs).select("doc_id").collect()) == ["None", "None", "a", "b"]
    plan = mixing.copies(mixing.sized_documents(docs))
    assert dict(plan.dtypes)["doc_id"] == "string" and plan.count() == 4
    assert mixing.mix(docs).count() == plan.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = db.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in found.description)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    place = {c[0]: i for i, c in enumerate(found.description)}
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(tuple(r[place[c]] for c in names) for r in found.fetchall())
