"""Each operator against a plain version on odd rows, empty tables and whole small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import audio, bpe, language_model, mixing, quality_rules, queries, sharding, simhash, warc
from docsieve.llm.common import materialize as sharding_materialize
from docsieve.llm.common import word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# sharding


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2_000])
def test_shards_hold_all_rows_evenly(odd, bucket_bytes):
    out = sharding.shuffle_to_shards(odd, 4, bucket_bytes=bucket_bytes)
    assert out.columns == [*odd.columns, "_shard", "_slot"]
    assert rows_of(out, *odd.columns) == rows_of(odd, *odd.columns)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["_shard"]].append(r["_slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_agree_on_reruns_and_keep_an_empty_table(odd, nothing):
    key = ("doc_id", "text", "_shard")
    assert rows_of(sharding.shuffle_to_shards(odd, 3), *key) == rows_of(sharding.shuffle_to_shards(odd.repartition(7), 3), *key)
    assert sharding.shuffle_to_shards(nothing, 3).count() == 0


def test_more_bytes_get_more_cells(odd):
    few = sharding.shuffle_to_shards(odd, 4, bucket_bytes=1_000, cells=2)
    assert rows_of(few, "doc_id", "text") == rows_of(odd, "doc_id", "text")


def test_equal_rows_are_split_by_their_count(spark, monkeypatch):
    """A third of all rows are equal: no bucket holds more than its share."""
    same = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    rows = spark.range(6_000).select(same.alias("doc_id"), F.concat(F.lit("some words of text "), same).alias("text"), F.create_map(F.lit("k"), same % 2).alias("m"))
    seen = []
    monkeypatch.setattr(sharding, "materialize", lambda df, name: seen.append(sharding_materialize(df, name)) or seen[-1])
    out = sharding.shuffle_to_shards(rows, 4, bucket_bytes=8_000)
    assert seen[0].agg(F.max("n")).first()[0] >= 2_000 and seen[-1].agg(F.max("n")).first()[0] < 20
    values = lambda df: Counter((r["doc_id"], r["text"], r["m"]["k"]) for r in df.collect())
    assert values(out) == values(rows)
    assert [r[1:] for r in out.groupBy("shard").agg(F.count("*"), F.max("slot"), F.count_distinct("slot")).collect()] == [(1_500, 1_499, 1_500)] * 4
    again = sharding.shuffle_to_shards(rows.repartition(5), 4, bucket_bytes=8_000)
    assert rows_of(out, "doc_id", "shard", "slot") == rows_of(again, "doc_id", "shard", "slot")


# audio


def plain_feature(payload):
    """The feature string by the book: whole signal, direct filtering, no chunks; numbers as the tensors keep them."""
    x = np.zeros(audio.UP * len(payload))
    x[:: audio.UP] = (np.frombuffer(payload, dtype=np.uint8) - 128.0) / 128
    y = np.convolve(x, audio._low_pass(audio.UP, audio.DOWN, audio.TAPS).T.ravel())[: len(x) : audio.DOWN]
    rate = audio.RATE * audio.UP / audio.DOWN
    frames = [y[i : i + audio.FRAME] for i in range(0, len(y) - audio.FRAME + 1, audio.HOP)]
    bank = audio._mel_bank(rate, audio.FRAME, audio.MELS)
    mels = np.array([np.log10(np.abs(np.fft.rfft(f * np.hanning(audio.FRAME))) ** 2 @ bank + 1e-8) for f in frames]).astype(np.float16).astype(float)
    energy = np.array([10 * np.log10((f * f).mean() + 1e-8) for f in frames])
    on, inside, runs = False, 0, 0
    for e in energy:
        was, on = on, e >= energy.mean() + audio.OPEN_DB or on and e >= energy.mean() + audio.CLOSE_DB
        inside, runs = inside + on, runs + (on and not was)
    return (len(frames), runs, inside), [energy.mean(), *mels.mean(axis=0)]


def test_media_round_trip(spark, odd, nothing):
    clipped = audio.clip_tensors(audio.store_media(odd), media_col="media").persist()
    got = audio.features(clipped).select("doc_id", "n_bytes", "_audio.*", "feature").collect()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    by_text = defaultdict(set)
    for r in got:
        if r["doc_id"] is None:
            continue
        plain = (text[r["doc_id"]] or "").encode()
        payload = plain + b" " * (-len(plain) % 192 or (0 if plain else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(payload) + 44
        by_text[text[r["doc_id"]]].add((r["media_sha256"], r["feature"]))
        counts, numbers = plain_feature(payload)
        *whole, rest = r["feature"].split(";")
        assert tuple(map(int, whole)) == counts and np.allclose([float(v) for v in rest.split(",")], numbers, atol=2e-3)
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.features(audio.clip_tensors(audio.store_media(nothing))).count() == 0


def test_null_recordings_have_nulls(spark):
    rows = spark.createDataFrame([("a", None), ("b", audio.to_wav(b" " * 192))], "doc_id string, media binary")
    got = {r["doc_id"]: r for r in audio.features(audio.clip_tensors(rows)).collect()}
    assert got["a"]["audio"] is None and got["a"]["feature"] is None and got["b"]["feature"].startswith("1;")
    assert [r["id"] for r in audio.clip_rows(audio.clip_tensors(rows)).collect()] == ["b"]


def test_chunks_of_samples_change_nothing():
    samples = np.random.default_rng(2).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    whole = audio.analyse(samples, 8_000)
    for chunk in (192, 192 * 3, 192 * 7):
        part = audio.analyse(samples, 8_000, chunk)
        assert np.allclose(whole[1], part[1]) and np.allclose(whole[0], part[0], atol=2e-3)


def test_resampling_is_filtering_of_the_upsampled_signal():
    x = np.random.default_rng(1).normal(size=600)
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    h = audio._low_pass(up, down, taps)
    full = np.empty(up * taps)
    for phase in range(up):
        full[phase::up] = h[phase]
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    assert np.allclose(audio.resample(x), np.convolve(spread, full)[: len(spread) : down])


def test_segments_have_hysteresis():
    energy = np.array([0, 2, 1, 1, 0, 1, 2, 2, 0.4, 0])
    starts, ends = audio.segments(energy, 2, 0.5)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(1, 4), (6, 8)]


def test_clips_are_tensors_with_spans(odd):
    clipped = audio.clip_tensors(audio.store_media(odd.filter("doc_id = 9")))
    row = clipped.collect()[0]
    own = audio.read_clips(bytes(row["clips"]))
    assert own.schema.field("log_mel").type == audio.tensor_type() and own["log_mel"].to_numpy_ndarray().shape[1:] == (audio.CLIP_FRAMES, audio.MELS)
    rate = audio.RATE * audio.UP / audio.DOWN
    assert np.allclose(np.diff(own["start_s"].to_numpy()), audio.CLIP_FRAMES * audio.HOP / rate)
    frames = own["frames"].to_numpy()
    assert np.allclose(own["end_s"].to_numpy() - own["start_s"].to_numpy(), ((frames - 1) * audio.HOP + audio.FRAME) / rate)
    assert all(0 <= x["start_s"] < x["end_s"] for x in row["segments"])
    rows = audio.clip_rows(clipped).orderBy("clip").collect()
    assert [r["clip"] for r in rows] == list(range(own.num_rows))
    assert np.allclose(rows[0]["log_mel"], own["log_mel"].to_numpy_ndarray()[0].ravel(), atol=1e-3)


# quality rules


def plain_signals(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def plain_cuts(values):
    """{signal: (rows, low, high)} of lists of values of one group, by sorting."""
    out = {}
    for name, own in values.items():
        bins = sorted((v >> max(0, v.bit_length() - 8)) << max(0, v.bit_length() - 8) for v in own)
        n = len(bins)
        q1, q3 = bins[-(-n // 4) - 1], bins[-(-3 * n // 4) - 1]
        distinct = sorted(set(bins))
        far = lambda a: 2 * sum(b + 1 >= 256 * (a + 1) for b in bins) >= sum(b > a for b in bins) > 0
        gaps = [(a + 1) * 16.0 for a in distinct if a >= q3 and far(a)]
        high = [*([q3 + 3 * (q3 - q1)] if q3 > q1 else []), *gaps[:1]]
        out[name] = n, q1 - 3 * (q3 - q1) if name == "word_length" and q3 > q1 else None, min(high, default=None)
    return out


def plain_verdicts(rows):
    """kept of (lang, source, five counts) rows, by dictionaries."""
    rate = lambda n: {"word_length": 100 * n[1] // max(n[0], 1), "symbols": 1000 * n[2] // max(n[0], 1), "dup_lines": 1000 * n[3] // max(n[0], 1), "repeats": 1000 * n[4] // max(n[0], 1)}
    fine = lambda n: n[0] >= 20 and 100 * n[4] <= 30 * n[0]

    def cuts(key):
        groups = defaultdict(lambda: defaultdict(list))
        for lang, source, n in rows:
            if fine(n):
                for name, v in rate(n).items():
                    groups[key(lang, source)][name].append(v)
        return {k: plain_cuts(v) for k, v in groups.items()}

    def drawn(own, above):
        w = own[0] / (own[0] + 50)
        return own[0], *(a if o is None else o if a is None else w * o + (1 - w) * a for o, a in zip(own[1:], above[1:], strict=True))

    whole, langs, groups = cuts(lambda *_: 0), cuts(lambda lang, _: lang), cuts(lambda *k: k)
    kept = []
    for lang, source, n in rows:
        good = fine(n)
        for name, v in rate(n).items() if good else ():
            _, low, high = drawn(groups[lang, source][name], drawn(langs[lang][name], whole[0][name]))
            good &= (low is None or v >= low - 1e-9) and (high is None or v <= high + 1e-9)
        kept.append(good)
    return kept


def test_signals_base_rules_and_verdicts(odd, docs, nothing):
    for table, names in ((odd, ("_signals", quality_rules.FIELDS)), (docs, ("signals", quality_rules.FIELDS))):
        got = quality_rules.judge(quality_rules.signals(table), signals_col=names[0]).collect()
        assert len(got) == table.count() and all(c in got[0].asDict() for c in table.columns)
        seen = []
        for r in got:
            n = plain_signals(r["text"] or "")
            assert tuple(r[f] for f in quality_rules.FIELDS) == n
            assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
            seen.append((r["lang"], r["source"], n))
        assert [r["kept"] for r in got] == plain_verdicts(seen)
    assert 0 < sum(r["kept"] for r in got) < sum(not r["base_failed"] for r in got)
    assert quality_rules.judge(quality_rules.signals(nothing), signals_col="_signals").count() == 0


def test_cuts_stand_when_rows_are_added(spark):
    """Clean-looking texts with some symbols, a tenth of the table, between the usual ones and the odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = quality_rules.signals(docs).select("doc_id", "lang", "source", "signals").persist()
    groups = [tuple(r) for r in measured.select("lang", "source").distinct().collect()]
    more = [(-k, lang, source, (1000, 5030, n, 0, 0)) for k, (lang, source) in enumerate(groups * 2) for n in ((10, 40, 150, 500)[k % 4],)]
    both = measured.unionByName(spark.createDataFrame(more, measured.schema))
    was, now = ({r["doc_id"]: r["kept"] for r in quality_rules.judge(m).filter("doc_id >= 0").collect()} for m in (measured, both))
    assert len(more) > 0.1 * len(was) and sum(not k for k in was.values()) > 20
    assert sum(was[i] != now[i] for i in was) <= 0.005 * len(was)
    measured.unpersist()


def test_sketches_merge_exactly(docs):
    measured = quality_rules.signals(docs)
    halves = quality_rules.sketch(measured.filter("lang = 'en'"), ["lang"]).unionByName(quality_rules.sketch(measured.filter("lang <> 'en' or lang is null"), ["lang"]))
    key = ("signal", "bin", "n")
    assert rows_of(quality_rules.merge(halves, []), *key) == rows_of(quality_rules.merge(quality_rules.sketch(measured, []), []), *key)


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_coder():
    import public_tokenizers as p
    import tiktoken

    with open(p.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_tiktoken(odd, docs, nothing, tiktoken_coder):
    for table in (odd.select("doc_id", "text"), docs):
        for r in bpe.decode(bpe.encode(table, queries.VOCABULARY), queries.VOCABULARY).collect():
            assert r["token_ids"] == tiktoken_coder.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
    both = bpe.encode_and_decode(odd, queries.VOCABULARY)
    apart = bpe.decode(bpe.encode(odd, queries.VOCABULARY), queries.VOCABULARY, ids_col="_token_ids")
    own = (F.concat_ws(",", F.col("_token_ids").cast("array<string>")), "decoded")
    assert Counter((r[0], bytes(r[1])) for r in both.select(*own).collect()) == Counter((r[0], bytes(r[1])) for r in apart.select(*own).collect())
    assert bpe.encode_and_decode(nothing, queries.VOCABULARY).count() == 0


def test_random_strings(tiktoken_coder):
    import public_tokenizers as p

    coder = bpe.ByteBpe(p.path(queries.VOCABULARY), p.PATTERN)
    rng = np.random.default_rng(3)
    letters = list("ab é漢'sI.  \n\t\r0₂  _🙂́")
    for _ in range(500):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        ids = coder.encode(text)
        assert ids == tiktoken_coder.encode_ordinary(text)
        assert coder.decode(ids) == text.encode() and "".join(coder.characters(ids)) == text
        assert [tuple(x) for x in zip(*(v.tolist() for v in coder.spans(ids)), strict=True)] == plain_spans(coder, ids)


def plain_spans(coder, ids):
    """Spans from the bytes that each token adds: the characters it touches."""
    out, done = [], 0
    text = coder.decode(ids)
    of_byte = [i for i, c in enumerate(text.decode()) for _ in c.encode()]
    for i in ids:
        n = len(coder.decode([i]))
        out.append((of_byte[done], of_byte[done + n - 1] + 1))
        done += n
    return out


def test_split_characters_and_cut_lists(spark, tiktoken_coder):
    import public_tokenizers as p

    coder = bpe.ByteBpe(p.path(queries.VOCABULARY), p.PATTERN)
    ids = coder.encode("🙂𓀀x")
    assert len(ids) > 3 and coder.characters(ids)[-1] == "x" and "" in coder.characters(ids)
    assert sorted(set(coder.byte_of[[ord(c) for c in bpe.byte_characters()]].tolist())) == list(range(256))
    docs = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "doc_id int, token_ids array<int>")
    got = {r["doc_id"]: (bytes(r["decoded"]), r["decoded_text"]) for r in bpe.decode(docs, queries.VOCABULARY).collect()}
    assert got[1] == ("🙂𓀀x".encode(), "🙂𓀀x") and got[2][1] == "\ufffd" and got[3] == got[4] == (b"", "")


def test_other_patterns_take_no_shortcut():
    import public_tokenizers as p
    import tiktoken

    with open(p.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"[a-z]+ [a-z]+|\s|\S"
    own, other = bpe.ByteBpe(p.path(queries.VOCABULARY), pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("of the same kind", "a b c", "x  y z"):
        assert own.encode(text) == other.encode_ordinary(text)


# mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("fan_in", [4, 128])
def test_mix_meets_its_targets(odd, docs, fan_in):
    for table in (odd, docs):
        sized = mixing.sized_documents(table)
        got = mixing.copies(sized, fan_in=fan_in).collect()
        assert len(got) == table.count()
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["copies"]
            assert 0 <= r["copies"] <= 3
        targets = plain_targets(sizes)
        for r in got:
            assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        for s, n in taken.items():
            own = [r["size"] for r in got if r["source"] == s and r["size"]]
            assert abs(n - targets[s]) <= max(own, default=0)  # the document left at the root
            assert len(own) < 30 or abs(n - targets[s]) <= 0.01 * targets[s]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_sources_come_within_a_hundredth(spark, sf):
    plan = mixing.copies(mixing.sized_documents(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")))
    sums = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.count_if(F.col("size") > 0).alias("n"))
    rows = sums.collect()
    assert rows and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in rows if r["n"] >= 30)


def test_large_documents_are_evened_out(spark):
    """A document of half its source, and sources of one document, two equal ones, and none with words."""
    sizes = {"a": [4_000, *range(10, 110)], "b": [500], "c": [70, 70], "d": [0, 0], None: [9, *[1] * 60]}
    rows = [(s, n) for s, own in sizes.items() for n in own]
    docs = spark.createDataFrame([(k, s, "w " * n) for k, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    got = defaultdict(list)
    for r in mixing.copies(mixing.sized_documents(docs)).collect():
        f = min(r["target"] / r["source_size"], 3) if r["source_size"] else 0
        assert r["copies"] in (math.floor(f), math.ceil(f)) if r["size"] else r["copies"] == 0
        got[r["source"]].append(r)
    for s, most in (("a", 0.01), (None, 0.02)):
        assert abs(sum(r["size"] * r["copies"] for r in got[s]) - got[s][0]["target"]) <= most * got[s][0]["target"]


def test_mix_is_native_and_repeatable(docs, nothing):
    plan = mixing.copies(mixing.sized_documents(docs))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    again = mixing.copies(mixing.sized_documents(docs.repartition(5)))
    assert rows_of(plan, "doc_id", "copies") == rows_of(again, "doc_id", "copies")
    assert mixing.mix(nothing).count() == 0


def test_mix_repeats_rows_with_all_columns(odd):
    plan = mixing.copies(mixing.sized_documents(odd))
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]


def test_word_count(odd):
    for r in odd.select("text", word_count("text").alias("n")).collect():
        assert r["n"] == len(WORD.findall(r["text"] or ""))


# WARC


def test_archives_round_trip(spark, nothing):
    big = "x" * (warc.CHUNK * 3 + 17) + "é"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "page"), (9, "a b", "page"), (5, "u", "page"), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n"), (None, "n", "page"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_id string").repartition(3)
    chunks = warc.read_chunks(warc.archive(pages))
    number = lambda x: None if x is None else int(x)
    got = {(number(r["page_id"]), r["payload_digest"]): r for r in warc.records(chunks).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    for html, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            r = got[i, digest]
            assert r["payload_bytes"] == len(html.encode())
            assert (r["record_type"], number(r["refers_to"])) == (("response", None) if i == first else ("revisit", first))
    whole = b"".join(bytes(r["data"]) for r in chunks.filter("page_id = 6").orderBy("chunk").collect())
    assert whole == big.encode() and chunks.filter("page_id = 6").count() == 4
    assert warc.records(warc.read_chunks(warc.archive(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0


# SimHash


def plain_print(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(odd, docs, nothing):
    for table in (odd.filter("doc_id is not null"), docs):
        prints = {r["doc_id"]: plain_print(r["text"] or "") for r in table.collect()}
        expected = plain_components(prints)
        got = simhash.groups(table).collect()
        assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
        assert {r["doc_id"]: r["component_id"] for r in got} == expected
        stay = simhash.deduplicate(table)
        assert stay.columns == table.columns and sorted(r["doc_id"] for r in stay.select("doc_id").collect()) == sorted(set(expected.values()))
    assert simhash.groups(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0
    assert simhash.groups(odd).count() == odd.count()


def test_repeated_and_missing_ids_keep_one_row_a_group(spark):
    texts = ["a b c d e", "a b c d e", "v w x y z", "one two three four", None]
    rows = [(1, texts[0], 0), (1, texts[1], 0), (1, texts[2], 0), (None, texts[3], 0), (None, texts[3], 1), (None, texts[4], 0), (5, texts[4], 0)]
    stay = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, nth int"))
    assert rows_of(stay, "doc_id", "text") == Counter([(1, texts[0]), (1, texts[2]), (None, texts[3]), (5, None)])


@pytest.mark.parametrize("parts", [4, 5, 6])
def test_anchors_cover_all_near_pairs(parts):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 3_000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys, index = simhash.anchor_keys(np.concatenate([a, b]), parts)
    assert [simhash.parts_for(n) for n in (1, 1 << 33, (1 << 33) + 1, 1 << 40)] == [4, 4, 5, 6]
    groups = defaultdict(set)
    for k, i in zip(keys.tolist(), index.tolist(), strict=True):
        groups[i].add(k)
    assert all(groups[i] & groups[i + len(a)] for i in range(len(a)))


def test_very_large_groups_go_out_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 40)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(6)
    prints, now = {0: 0}, 0
    for i in range(1, 150):
        for bit in rng.choice(64, 2, replace=False):
            now ^= 1 << int(bit)
        prints[i] = now if i % 3 else int(rng.integers(0, 1 << 63))
    distinct = {v: k for k, v in prints.items()}
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in distinct], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(table)).collect()}
    expected = plain_components({i: v for v, i in distinct.items()})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    same = defaultdict(set)
    for v, i in distinct.items():
        same[expected[i]].add(found.get(signed(v), signed(v)))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# language model


def test_base_scores_and_counts(odd, docs, nothing):
    for table, block in ((docs, 3_000), (odd.select("doc_id", "text"), language_model.BLOCK)):
        texts = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for _, t in texts]
        out = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in texts]
        counts = Counter(w for own, o in zip(tokens, out, strict=True) if not o for w in own)
        n, v = sum(counts.values()), len(counts)
        expected = Counter((i, o, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)) for (i, _), own, o in zip(texts, tokens, out, strict=True))
        got = language_model.score(table, block=block, entries=2_000).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
        if block < language_model.BLOCK:
            whole = {r["doc_id"]: r["score"] for r in language_model.score(table).collect()}
            assert all(math.isclose(whole[r["doc_id"]], r["score"], rel_tol=1e-9) for r in got)
            held = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(nothing).count() == 0


def test_documents_go_on_in_the_next_block(spark, docs, odd):
    """Blocks smaller than a document, and of few tokens, change no score."""
    for table, block in ((docs.filter("doc_id < 60"), 40), (odd.filter("length(text) < 10000 OR text IS NULL").select("doc_id", "text"), 2)):
        made = language_model.blocks(table, block=block)
        assert made.agg(F.max(F.size("tokens"))).first()[0] < 20 * block and made.filter(F.exists("cuts", lambda x: x.isNotNull())).count() > 1
        number = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
        got, whole = (Counter(map(number, language_model.score(table, block=b, entries=50).collect())) for b in (block, language_model.BLOCK))
        assert got == whole


def test_partitions_are_bounded_by_the_cluster(spark):
    cores = spark.sparkContext.defaultParallelism
    assert language_model.partitions(spark, 256) == 256
    assert language_model.partitions(spark, 10**7) == max(4096, 2 * cores)


def test_many_ranges_share_partitions(docs, monkeypatch):
    wide = {r["doc_id"]: r["score"] for r in language_model.score(docs, block=2_000, entries=200).collect()}
    monkeypatch.setattr(language_model, "partitions", lambda spark, wanted: min(wanted, 3))
    narrow = {r["doc_id"]: r["score"] for r in language_model.score(docs, block=2_000, entries=200).collect()}
    assert wide.keys() == narrow.keys() and all(math.isclose(narrow[k], v, rel_tol=1e-9) for k, v in wide.items())


def test_weights_follow_the_likelihood():
    cells = [(3, 4, 30, 900), (3, -1, 20, 100), (5, -1, 16, 50)]
    w = language_model.em(cells, 1_000)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[5, 1] > w[5, 0]


def test_lm_stored_blocks(docs, monkeypatch):
    """A stored block is a row group of its own once it has the bytes, so that no reader holds all blocks of a file."""
    import pyarrow.parquet as pq

    stored = {}
    monkeypatch.setattr(language_model, "materialize", lambda df, name, *a, **k: stored.setdefault(name, sharding_materialize(df, name, *a, **k)))
    monkeypatch.setattr(language_model, "GROUP", 1_000, raising=False)
    language_model.score(docs.coalesce(1), block=5_000)
    (file,) = stored["lm-blocks"].inputFiles()
    read = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert read.num_rows > 3
    assert read.num_row_groups == read.num_rows
