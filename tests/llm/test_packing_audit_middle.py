"""Packing, filter audit and fill-in-middle against plain versions, on odd rows and whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docsieve.llm import fill_in_middle, filter_audit, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FILE = queries.PACKED_VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(FILE))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# packing


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


def held(rows, ids_of, length):
    """Pieces of known documents: every id once, CRCs right, sequences full but for the last."""
    places, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for spans, size in [*((v, length) for v in places.values()), *((v, len(ids_of[k])) for k, v in covered.items())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at <= size
    assert set(covered) == set(ids_of) and all(sum(n for _, n in v) == len(ids_of[k]) for k, v in covered.items())
    sizes = [sum(n for _, n in places[s]) for s in sorted(places)]
    assert sorted(places) == list(range(len(places))) and all(n == length for n in sizes[:-1])


def test_op11(spark, texts, library):
    df = queries.op11_packing(spark, SF)
    assert {c: t for c, t in df.dtypes} == {c: "bigint" for c in ("sequence_id", "doc_id", "start", "length", "doc_tokens", "offset", "ids_crc32")}
    held(df.collect(), {i: plain_ids(library, t) for i, t in texts.items()}, 1024)


@pytest.mark.parametrize(("length", "chunk", "tasks"), [(16, 7, 5), (64, 1 << 20, 40), (1024, 100, 1)])
def test_packs_cross_tasks_and_chunks(odd, library, length, chunk, tasks):
    known = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(tasks).persist()
    out = packing.pack(known, FILE, length=length, chunk=chunk)
    ids_of = {r["doc_id"]: plain_ids(library, r["text"]) for r in known.collect()}
    held(packing.pieces(out).collect(), ids_of, length)
    for r in packing.token_ids(out, FILE).collect():
        flat = [i for p in r["pieces"] for i in ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]]]
        assert r["ids"] == flat and len(flat) == r["n"]
    known.unpersist()


def test_packs_repeated_rows_and_nothing(odd, nothing, library):
    rows = packing.pieces(packing.pack(odd, FILE, length=32)).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(library, r["text"])) for r in odd.collect())
    assert sum(r["start"] == 0 and r["doc_id"] == 4 for r in rows) == 3
    assert packing.pack(nothing, FILE).count() == 0


def test_encoder_is_the_library(library):
    own = packing.Encoder(public_tokenizers.path(FILE))
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b\n", "\n\n a", "a\n\n  b \n", "don't 's  'll x", "12 345,6", "é  ñ 漢字 かな　x y", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>b", "x" * 300 + " " + "y" * 90 + " z", "\t\ta b\x0bc \x1c d", "🙂 🙂🙂 a", "a" + " " * 70 + "b c"]
    texts += [a + s + b for a in ("x", "x.", "9", "\n", "é") for s in (" ", "  ", " \n", "\n ", "  ") for b in ("y", "'s", "", "\n", "7")]
    for _ in range(2):  # as new words and as known ones
        assert [np.frombuffer(x, own.type).tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.plain


# filter audit


def plain_measures(text):
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text))


def plain_audit(rows, labels):
    """rows: (id, part, text); labels: (id, quality, toxic)."""
    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, part, text in rows:
        text = text or ""
        words, distinct, capitals, symbols, points = plain_measures(text)
        fails = {f for f, x in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0, i is not None and i > least[text]), strict=True) if x}
        parts[part or ""].append((fails, i in good, i in bad))
    out = []
    for part, docs in parts.items():
        own, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                own.append((part, order, step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in own]
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 1), (6, 0, 1), (7, 1, None), (7, 0, 1), (9, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, labels)
    expected = plain_audit([(r["doc_id"], r["source"], r["text"]) for r in odd.collect()], [tuple(r) for r in labels.collect()])
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(expected)


def test_audit_of_nothing_and_of_one_group(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, labels).count() == 0
    same = spark.range(600).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one same text', concat('other ', id)) AS text", "if(id % 2 = 0, null, 'b') AS source").repartition(6)
    got = filter_audit.audit(same, labels)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(plain_audit([(r["doc_id"], r["source"], r["text"]) for r in same.collect()], []))


@pytest.mark.parametrize("values", [None, np.zeros(256, dtype=np.uint64)])
def test_measures_verify_hashes(odd, monkeypatch, values):
    if values is not None:  # all hashes agree
        monkeypatch.setattr(filter_audit, "_VALUE", values)
    texts = [(r["text"] or "")[:3_000] for r in odd.collect()] + ["Ab ab AB ab ba  Ba\n", "", " é É é ", "x"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    found = filter_audit.measures(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    assert [tuple(r) for r in found.tolist()] == list(map(plain_measures, texts))
    for piece in (1, 7, 1 << 20):
        assert [tuple(filter_audit.long_measures(np.frombuffer(x, dtype=np.uint8), piece).tolist()) for x in raw] == list(map(plain_measures, texts))


# fill in the middle


def plain_middle(i, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_of_odd_rows(spark, odd, nothing):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(["<S", "a <P> b", "< P>", "S> <", "x<P", ">", "<<S<M", " lead  and trail \n", "🙂 é　x  漢", "one"] * 8)], "doc_id long, text string")
    for df in (odd, extra):
        out = fill_in_middle.restore(fill_in_middle.fill_in_middle(df))
        rows = out.collect()
        assert len(rows) == df.count() and out.columns[: len(df.columns)] == df.columns
        for r in rows:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_middle(r["doc_id"], r["text"])
            assert r["restored"] == (r["text"] or "")
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(nothing)).count() == 0
    clash = fill_in_middle.fill_in_middle(extra.selectExpr("*", "1 AS n", "2 AS output", "3 AS Form"))
    assert clash.columns == ["doc_id", "text", "n", "output", "Form", "_n", "_form", "prefix_chars", "middle_chars", "_output"]


def test_every_form_occurs(spark, docs):
    forms = dict(fill_in_middle.fill_in_middle(docs).groupBy("form").count().collect())
    assert set(forms) == {"plain", "psm", "spm"} and forms["spm"] > forms["psm"]
