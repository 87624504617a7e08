"""The thin queries opN_<name> over whole tables, and their SQL where SQL has the words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, fill_in_middle, filter_audit, language_model, mixing, packing, quality_classifier, quality_rules, sharding, simhash, toxicity, warc
from .common import id_remainder, materialize, utf8_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED_VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"), 8)
    return shards.select(
        "doc_id",
        (F.octet_length(utf8_bytes("text")) + 1).cast("long").alias("size"),
        F.crc32(utf8_bytes("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(audio.store_media(_table(spark, sf_dir, "documents").select("doc_id", "text")), "media", "zstd")
    clips = materialize(audio.clip_tensors(stored), "clips", "zstd")
    return audio.features(clips).select("doc_id", "n_bytes", "audio.*", "feature")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.signals(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "signals")
    return quality_rules.judge(materialize(measured, "signals")).drop("lang", "source")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("token_offsets", F.lit(-1))["end"], F.lit(0)).cast("long").alias("n_chars"),
        F.xxhash64("token_offsets").alias("offsets_hash"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(mixing.sized_documents(_table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(_table(spark, sf_dir, "pages"))
    records = warc.records(warc.read_chunks(manifest, with_data=False))
    return records.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")}).drop("record_id")


def _scored(scored: DataFrame, least: float) -> DataFrame:
    held_out = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), 0.5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.learn(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality_classifier.score(docs, model), 0.3)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(_table(spark, sf_dir, "documents"), PACKED_VOCABULARY))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid_out = fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return laid_out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_audio": op2_audio,
        "op3_quality_rules": op3_quality_rules,
        "op4_bpe": op4_bpe,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_simhash": op8_simhash,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_model": op10_language_model,
        "op11_packing": op11_packing,
        "op12_filter_audit": op12_filter_audit,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


#: The verdicts of op3, group by group: levels 2 (language and source), 1 (language) and 0 (all).
QUALITY_SQL = r"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM w, LATERAL unnest(range(1, len(w) - 6)) t(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) s(k) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w),
s AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
v AS (SELECT doc_id, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS signal, unnest([100 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_dup_lines // n_words, 1000 * n_repeat_words // n_words]) AS value FROM f WHERE NOT base_failed),
b AS (SELECT *, (value >> greatest(length(bin(value)) - 8, 0)) << greatest(length(bin(value)) - 8, 0) AS bin FROM v),
c AS (SELECT 2 AS lvl, lang, source, signal, bin, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, signal, bin, count(*) FROM b GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, signal, bin, count(*) FROM b GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, signal ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, signal) AS total FROM c),
x AS (SELECT a.lvl, a.lang, a.source, a.signal, a.bin, sum(CASE WHEN b.bin + 1 >= 256 * (a.bin + 1) THEN b.n ELSE 0 END) AS beyond FROM c a JOIN c b ON a.lvl = b.lvl AND a.signal = b.signal AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source GROUP BY ALL),
q AS (SELECT lvl, k.lang, k.source, signal, max(total)::DOUBLE AS total, min(CASE WHEN 4 * upto >= total THEN bin END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q3, min(CASE WHEN 4 * upto >= 3 * total AND total > upto AND 2 * beyond >= total - upto THEN (k.bin + 1) * 16.0::DOUBLE END) AS gap FROM k JOIN x USING (lvl, signal, bin) WHERE k.lang IS NOT DISTINCT FROM x.lang AND k.source IS NOT DISTINCT FROM x.source GROUP BY lvl, k.lang, k.source, signal),
t AS (SELECT *, CASE WHEN signal = 'word_length' AND q3 > q1 THEN (q1 - 3 * (q3 - q1))::DOUBLE END AS low, coalesce(least((CASE WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) END)::DOUBLE, gap), (CASE WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) END)::DOUBLE, gap) AS high FROM q),
d1 AS (SELECT o.lang, o.signal, coalesce(o.total / (o.total + 50) * o.low + (1 - o.total / (o.total + 50)) * a.low, o.low, a.low) AS low, coalesce(o.total / (o.total + 50) * o.high + (1 - o.total / (o.total + 50)) * a.high, o.high, a.high) AS high FROM t o JOIN t a ON o.lvl = 1 AND a.lvl = 0 AND a.signal = o.signal),
d2 AS (SELECT o.lang, o.source, o.signal, coalesce(o.total / (o.total + 50) * o.low + (1 - o.total / (o.total + 50)) * a.low, o.low, a.low) AS low, coalesce(o.total / (o.total + 50) * o.high + (1 - o.total / (o.total + 50)) * a.high, o.high, a.high) AS high FROM t o JOIN d1 a ON o.lvl = 2 AND a.lang IS NOT DISTINCT FROM o.lang AND a.signal = o.signal),
g AS (SELECT doc_id, bool_and(coalesce(value <= high, true) AND coalesce(value >= low, true)) AS good FROM v JOIN d2 ON d2.lang IS NOT DISTINCT FROM v.lang AND d2.source IS NOT DISTINCT FROM v.source AND d2.signal = v.signal GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(good, false) AS kept FROM f LEFT JOIN g USING (doc_id)"""

#: Base 32 takes five bits at a time out of the digest's hexadecimal digits.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), h AS (SELECT page_id, strlen(x) AS n, sha1(x) AS s, max(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + ((((instr('0123456789abcdef', substr(s, (5 * i // 4 + 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(s, (5 * i // 4 + 2)::BIGINT, 1)) - 1) >> (3 - 5 * i % 4)::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""


#: Each order and step against the masks of the documents; shapley is the sum over the orders.
AUDIT_SQL = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step, filter_order[step] AS f, CASE WHEN step = 1 THEN '[0]' ELSE '[' || filter_order[1:step - 1] || ']' END AS before FROM o, range(1, 6) t(step)),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT contains(fails, f) AND NOT regexp_matches(fails, before) THEN n ELSE 0 END) AS kept, sum(CASE WHEN contains(fails, f) AND NOT regexp_matches(fails, before) THEN n ELSE 0 END) AS removed, sum(CASE WHEN contains(fails, f) AND regexp_matches(fails, before) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(fails, f) AND NOT regexp_matches(fails, before) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN contains(fails, f) AND NOT regexp_matches(fails, before) THEN bad ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g"""

MIDDLE_SQL = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS i, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS j, ('0x' || d[17:24])::BIGINT % 100 AS r, ('0x' || d[25:32])::BIGINT % 100 AS q FROM u),
f AS (SELECT *, CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR r >= 50 THEN 'plain' WHEN q < 80 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(i, j)], '') AS a, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(u[greatest(i, j) + 1:], '') AS s FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || a || '<M>' || m ELSE x END) AS output_sha256, sha256(x) AS restored_sha256 FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the tests hold the others against plain versions."""
    return {"op3_quality_rules": QUALITY_SQL, "op6_warc": WARC_SQL, "op12_filter_audit": AUDIT_SQL, "op13_fill_in_middle": MIDDLE_SQL}
