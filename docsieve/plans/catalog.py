"""Queries on tokens, catalogs and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import retrieval
from docsieve.plans.registry import TERMS, query, table

# tokens


@query("""WITH t AS (SELECT doc_id, text || ' 磁场装置 x' || doc_id || ' 場' AS x FROM documents), r AS (SELECT doc_id, unnest(regexp_extract_all(x, '[㐀-鿿]+')) AS run FROM t),
g AS (SELECT doc_id, unnest(regexp_extract_all(lower(x), '[a-z][a-z0-9-]+')) AS tok FROM t
  UNION ALL SELECT doc_id, substr(run, i, 2) FROM r, range(1, 9) s(i) WHERE i < length(run) UNION ALL SELECT doc_id, substr(run, i, 3) FROM r, range(1, 9) s(i) WHERE i + 1 < length(run))
SELECT doc_id, count(DISTINCT tok)::INT AS n_tokens, sha256(array_to_string(list_sort(list(DISTINCT tok)), ' ')) AS tokens_sha256 FROM g GROUP BY 1""")
def natural_tokens(spark, sf_dir):
    """Words and the two and three character pieces of a run of Han characters, which each document gets."""
    found = T.natural_tokens(F.concat("text", F.lit(" 磁场装置 x"), "doc_id", F.lit(" 場")))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    return rows.select("doc_id", F.size("found").alias("n_tokens"), F.sha2(F.array_join("found", " "), 256).alias("tokens_sha256"))


@query("""WITH t AS (SELECT p_partkey, lower(p_name || '_' || p_brand) || ' ＡＢ 磁' AS x, p_partkey % 2 = 0 AS more FROM part),
g AS (SELECT p_partkey, unnest(regexp_extract_all(x, '[a-z0-9_]+')) AS tok FROM t UNION SELECT p_partkey, 'ab' FROM t UNION SELECT p_partkey, '磁场' FROM t WHERE more UNION SELECT p_partkey, '场磁' FROM t WHERE more)
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT tok)), ' ') AS tokens FROM g GROUP BY 1""")
def composite_tokens(spark, sf_dir):
    """Words with underscores, wide letters folded, and the bigrams of all Han characters whatever stands between."""
    text = F.concat("p_name", F.lit("_"), "p_brand", F.lit(" ＡＢ 磁"), F.when(F.col("p_partkey") % 2 == 0, " 场 x 磁").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", T.wide_fold(text).alias("x")).select("p_partkey", T.composite_tokens(F.col("x")).alias("found"))
    return rows.select("p_partkey", F.array_join(F.array_sort(F.array_except("found", F.array(F.lit("x")))), " ").alias("tokens"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(forms)), '|') AS forms FROM (SELECT p_partkey,
  CASE WHEN p_partkey % 5 = 0 THEN ['磁场' || lower(p_name[1]) || '7'] WHEN p_partkey % 5 = 1 THEN CASE WHEN length(lower(p_type)) >= 3 THEN [lower(p_type)] ELSE [] END
  ELSE list_filter([array_to_string(w, ' '), w[1] || ' ' || w[2], w[2] || ' ' || w[3], w[1] || ' ' || w[2] || ' ' || w[3]], lambda f: f IS NOT NULL AND (f = array_to_string(w, ' ') OR NOT contains(' ' || f || ' ', ' field '))) END AS forms
FROM (SELECT *, list_filter([split_part(lower(p_name), ' ', 1), split_part(lower(p_name), ' ', 2), 'field'], lambda x: length(x) >= 3) AS w FROM part))""")
def surface_phrases(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("磁场 "), F.substring("p_name", 1, 1), F.lit(" 7"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("The  "), "p_type", F.lit(" of an"))).otherwise(F.concat("p_name", F.lit(" of a field")))
    return table(spark, sf_dir, "part").select("p_partkey", T.wide_fold(text).alias("x")).select("p_partkey", F.array_join(T.surface_forms(F.col("x")), "|").alias("forms"))


@query("""WITH g AS (SELECT * FROM (VALUES ('metal', ['standard', 'promo']), ('cheap', ['economy'])) v(name, aliases))
SELECT p_partkey, coalesce(array_to_string(list_sort(list(name)), ','), '') AS groups FROM part LEFT JOIN g ON list_contains(aliases, lower(p_type)) GROUP BY 1""")
def alias_groups(spark, sf_dir):
    """Parts by the alias groups that their type's surface forms meet: the alias table is exploded and joined."""
    rows = spark.createDataFrame([("metal", "Standard"), ("metal", "PROMO"), ("cheap", "economy")], "name string, alias string")
    forms = lambda df, key, c, each: df.select(key, T.wide_fold(F.col(c)).alias("x")).select(key, each(T.surface_forms(F.col("x"))).alias("form"))
    aliases = forms(rows, "name", "alias", F.explode).distinct()
    parts = forms(table(spark, sf_dir, "part"), "p_partkey", "p_type", F.explode_outer)
    return parts.join(F.broadcast(aliases), "form", "left").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("groups"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*')[1:5], '|') AS first_words, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*'))::INT AS n_words FROM documents""")
def word_tokens(spark, sf_dir):
    words = F.regexp_extract_all(T.verbatim_forms(F.col("text"))["words"], F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(F.slice("w", 1, 5), "|").alias("first_words"), F.size("w").alias("n_words"))


@query("""SELECT doc_id, CASE WHEN k = 0 THEN '17' WHEN k = 1 THEN '23' WHEN k = 2 THEN '45' WHEN k = 3 THEN '6' END AS label FROM (SELECT doc_id, (doc_id % 5)::INT AS k FROM documents)""")
def page_labels(spark, sf_dir):
    """Printed page numbers: alone at the foot, before or after the head line, after the last line, or none."""
    k, body = F.col("doc_id") % 5, F.lit("Body a\nBody b\nBody c\nBody d\nBody e\nBody f\n")
    page = F.when(k == 0, F.concat(F.lit("9 Head\n"), body, F.lit(" 17 \n"))).when(k == 1, F.concat(F.lit(" 23  Head\n"), body)).when(k == 2, F.concat(F.lit("Head 45\r\n"), body)).when(k == 3, F.concat(F.lit("Head 2026\n"), body, F.lit("Foot\t6"))).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", T.printed_page_label(page).alias("label"))


# catalogs

_PROMPTS = "SELECT s_suppkey AS query_id, 'Which ' || p_name || ' or ' || p_type || ' of ' || CASE WHEN s_suppkey % 3 = 0 THEN 'obj-' || p_partkey ELSE 'it' END || CASE WHEN s_suppkey % 4 = 0 THEN ' against Brand 3 and dispute' ELSE '' END AS prompt FROM supplier JOIN part ON p_partkey = s_suppkey * 7 % 100"
_ENTRIES = "SELECT 'obj-' || p_partkey AS entry_id, p_name AS title, p_type AS statement, p_brand || '_x ' || p_size AS formula, [p_brand, 'size ' || p_size] AS assumptions, p_type || ' only' AS valid_when, p_brand AS fails_when, p_name || ' use' AS applicability FROM part"
_POSTED = f"""asked AS ({_PROMPTS}), e AS ({_ENTRIES}), terms AS (SELECT DISTINCT query_id, unnest({TERMS.format('prompt')}) AS term FROM asked),
posted AS (SELECT entry_id, term, max(weight) AS weight FROM (SELECT entry_id, unnest({TERMS.format('title')}) AS term, 12 AS weight FROM e UNION ALL SELECT entry_id, unnest({TERMS.format('statement')}), 6 FROM e
  UNION ALL SELECT entry_id, unnest({TERMS.format('formula')}), 8 FROM e UNION ALL SELECT entry_id, unnest({TERMS.format("array_to_string(assumptions, ' ')")}), 3 FROM e
  UNION ALL SELECT entry_id, unnest({TERMS.format('valid_when')}), 3 FROM e UNION ALL SELECT entry_id, unnest({TERMS.format('fails_when')}), 4 FROM e UNION ALL SELECT entry_id, unnest({TERMS.format('applicability')}), 2 FROM e) GROUP BY ALL),
scored AS (SELECT query_id, entry_id, sum(points) AS score FROM (SELECT query_id, entry_id, weight AS points FROM posted JOIN terms USING (term)
  UNION ALL SELECT query_id, entry_id, 1000 FROM asked, e WHERE contains(lower(prompt), lower(entry_id)) UNION ALL SELECT query_id, entry_id, 80 FROM asked, e WHERE contains(lower(prompt), lower(title))) GROUP BY ALL)"""


def _catalog(spark, sf_dir):
    """Prompts of suppliers, and parts as objects of a catalog."""
    entries = table(spark, sf_dir, "part").selectExpr(
        "concat('obj-', p_partkey) AS entry_id", "p_name AS title", "p_type AS statement", "concat(p_brand, '_x ', p_size) AS formula", "array(p_brand, concat('size ', p_size)) AS assumptions",
        "concat(p_type, ' only') AS valid_when", "p_brand AS fails_when", "concat(p_name, ' use') AS applicability", "p_partkey", "p_brand", "p_size",
    )
    said = "concat('Which ', p_name, ' or ', p_type, ' of ', IF(s_suppkey % 3 = 0, concat('obj-', p_partkey), 'it'), IF(s_suppkey % 4 = 0, ' against Brand 3 and dispute', '')) AS prompt"
    asked = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.expr("p_partkey = s_suppkey * 7 % 100")).selectExpr("s_suppkey AS query_id", said)
    return asked, entries


def _objects(entries):
    """What a search in the objects of a catalog takes: their postings, ids and titles."""
    names = lambda c: entries.select("entry_id", F.col(c).alias("name"))
    return {"posted": retrieval.object_postings(entries, "entry_id", retrieval.OBJECT_WEIGHTS), "ids": names("entry_id"), "titles": names("title")}


@query(f"WITH {_POSTED} SELECT entry_id, term, weight::INT AS weight FROM posted")
def object_terms(spark, sf_dir):
    """The terms of all seven fields of an object, each with its largest weight."""
    return _objects(_catalog(spark, sf_dir)[1])["posted"]


@query(f"""WITH {_POSTED} SELECT query_id, entry_id, score::BIGINT AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place
FROM scored JOIN (SELECT query_id, max(score) AS best FROM scored GROUP BY 1) USING (query_id) WHERE score >= greatest(12, (best * 30 + 99) // 100)) WHERE place <= 8""")
def object_query(spark, sf_dir):
    asked, entries = _catalog(spark, sf_dir)
    return retrieval.catalog_hits(asked, **_objects(entries), query_id="query_id", prompt="prompt", limit=8)


@query(f"""WITH {_POSTED}, c AS (SELECT 'con-' || p_partkey AS conflict_id, 'dispute against ' || p_brand || ' and brand' AS topic, 'obj-' || p_partkey AS claim FROM part WHERE p_size = 7),
ct AS (SELECT DISTINCT conflict_id, unnest({TERMS.format('topic')}) AS term FROM c),
own AS (SELECT query_id, conflict_id FROM ct JOIN terms USING (term) GROUP BY ALL HAVING 12 * count(*) >= 48)
SELECT query_id, conflict_id FROM own UNION SELECT query_id, conflict_id FROM scored JOIN c ON claim = entry_id WHERE score >= 80 UNION SELECT query_id, conflict_id FROM asked, c WHERE contains(lower(prompt), lower(claim))""")
def catalog_conflicts(spark, sf_dir):
    """Conflicts that a prompt brings up: by topic, by a strong claim or by a claim's id. Equal prompts are looked at once, and only claims are scored."""
    asked, entries = _catalog(spark, sf_dir)
    asked, texts = retrieval.by_prompt(asked, "query_id", "prompt")
    scored = retrieval.catalog_scores(texts, **_objects(entries.filter("p_size = 7")), query_id="query_id", prompt="prompt")
    disputed = entries.filter("p_size = 7").selectExpr("concat('con-', p_partkey) AS conflict_id", "concat('dispute against ', p_brand, ' and brand') AS topic", "entry_id AS claim_id")
    topics = retrieval.object_postings(disputed, "conflict_id", retrieval.CONFLICT_WEIGHTS)
    own = retrieval.scores(texts, topics, query_id="query_id", prompt="prompt")
    found = retrieval.triggered(texts, scored, own, disputed.select("conflict_id", "claim_id"), query_id="query_id", prompt="prompt")
    return retrieval.for_all(asked, found)


@query(f"""WITH {_POSTED}, g AS (SELECT 'gap-' || p_partkey AS gap_id, p_name || ' ' || p_type || ' against brand' AS statement FROM part WHERE p_size = 11), gt AS (SELECT DISTINCT gap_id, unnest({TERMS.format('statement')}) AS term FROM g)
SELECT query_id, gap_id, (10 * count(*))::BIGINT AS score FROM gt JOIN terms USING (term) GROUP BY ALL HAVING 10 * count(*) >= 30""")
def catalog_gaps(spark, sf_dir):
    """Gaps whose statement has three terms of a prompt or more. Equal prompts are looked at once."""
    asked, entries = _catalog(spark, sf_dir)
    asked, texts = retrieval.by_prompt(asked, "query_id", "prompt")
    gaps = entries.filter("p_size = 11").select(F.concat(F.lit("gap-"), "p_partkey").alias("gap_id"), F.concat_ws(" ", "title", F.col("statement"), F.lit("against brand")).alias("statement"))
    scored = retrieval.scores(texts, retrieval.object_postings(gaps, "gap_id", retrieval.GAP_WEIGHTS), query_id="query_id", prompt="prompt")
    return retrieval.for_all(asked, scored.filter(F.col("score") >= retrieval.GAP_SCORE).select("query_id", F.col("entry_id").alias("gap_id"), "score"))


@query(f"""WITH e AS (SELECT c_custkey AS entry_id, replace(c_name, 'Customer#', 'C') AS title FROM customer), t AS (SELECT entry_id, unnest(list_distinct({TERMS.format('title')})) AS term FROM e),
s AS (SELECT q.entry_id AS query_id, e.entry_id, 12 * count(*) + CASE WHEN q.entry_id = e.entry_id THEN 80 ELSE 0 END AS score FROM t q JOIN t e USING (term) GROUP BY q.entry_id, e.entry_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id)::INT AS place FROM s)
SELECT entry_id AS c_custkey, place FROM h WHERE query_id = entry_id AND place <= 8""")
def runtime_self_check(spark, sf_dir):
    """Each entry's own title as a prompt has to find it; every title has a word of its own, so the entry comes first."""
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), F.regexp_replace("c_name", "Customer#", "C").alias("title"), "c_custkey")
    posted = retrieval.postings(entries, "entry_id", {"title": 12})
    names = entries.select("entry_id", F.col("title").alias("name"))
    scored = retrieval.catalog_scores(entries, posted, ids=names.limit(0), titles=names, query_id="entry_id", prompt="title")
    return retrieval.self_check(entries.select("c_custkey"), retrieval.top_hits(scored, 8), entry_id="c_custkey")


@query("""WITH q AS (SELECT s_suppkey AS query_id, 'Compare ' || lower(p_name) || 'x and ' || CASE WHEN s_suppkey % 2 = 0 THEN 'M' || p_partkey || '.' ELSE '' END AS prompt FROM supplier JOIN part ON p_partkey = s_suppkey * 3 % 100),
p AS (SELECT DISTINCT 'm' || p_size AS package, unnest(string_split(lower(p_name), ' ')) AS term, 5 AS weight FROM part),
s AS (SELECT query_id, package, sum(weight) AS score FROM q, p WHERE contains(lower(prompt), term) OR list_contains(regexp_extract_all(lower(prompt), '[a-z0-9_]+'), term) GROUP BY ALL
  UNION ALL SELECT query_id, package, 200 FROM q, (SELECT DISTINCT package FROM p) WHERE contains(lower(prompt), package))
SELECT query_id, package, sum(score)::BIGINT AS score FROM s GROUP BY ALL""")
def composite_search(spark, sf_dir):
    """Modules of parts of one size, scored by terms inside the prompt, by shared tokens and by the module's id."""
    asked = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.expr("p_partkey = s_suppkey * 3 % 100"))
    asked = asked.selectExpr("s_suppkey AS query_id", "concat('Compare ', lower(p_name), 'x and ', IF(s_suppkey % 2 = 0, concat('M', p_partkey, '.'), '')) AS prompt")
    package = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_size").alias("entry_id"), F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct().withColumn("weight", F.lit(5))
    ids = package.select("entry_id", F.col("entry_id").alias("name")).distinct()
    return retrieval.composite_scores(asked, package, ids, query_id="query_id", prompt="prompt").withColumnRenamed("entry_id", "package")


@query("""WITH e AS (SELECT c_custkey AS entry_id, lower(c_mktsegment) AS word, n_name AS kind FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0),
q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'household' WHEN 3 THEN 'automobile' ELSE 'none' END AS word, s_suppkey % 7 = 0 AS has_glyph FROM supplier),
s AS (SELECT query_id, entry_id, (CASE WHEN q.word = e.word THEN 1 ELSE 0 END + CASE WHEN has_glyph AND entry_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_natural, (CASE WHEN has_glyph AND entry_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_math FROM q, e)
SELECT query_id, entry_id, n_natural, n_math, n_natural + 4 * n_math AS score, row_number() OVER (PARTITION BY query_id ORDER BY n_natural + 4 * n_math DESC, sha256(entry_id::VARCHAR))::INT AS place
FROM s WHERE n_natural + n_math > 0 QUALIFY place <= 8""")
def science_search(spark, sf_dir):
    """Customers in the black by their segment and, for every tenth, a formula's glyph (whose command is a word as well)."""
    entries = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, r" \mathbf{B}").otherwise("")).alias("text"))
    word = "CASE s_suppkey % 5 WHEN 0 THEN 'Building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'Household' WHEN 3 THEN 'automobile' ELSE 'none' END"
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.expr(word), F.when(F.col("s_suppkey") % 7 == 0, r", \mathbf{B}?").otherwise("")).alias("prompt"))
    return retrieval.science_search(asked, entries, query_id="s_suppkey", prompt="prompt", entry_id="c_custkey", text="text", limit=8)


@query(f"""SELECT conv_id, turn, contains(lower(coalesce(text, '')), 'should i') OR contains(lower(coalesce(text, '')), 'ing th') AS blocked, NOT list_has_any({TERMS.format("coalesce(text, '')")}, ['wast', 'hean', 'thou', 'nder']) AS collision_free FROM conversations""")
def guarded_prompts(spark, sf_dir):
    said = F.coalesce("text", F.lit(""))
    own = retrieval.guarded(said, ["should i", "ing th"], ["wast", "hean"], ["thou", "nder"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", own["blocked"].alias("blocked"), own["collision_free"].alias("collision_free"))
