"""Queries on the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import graph
from docsieve.operators import stored_index as I
from docsieve.plans.registry import TERMS, query, table

_ASKED = "SELECT item_id, CASE WHEN item_id % 8 = 0 THEN (item_id * 3)::VARCHAR ELSE text END AS prompt, CASE item_id % 3 WHEN 1 THEN ['src0', 'src3', 'src7', 'src12'] WHEN 2 THEN ['src1', 'src0', 'src2', 'src4', 'src5'] END AS scope, CASE WHEN item_id % 5 = 0 THEN 'en' END AS domain FROM benchmark"
_FOUND = f"""asked AS ({_ASKED}), terms AS (SELECT item_id, unnest(list_distinct(['n:' || t for t in {TERMS.format('prompt')}] || ['x:' || prompt])) AS term FROM asked),
posted AS (SELECT doc_id, unnest(list_distinct(['n:' || t for t in {TERMS.format("coalesce(text, '')")}])) AS term, 1 AS weight FROM documents UNION ALL SELECT doc_id, 'x:' || doc_id, 100 FROM documents),
scored AS (SELECT item_id, doc_id, sum(weight)::BIGINT AS score, array_to_string(list_sort(list(term)), ' ') AS matched FROM terms JOIN posted USING (term) JOIN asked USING (item_id) JOIN documents USING (doc_id)
  WHERE (scope IS NULL OR list_contains(scope, source)) AND (domain IS NULL OR domain = lang) GROUP BY ALL)"""


def _terms(text, own):
    """The terms of a text at 1, and the id at 100."""
    words = F.transform(F.array_distinct(T.terms(F.coalesce(text, F.lit("")))), lambda t: F.struct(F.concat(F.lit("n:"), t).alias("term"), F.lit(1).alias("weight")))
    return F.concat(words, F.array(F.struct(F.concat(F.lit("x:"), own.cast("string")).alias("term"), F.lit(100).alias("weight"))))


def _index(spark, sf_dir):
    """Documents in two segments, the second appended: those of odd ids first, then the even ones."""
    documents, terms = table(spark, sf_dir, "documents"), _terms(F.col("text"), F.col("doc_id"))
    folder = f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    first = I.build(documents.filter("doc_id % 2 <> 0"), folder, entry_id="doc_id", terms=terms, attributes=["source", "lang"])
    return I.append(first, documents.filter("doc_id % 2 = 0"), entry_id="doc_id", terms=terms)


@query(f"""WITH {_FOUND} SELECT item_id, doc_id, score, matched, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, sha256(doc_id::VARCHAR))::INT AS place FROM scored QUALIFY place <= 8""")
def indexed_search(spark, sf_dir):
    """Benchmark items as questions to the stored index of the documents, some within four or five sources, some in English only; every eighth is a document's id."""
    asked = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id", "IF(item_id % 8 = 0, string(item_id * 3), text) AS prompt", "CASE item_id % 3 WHEN 1 THEN array('src0', 'src3', 'src7', 'src12') WHEN 2 THEN array('src1', 'src0', 'src2', 'src4', 'src5') END AS scope", "IF(item_id % 5 = 0, 'en', NULL) AS domain",
    )
    words = F.transform(T.terms(F.coalesce("prompt", F.lit(""))), lambda t: F.concat(F.lit("n:"), t))
    allowed = F.expr("(scope IS NULL OR array_contains(scope, source)) AND (domain IS NULL OR domain = lang)")
    terms = F.concat(words, F.array(F.concat(F.lit("x:"), F.coalesce("prompt", F.lit("")))))
    found = I.search(_index(spark, sf_dir), asked, query_id="item_id", terms=terms, limit=8, allowed=allowed)
    return found.select(F.col("query_id").alias("item_id"), F.col("entry_id").alias("doc_id"), "score", F.array_join("matched", " ").alias("matched"), "place")


@query(f"""SELECT term, count(*) AS n, max(weight) AS most FROM (SELECT unnest(list_distinct(['n:' || t for t in {TERMS.format("coalesce(text, '')")}])) AS term, 1 AS weight FROM documents UNION ALL SELECT 'x:' || doc_id, 100 FROM documents) GROUP BY 1""")
def index_terms(spark, sf_dir):
    """How many documents have each term, after both segments are merged into one."""
    return I.merged(_index(spark, sf_dir)).terms().select("term", "n", "most")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'extra' WHEN doc_id % 7 = 1 THEN 'changed' WHEN doc_id % 7 = 2 AND source <> 'src0' THEN 'changed' END AS problem FROM documents WHERE doc_id % 7 < 2 OR (doc_id % 7 = 2 AND source <> 'src0') UNION ALL SELECT -1 - doc_id, 'missing' FROM documents WHERE doc_id % 7 = 3""")
def index_drift(spark, sf_dir):
    """Documents that went, got a new word, moved to another source or came anew since the index was built."""
    documents = table(spark, sf_dir, "documents")
    case = F.col("doc_id") % 7
    now = documents.filter(case != 0).withColumns({"text": F.when(case == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" newword"))).otherwise(F.col("text")), "source": F.when(case == 2, F.lit("src0")).otherwise(F.col("source"))})
    now = now.unionByName(documents.filter(case == 3).withColumn("doc_id", -1 - F.col("doc_id")))
    found = I.stale(_index(spark, sf_dir), now, entry_id="doc_id", terms=_terms(F.col("text"), F.col("doc_id")))
    return found.select(F.col("entry_id").alias("doc_id"), "problem")
