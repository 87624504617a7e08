"""Queries on metrics, coverage, conditions and the state of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.functions import predicates as P
from docsieve.functions import text as T
from docsieve.functions import units as U
from docsieve.operators import assessment as A
from docsieve.operators import changes, graph
from docsieve.plans.registry import query, table
from docsieve.streaming import incremental

# metrics

_MATCHES = "SELECT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS g, CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS p, l_discount * 10 AS iou FROM lineitem"


def _matches(spark, sf_dir):
    """Line items as objects: those returned have no gold, those accepted no prediction."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("gold_id"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("predicted_id"), (F.col("l_discount") * 10).alias("iou"))


@query(f"""WITH c AS (SELECT l_suppkey, count(g) AS n_g, count(p) AS n_p, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL AND iou >= 0.5) AS tp, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS k, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL AND round(iou, 6) >= 0.5) AS o,
  round(avg(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN round(iou, 6) END), 6) AS m FROM ({_MATCHES}) GROUP BY 1), r AS (SELECT *, CASE WHEN n_p > 0 THEN tp / n_p WHEN n_g = 0 THEN 1 ELSE 0 END AS pr, CASE WHEN n_g > 0 THEN tp / n_g WHEN n_p = 0 THEN 1 ELSE 0 END AS re FROM c)
SELECT l_suppkey, round(pr, 6) AS precision, round(re, 6) AS recall, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) ELSE 0 END AS f1, coalesce(m, 0) AS bbox_iou_mean, CASE WHEN k > 0 THEN round(o / k, 6) ELSE 0 END AS bbox_iou_ge_threshold,
  tp AS true_positive, n_p - tp AS false_positive, n_g - tp AS false_negative FROM r""")
def object_metrics(spark, sf_dir):
    return A.object_metrics(_matches(spark, sf_dir), ["l_suppkey"], 0.5)


@query(f"SELECT l_suppkey, least(0.9::DOUBLE, greatest(0.5::DOUBLE, coalesce(nullif(avg(iou), 0), 0.75::DOUBLE))) AS threshold FROM (SELECT l_suppkey, iou * CASE WHEN l_suppkey % 3 = 0 THEN 0 WHEN l_suppkey % 3 = 1 THEN 0.5::DOUBLE ELSE 1.4::DOUBLE END AS iou FROM ({_MATCHES})) GROUP BY 1")
def iou_thresholds(spark, sf_dir):
    """Calibrated thresholds, of which some come from means of 0, some are held at the lower bound."""
    factor = F.when(F.col("l_suppkey") % 3 == 0, 0.0).when(F.col("l_suppkey") % 3 == 1, 0.5).otherwise(1.4)
    return A.iou_threshold(_matches(spark, sf_dir).withColumn("iou", F.col("iou") * factor), ["l_suppkey"], "iou")


_GRID = "SELECT l_suppkey AS page, l_partkey AS t, l_linenumber AS r, (l_quantity % 3)::INT AS c, l_linestatus AS s, min(l_returnflag) AS x FROM lineitem GROUP BY ALL"


@query(f"""WITH p AS (SELECT page, t, r, c, CASE WHEN r % 5 = 0 THEN x || '!' ELSE x END AS x FROM ({_GRID}) WHERE s = 'O'), g AS (SELECT page, t, r, c, x FROM ({_GRID}) WHERE s = 'O' AND t % 7 <> 0 AND NOT (t % 5 = 0 AND r = 1)),
s AS (SELECT page, t, count(*) AS n FROM p JOIN g USING (page, t, r, c, x) GROUP BY ALL), a AS (SELECT page, t, count(DISTINCT r) AS rp, count(DISTINCT c) AS cp, count(*) AS np FROM p GROUP BY ALL), b AS (SELECT page, t, count(DISTINCT r) AS rg, count(DISTINCT c) AS cg, count(*) AS ng FROM g GROUP BY ALL),
o AS (SELECT page, count(ng) AS g, count(np) AS p, count(*) FILTER (rp = rg AND cp = cg AND np = ng AND coalesce(n, 0) = ng) AS e, count(*) FILTER (rp = rg AND cp = cg) AS sh, coalesce(sum(n), 0) AS h, coalesce(sum(ng), 0) AS cells FROM a FULL JOIN b USING (page, t) LEFT JOIN s USING (page, t) GROUP BY 1)
SELECT page, CASE WHEN g > 0 THEN round(e / g, 6) WHEN p = 0 THEN 1 ELSE 0 END AS structure_exact, CASE WHEN g > 0 THEN round(sh / g, 6) WHEN p = 0 THEN 1 ELSE 0 END AS row_column_topology_exact, CASE WHEN cells > 0 THEN round(h / cells, 6) WHEN p = 0 THEN 1 ELSE 0 END AS cell_exactness FROM o""")
def table_metrics(spark, sf_dir):
    """Grids of parts on pages of suppliers; the prediction errs in every fifth row, the gold lacks some tables and rows."""
    cells = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("t"), F.col("l_linenumber").alias("row"), (F.col("l_quantity") % 3).cast("int").alias("col")).agg(F.min("l_returnflag").alias("text"))
    predicted = cells.withColumn("text", F.when(F.col("row") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit(" "), F.lower("text"))))
    return A.table_metrics(predicted, cells.filter("t % 7 <> 0 AND NOT (t % 5 = 0 AND row = 1)"), ["page"], "t")


@query("""WITH t AS (SELECT p_partkey, 'value_candidate:' || p_size AS token FROM part UNION ALL SELECT p_partkey, 'unit_candidate:' || lower(p_type) FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'number:' || p_size FROM part UNION ALL SELECT p_partkey, 'number:' || regexp_extract(p_brand, '[0-9]+') FROM part UNION ALL SELECT p_partkey, 'number:-2.5' FROM part)
SELECT token, count(*) AS n FROM t GROUP BY 1""")
def typed_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("value"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("unit"), F.lit(" ").alias("symbol"), F.concat("p_size", F.lit(" of "), F.translate("p_brand", "#", " "), F.lit(" at -2.5 x")).alias("text"))
    return A.typed_tokens(rows, ["p_partkey"]).groupBy("token").agg(F.count("*").alias("n"))


@query("""SELECT l_shipmode, CASE WHEN p > 0 THEN round(h / p, 6) END AS precision, CASE WHEN g > 0 THEN round(h / g, 6) END AS recall, CASE WHEN p + g > 0 THEN round(2 * h / (p + g), 6) END AS f1, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode,
count(*) FILTER (l_tax > 0.02 AND l_discount > 0.03) AS h, count(*) FILTER (l_discount > 0.03) AS p, count(*) FILTER (l_tax > 0.02) AS g, count(*) AS n FROM lineitem GROUP BY 1)""")
def presence_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus"))
    return A.presence(rows, ["l_shipmode"], F.col("l_tax") > 0.02, F.col("l_discount") > 0.03)


@query("SELECT o_orderpriority, round(avg(CASE WHEN g IS NULL AND p IS NULL THEN NULL WHEN g IS NOT DISTINCT FROM p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS exactness FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS g, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE o_orderstatus END END AS p FROM orders) GROUP BY 1")
def exactness(spark, sf_dir):
    k = F.col("o_orderkey")
    gold, said = F.when(k % 3 > 0, F.col("o_orderstatus")), F.when(k % 4 > 0, F.when(k % 5 == 0, "?").otherwise(F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(A.exactness(gold, said)), 6).alias("exactness"))


@query("SELECT p_brand, (2 * count(*))::BIGINT AS words, count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0) AS distance, round((count(*) FILTER (p_size % 2 = 0) + count(*) FILTER (p_size % 3 = 0)) / (2 * count(*)), 6) AS wer FROM part GROUP BY 1")
def word_errors(spark, sf_dir):
    """Names of two words, of which some lose the last and some get another before."""
    said = F.concat(F.when(F.col("p_size") % 3 == 0, "zzz ").otherwise(""), F.when(F.col("p_size") % 2 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise(F.concat_ws("\t", F.split("p_name", " "))))
    return A.word_errors(table(spark, sf_dir, "part").select("p_brand", "p_name", said.alias("said")), ["p_brand"], "p_name", "said")


@query("SELECT p_type, (2 * count(*))::BIGINT AS tokens, (count(*) + count(*) FILTER (p_size % 2 = 0))::BIGINT AS hits, round((count(*) + count(*) FILTER (p_size % 2 = 0)) / (2 * count(*)), 6) AS accuracy FROM part GROUP BY 1")
def numeric_accuracy(spark, sf_dir):
    gold = F.concat(F.lit("size "), "p_size", F.lit(", price 1.5"))
    said = F.concat(F.lit("size "), "p_size", F.when(F.col("p_size") % 2 == 0, ": price 1.5").otherwise(": price 1.50"))
    return A.numeric_accuracy(table(spark, sf_dir, "part").select("p_type", gold.alias("gold"), said.alias("said")), ["p_type"], "gold", "said")


@query("""WITH p AS (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - CASE WHEN i % 5 = 0 THEN a.embedding[i]::DOUBLE ELSE b.embedding[i]::DOUBLE END)) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2)
SELECT vec_id, round(list_sum(e) / len(e), 6) AS mae, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rmse, round(list_max(e), 6) AS max_error, round(len(list_filter(range(0, len(e) // 4), lambda i: list_sum(e[i * 4 + 1:i * 4 + 4]) > 0)) / (len(e) // 4), 6) AS changed_ratio FROM p""")
def pixel_errors(spark, sf_dir):
    """Vectors as images of four channels, each against that of half its number with every fifth value kept."""
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select(F.floor(F.col("vec_id") / 2).alias("half"), "vec_id", F.col("embedding").alias("own")).join(rows.select(F.col("vec_id").alias("half"), F.col("embedding").alias("e")), "half")
    mixed = other.select("vec_id", F.zip_with(F.transform("own", lambda x, i: F.when((i + 1) % 5 == 0, x)), "e", lambda a, b: F.coalesce(a, b)).alias("embedding"))
    return A.pixel_errors(rows, mixed, "vec_id", "embedding", 4)


@query("""SELECT 'c' || l_returnflag AS layer, count(*) AS planned, count(*) FILTER (s IN ('passed', 'failed')) AS executed, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'blocked') AS blocked, count(*) FILTER (s IS NULL) AS not_run
FROM (SELECT l_returnflag, CASE (l_orderkey % 5) WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'blocked' END AS s FROM lineitem) GROUP BY 1""")
def layer_counts(spark, sf_dir):
    """Every line item as a case; orders of four in five residues have results."""
    cases = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("c"), "l_returnflag").alias("layer"))
    status = F.element_at(F.array(*map(F.lit, ("passed", "failed", "skipped", "blocked"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    results = table(spark, sf_dir, "orders").filter("o_orderkey % 5 < 4").select(F.col("o_orderkey").alias("l_orderkey"), status.alias("status"))
    return A.layer_counts(cases, results, case="l_orderkey", layer="layer", status="status")


@query("""WITH c AS (SELECT count(*) FILTER (l_linestatus = 'O') AS n, least(count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R'), count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A'), count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'Z')) AS m FROM lineitem)
SELECT n AS n_blind, m AS least, 'blind_minimum_100_and_20_per_category_required' AS reasons FROM c""")
def blind_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("split", F.when(F.col("l_linestatus") == "O", "blind").otherwise("open"))
    return A.blind_gates(rows, category="l_returnflag", split="split", categories=["R", "A", "Z"])


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, count(*) FILTER (l_linenumber BETWEEN 1 AND 3) AS f, count(*) FILTER (l_quantity > 10) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n <> 3 OR d <> 3 OR f <> 3 THEN 'incomplete' WHEN p = 3 THEN 'passed' ELSE 'failed' END AS state, coalesce(p, 0) AS passed FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def certification(spark, sf_dir):
    """Orders as challenges that want attempts 1 to 3, their lines as receipts."""
    receipts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 10).alias("ok"))
    return A.certification(table(spark, sf_dir, "orders"), receipts, challenge="o_orderkey", attempts=3)


@query("SELECT l_suppkey, count(DISTINCT l_linestatus) = 1 AS deterministic, count(*) AS checked FROM lineitem GROUP BY 1")
def build_determinism(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count_distinct("l_linestatus") == 1).alias("deterministic"), F.count("*").alias("checked"))


@query("SELECT o_orderpriority, o_orderstatus AS kind, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS false_positives FROM orders GROUP BY ALL")
def conflict_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300_000).alias("false_positives"))


# coverage and routing

_ROUTE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'conflict' WHEN '2-HIGH' THEN 'budget-exhausted' WHEN '3-MEDIUM' THEN 'manual-review' WHEN '5-LOW' THEN 'not-requested' ELSE CASE WHEN o_orderstatus = 'F' THEN 'chart-candidate' ELSE 'native' END END"


@query(f"""SELECT coverage, count(*) AS n, count(*) FILTER (coverage = 'budget-exhausted') AS gaps, count(*) FILTER (coverage IN ('candidate', 'review-required', 'conflict')) AS reviews FROM (SELECT CASE s WHEN 'manual-review' THEN 'review-required' WHEN 'chart-candidate' THEN 'candidate' WHEN 'native' THEN 'processed' ELSE s END AS coverage FROM (SELECT {_ROUTE} AS s FROM orders)) GROUP BY 1""")
def visual_coverage(spark, sf_dir):
    rows = A.visual_coverage(table(spark, sf_dir, "orders").select(F.expr(_ROUTE).alias("status")), "status")
    return rows.groupBy("coverage").agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"), F.count_if("review_required").alias("reviews"))


@query("SELECT l_suppkey, sum(l_quantity) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber, CASE WHEN sum(l_quantity) > 15000 OR sum(l_linenumber) > 2400 THEN 'budget-exhausted' ELSE 'complete' END AS status FROM lineitem GROUP BY 1")
def budget_receipts(spark, sf_dir):
    return A.budget_receipt(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"l_quantity": 15_000, "l_linenumber": 2_400})


@query("""SELECT page_id, concat_ws(',', CASE WHEN t > 0 OR r >= 1 THEN 'table' END, CASE WHEN f > 0 OR fm > 0 THEN 'figure' END, CASE WHEN h >= 2 AND r = 0 AND f > 0 THEN 'chart' END, CASE WHEN dg > 0 THEN 'diagram' END, CASE WHEN eq > 0 THEN 'equation' END) AS kinds FROM (SELECT page_id, len(regexp_extract_all(html, '<form|<nav')) AS fm, len(regexp_extract_all(html, '<(?:svg|pre|code)')) AS dg, len(regexp_extract_all(html, '<(?:math|sup|h2)')) AS eq, len(regexp_extract_all(html, '<table')) AS t, len(regexp_extract_all(html, '<tr')) AS r, len(regexp_extract_all(html, '<img')) AS f, len(regexp_extract_all(html, '<li')) AS h FROM pages)""")
def candidate_kinds(spark, sf_dir):
    """What pages hold, by counts of their marks; list items stand for line operators."""
    n = lambda mark: F.size(F.regexp_extract_all("html", F.lit(mark), F.lit(0)))
    labels = {"table": n("<table"), "diagram": n("<(?:svg|pre|code)"), "equation": n("<(?:math|sup|h2)")}
    kinds = A.candidate_kinds(labels, rows=n("<tr"), images=n("<img"), forms=n("<form|<nav"), line_ops=n("<li"), stroke_ops=F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(kinds, ",").alias("kinds"))


@query("""WITH o AS (SELECT l_orderkey, min(l_discount * 10) AS least, bool_or(l_returnflag = 'R') AS formula, bool_or(l_returnflag = 'A') AS tab, bool_or(l_linenumber = 1) AS unit FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax > 0.07)
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'manual-review-required' WHEN 'O' THEN 'ocr-candidate' ELSE 'native-text' END AS route, CASE o_orderstatus WHEN 'P' THEN 'blank-or-unusable-native-page' WHEN 'O' THEN array_to_string(list_sort(list_filter([CASE WHEN o.l_orderkey IS NULL THEN 'ocr_no_observations' END,
  CASE WHEN least < 0.2 THEN 'low_confidence' END, CASE WHEN formula THEN 'formula_visual_review_required' END, CASE WHEN formula THEN 'formula_ast_review_required' END, CASE WHEN tab THEN 'table_visual_review_required' END, CASE WHEN unit THEN 'unit_visual_review_required' END,
  CASE WHEN formula OR tab THEN 'structured_candidate_requires_visual_review' END, CASE WHEN c.l_orderkey IS NOT NULL THEN 'ocr_conflict_or_duplicate' END], lambda x: x IS NOT NULL)), ',') ELSE 'native-text-first-preserved' END AS reasons
FROM orders LEFT JOIN o ON o.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey""")
def quality_routing(spark, sf_dir):
    """Orders as pages, their lines as what OCR saw on them."""
    lines = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "Formula").when(F.col("l_returnflag") == "A", "table").otherwise("text")
    seen = lines.select("o_orderkey", kind.alias("kind"), F.when(F.col("l_linenumber") == 1, "5 kg").otherwise("5").alias("text"), (F.col("l_discount") * 10).alias("confidence"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("manual"), (F.col("o_orderstatus") == "O").alias("routed"))
    return A.quality_routing(pages, seen, lines.filter("l_tax > 0.07"), page="o_orderkey", threshold=0.2)


@query("""SELECT o_custkey, count(*) AS n_pages, CASE WHEN o_custkey % 7 = 0 THEN 'heading_resolution_required' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'ocr_candidate_review_required' WHEN bool_or(o_orderpriority = '2-HIGH') THEN 'visual_review_required' ELSE 'independent_semantic_review_required' END AS next_action FROM orders GROUP BY 1""")
def plan_summaries(spark, sf_dir):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "ocr-candidate").when(F.col("o_orderpriority") == "2-HIGH", "visual-review").otherwise("compile")
    rows = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"))
    return A.plan_summary(rows, "o_custkey", rows.filter("o_custkey % 7 = 0"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS r, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ids FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_accepted, coalesce(r, 0) AS n_reviewers, sha256(coalesce(ids, '')) AS sha256 FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def attestation_manifest(spark, sf_dir):
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "A").alias("accepted"), F.col("l_suppkey").alias("reviewer"), F.col("l_partkey").cast("string").alias("id"))
    return A.attestation_manifest(table(spark, sf_dir, "orders"), said, key="o_orderkey")


@query("""WITH l AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS e, list(DISTINCT l_returnflag) FILTER (l_linenumber > 2) AS a FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN len(list_filter(e, lambda x: NOT list_contains(coalesce(a, []), x))) > 0 OR list_contains(coalesce(a, []), 'R') THEN 'objects' ELSE '' END AS failed FROM l""")
def response_checks(spark, sf_dir):
    """An order's flags are expected, those of its later lines were answered, and R is forbidden."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("objects_expected"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))).alias("objects_actual"))
    return A.response_checks(sets.withColumn("objects_forbidden", F.array(F.lit("R"))), "k", ["objects"])


# conditions and quantities


@query("""WITH b AS (SELECT p_type, p_size % 10 AS scope, count(*) AS n, bool_and(p_retailprice > 905) AS d FROM part GROUP BY ALL)
SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND d THEN 'resolved' ELSE 'unknown' END AS status FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE 'NONE' END AS glyph FROM customer) LEFT JOIN b ON b.p_type = glyph AND b.scope = c_custkey % 10""")
def symbol_resolution(spark, sf_dir):
    bindings = table(spark, sf_dir, "part").select(F.col("p_type").alias("glyph"), (F.col("p_size") % 10).cast("long").alias("scope"), F.when(F.col("p_retailprice") > 905, F.col("p_name")).alias("definition"))
    glyph = F.when(F.col("c_custkey") % 3 == 0, "PROMO").when(F.col("c_custkey") % 3 == 1, "ECONOMY").otherwise("NONE")
    asked = table(spark, sf_dir, "customer").select("c_custkey", glyph.alias("glyph"), (F.col("c_custkey") % 10).alias("scope"))
    return A.symbols(bindings, asked, "glyph", "scope").drop("glyph", "scope")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'violated' WHEN c_acctbal < 0 THEN 'unknown' ELSE 'satisfied' END AS status,
'debt=' || CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'satisfied' END || ',segment=' || CASE WHEN c_mktsegment <> 'BUILDING' THEN 'violated' ELSE 'satisfied' END AS trace FROM customer""")
def property_conditions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    wanted = rows.select("c_custkey", F.explode(F.array(F.struct(F.lit("segment").alias("name"), F.lit("BUILDING").alias("value")), F.struct(F.lit("debt").alias("name"), F.lit("no").alias("value")))).alias("w")).select("c_custkey", "w.*")
    known = rows.select("c_custkey", F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")).unionByName(rows.filter("c_acctbal >= 0").select("c_custkey", F.lit("debt").alias("name"), F.lit("no").alias("value")))
    return A.properties(wanted, known, item="c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT a OR NOT b THEN 'violated' WHEN a IS NULL OR b IS NULL THEN 'unknown' ELSE 'satisfied' END AS outcome, 'cheap=' || CASE WHEN a THEN 'satisfied' WHEN NOT a THEN 'violated' ELSE 'unknown' END || ',taxed=' || CASE WHEN b THEN 'satisfied' WHEN NOT b THEN 'violated' ELSE 'unknown' END AS trace,
CASE WHEN coalesce(a, false) THEN '' ELSE 'cheap' END || CASE WHEN NOT coalesce(a, false) AND NOT coalesce(b, false) THEN ',' ELSE '' END || CASE WHEN coalesce(b, false) THEN '' ELSE 'taxed' END AS open_gates FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_extendedprice < 50000 END AS a, CASE WHEN l_returnflag <> 'N' THEN l_tax > 0.01 END AS b FROM lineitem)""")
def condition_sets(spark, sf_dir):
    """Two conditions with their traces, and the gates that they leave shut."""
    given = {"price": F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")), "tax": F.when(F.col("l_returnflag") != "N", F.col("l_tax"))}
    trees = {"cheap": ["lt", "price", 50000], "taxed": ["gt", "tax", 0.01]}
    shut = P.gates(**{n: P.compile_predicate(t, given) for n, t in trees.items()})
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.assess(trees, given).alias("a"), F.array_join(shut, ",").alias("open_gates"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "a.outcome", F.array_join(F.transform("a.trace", lambda t: F.concat_ws("=", t["condition"], t["outcome"])), ",").alias("trace"), "open_gates")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1500' WHEN 1 THEN '-0.25' WHEN 2 THEN NULL WHEN 3 THEN '0' WHEN 4 THEN NULL ELSE o_orderkey || '.5' END AS plain FROM orders""")
def decimal_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 6 == 0, "1.5e3").when(k % 6 == 1, "-.250").when(k % 6 == 2, "1,5").when(k % 6 == 3, "0.00").when(k % 6 == 4, " 7").otherwise(F.concat(k, F.lit(".50")))
    return table(spark, sf_dir, "orders").select("o_orderkey", A.decimal_text(said).alias("plain"))


@query("""SELECT p_partkey, CASE WHEN k < 4 THEN 'known' ELSE 'unknown' END AS status, CASE k WHEN 0 THEN 'kg=1,m=-1,s=-2' WHEN 1 THEN 'kg=1,m=2,s=-3' WHEN 2 THEN '' WHEN 3 THEN 'm=1,s=-1' END AS dimension, CASE k WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN round(1000 / 3600.0::DOUBLE, 9) END AS scale FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""")
def unit_records(spark, sf_dir):
    """Units by name: their scale and exponents from the unit grammar, joined as a table of the distinct units."""
    names = ["kPa", "J/s", "1", "km/h", "parsec"]
    records = []
    for n in names:
        try:
            scale, powers = U.parse_unit(n)
            records.append((n, "known", ",".join(f"{d}={p}" for d, p in sorted(zip(U.DIMENSIONS, powers, strict=True)) if p), round(float(scale), 9)))
        except ValueError:
            records.append((n, "unknown", None, None))
    known = spark.createDataFrame(records, "unit string, status string, dimension string, scale double")
    unit = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit")).join(F.broadcast(known), "unit").drop("unit")


# records and jobs


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 5 = 1 THEN 'incomplete' WHEN k > 50 THEN 'out_of_range' ELSE 'valid' END AS state, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'k' WHEN k > 50 THEN 'small' ELSE '' END AS failed FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)""")
def strict_json(spark, sf_dir):
    """Properties of events, of which some are cut off and some have a text for the number."""
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 5)).when(F.col("event_id") % 5 == 1, '{"k": "x"}').otherwise(F.col("props"))
    return A.strict_json(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "event_id", "raw", "k int", {"small": F.col("x.k") <= 50})


@query("""SELECT kind, id, change, CASE change WHEN 'added' THEN 'node_added' WHEN 'removed' THEN 'node_deleted' WHEN 'changed' THEN CASE kind WHEN 'page' THEN 'page_text_or_structure_changed' ELSE 'node_changed' END END AS reason FROM (
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'page' ELSE 'other' END AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'added' WHEN 'F' THEN 'changed' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'unchanged' END END AS change FROM orders)""")
def change_reasons(spark, sf_dir):
    change = F.when(F.col("o_orderstatus") == "P", "added").when(F.col("o_orderstatus") == "F", "changed").when(F.col("o_orderkey") % 3 == 0, "removed").otherwise("unchanged")
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "page").otherwise("other").alias("kind"), F.col("o_orderkey").alias("id"), change.alias("change"))
    return A.changes_by_kind(rows, {"source": "source_identity_changed", "page": "page_text_or_structure_changed"})


@query("""SELECT event_id, v IN (1, 4) AS permitted FROM (SELECT event_id, event_id % 5 AS v FROM events)""")
def permissions(spark, sf_dir):
    """Permissions that are over, hold, begin later, hold too long, or end with the hour."""
    v, at = F.col("event_id") % 5, lambda seconds: F.col("ts") + F.make_dt_interval(secs=seconds)
    issued = at(F.when(v == 2, 5).otherwise(-60))
    expires = at(F.when(v == 0, 0).when(v == 3, 3600).when(v == 4, 3540).otherwise(60))
    return table(spark, sf_dir, "events").select("event_id", A.permitted(issued, expires, F.col("ts")).alias("permitted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'blocked' WHEN n IS NULL OR n < 3 THEN 'waiting' WHEN o_orderstatus = 'P' THEN 'ready' ELSE 'complete' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'source_hash_mismatch' WHEN n IS NULL OR n < 3 THEN 'semantic_proposal_required' WHEN o_orderstatus = 'P' THEN 'review_plan_pending' ELSE 'all_gates_met' END AS code
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def job_states(spark, sf_dir):
    drafts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").join(drafts, "o_orderkey", "left")
    gates = {"source_hash_mismatch": (F.col("o_orderkey") % 4 != 0, "blocked"), "semantic_proposal_required": (F.col("n") >= 3, "waiting"), "review_plan_pending": (F.col("o_orderstatus") != "P", "ready")}
    return A.first_gate(rows, "o_orderkey", gates)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 3 = 2 THEN 'pending' ELSE 'done' END AS state, o_orderkey % 3 = 2 AS stale FROM orders""")
def resumed_work(spark, sf_dir):
    """Orders as regions: of three, one is done, one was never begun, and one was done under another binding."""
    k = F.col("o_orderkey")
    regions = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2("o_orderstatus", 256).alias("binding"))
    state = regions.filter(k % 3 != 1).select("o_orderkey", F.when(k % 3 == 2, "old").otherwise(F.col("binding")).alias("binding"), F.lit("complete").alias("status"))
    open_ones = incremental.pending(regions, state, "o_orderkey", "binding").select("o_orderkey", F.lit("pending").alias("state"))
    old = incremental.stale(state, regions, "o_orderkey", "binding").select("o_orderkey", F.lit(True).alias("stale"))
    both = regions.join(open_ones, "o_orderkey", "left").join(old, "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce("state", F.lit("done")).alias("state"), F.coalesce("stale", F.lit(False)).alias("stale"))


@query("""SELECT l_orderkey, 'do-' || min(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END) AS action FROM lineitem GROUP BY 1""")
def next_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("action_order"), F.concat(F.lit("do-"), "l_linenumber").alias("action"), F.when(F.col("l_returnflag") == "A", "complete").otherwise("open").alias("status"))
    return incremental.next_action(rows, "l_orderkey")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events"), ts="ts", key="event_type")


@query("""SELECT user_id, CASE WHEN count(*) > count(DISTINCT event_id % 400) THEN 'duplicate' WHEN bool_or(b) THEN 'out_of_order' ELSE 'ordered' END AS state FROM (SELECT *, event_id % 400 < lag(event_id % 400) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1""")
def checkpoint_order(spark, sf_dir):
    return A.runs_in_order(table(spark, sf_dir, "events").withColumn("seq", F.col("event_id") % 400), ["user_id"], ["event_id"], "seq")


@query("SELECT l_orderkey AS src, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS targets FROM lineitem GROUP BY 1")
def adjacency(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.adjacency(edges).select("src", F.array_join("targets", ",").alias("targets"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return changes.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END || p_brand || '磁' AS joined FROM (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '(' || p_brand END AS p_brand FROM part)")
def joined_fragments(spark, sf_dir):
    from_brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("("), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.join_fragments(F.array("p_name", F.lit(""), from_brand, F.lit("磁"))).alias("joined"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events QUALIFY nth <= 3""")
def first_events(spark, sf_dir):
    """A queue of three for each user: a top-k report."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", nth.alias("nth")).filter("nth <= 3")
