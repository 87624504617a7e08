"""Scores of predictions against reference data, coverage of reviews and plans, and the state of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import predicates as P
from docsieve.functions import text as T

#: What a numeric token looks like, and the kinds of routed pages by the state that routing left them in (fixed values).
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
COVERAGE = {"not-requested": "not-requested", "not-inspected-by-policy": "not-inspected-by-policy", "budget-exhausted": "budget-exhausted", "conflict": "conflict", "manual-review": "review-required", "table-candidate": "candidate", "chart-candidate": "candidate"}
#: Blind cases that an acceptance needs in all, and in each category (fixed values).
BLIND_CASES, BLIND_PER_CATEGORY = 100, 20
#: Bounds of a calibrated IoU threshold, and the one without any pair (fixed values).
LEAST_IOU, MOST_IOU, DEFAULT_IOU = 0.5, 0.9, 0.75


def rate(hits: Column, total: Column, empty: Column) -> Column:
    """hits / total to 6 places; ``empty`` (1 or 0) where there is nothing to divide by."""
    return F.when(total > 0, F.round(hits / F.nullif(total, F.lit(0)), 6)).otherwise(empty.cast("double"))


def object_metrics(matches: DataFrame, keys: list[str], least: float) -> DataFrame:
    """precision, recall, f1, bbox_iou_mean, bbox_iou_ge_threshold and the counts per key, from one row per object.

    Rows have gold_id and predicted_id (null: unmatched) and iou. Without
    predictions precision is 1 if there is no gold either, else 0; recall likewise.
    """
    paired = F.col("gold_id").isNotNull() & F.col("predicted_id").isNotNull()
    value = F.round("iou", 6)
    counted = matches.groupBy(*keys).agg(
        F.count("gold_id").alias("n_gold"), F.count("predicted_id").alias("n_predicted"), F.count_if(paired & (F.col("iou") >= least)).alias("true_positive"),
        F.count_if(paired & (value >= least)).alias("over"), F.count_if(paired).alias("pairs"), F.round(F.avg(F.when(paired, value)), 6).alias("mean"),
    )
    tp, p, g = F.col("true_positive"), F.col("n_predicted"), F.col("n_gold")
    precision = F.when(p > 0, tp / F.nullif(p, F.lit(0))).otherwise(F.when(g == 0, 1.0).otherwise(0.0))
    recall = F.when(g > 0, tp / F.nullif(g, F.lit(0))).otherwise(F.when(p == 0, 1.0).otherwise(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(0.0)
    return counted.select(
        *keys, F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.coalesce("mean", F.lit(0.0)).alias("bbox_iou_mean"),
        rate(F.col("over"), F.col("pairs"), F.lit(0)).alias("bbox_iou_ge_threshold"), tp, (p - tp).alias("false_positive"), (g - tp).alias("false_negative"),
    )


def iou_threshold(pairs: DataFrame, keys: list[str], iou: str) -> DataFrame:
    """(keys, threshold): the mean IoU of calibration pairs, kept within bounds; the default where there is none or it is 0."""
    mean = F.coalesce(F.nullif(F.avg(iou), F.lit(0.0)), F.lit(DEFAULT_IOU))
    return pairs.groupBy(*keys).agg(F.least(F.lit(MOST_IOU), F.greatest(F.lit(LEAST_IOU), mean)).alias("threshold"))


def table_metrics(predicted: DataFrame, gold: DataFrame, keys: list[str], table: str) -> DataFrame:
    """(keys, structure_exact, row_column_topology_exact, cell_exactness): grids matched by ``table``, cells by place, spans and folded text.

    Rows are cells: (keys, table, row, col, text). Numbers of rows and columns
    count as topology; a grid is exact if its cells are the same set as well.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        text = T.collapse_space(T.fold(F.coalesce("text", F.lit(""))))
        own = df.select(*keys, table, "row", "col", text.alias("text")).distinct()
        return own.withColumn(side, F.lit(1))

    shape = lambda df, n: df.groupBy(*keys, table).agg(F.countDistinct("row").alias(f"rows_{n}"), F.countDistinct("col").alias(f"cols_{n}"), F.count("*").alias(f"cells_{n}"))
    p, g = cells(predicted, "p"), cells(gold, "g")
    shared = p.join(g, [*keys, table, "row", "col", "text"]).groupBy(*keys, table).agg(F.count("*").alias("shared"))
    grids = shape(p, "p").join(shape(g, "g"), [*keys, table], "full_outer").join(shared, [*keys, table], "left")
    same_shape = F.coalesce((F.col("rows_p") == F.col("rows_g")) & (F.col("cols_p") == F.col("cols_g")), F.lit(False))
    exact = same_shape & (F.col("cells_p") == F.col("cells_g")) & (F.coalesce("shared", F.lit(0)) == F.col("cells_g"))
    out = grids.groupBy(*keys).agg(
        F.count("cells_g").alias("gold"), F.count("cells_p").alias("predicted"), F.count_if(exact).alias("exact"), F.count_if(same_shape).alias("shapes"),
        F.coalesce(F.sum("shared"), F.lit(0)).alias("hit"), F.coalesce(F.sum("cells_g"), F.lit(0)).alias("cells"),
    )
    none = F.when(F.col("predicted") == 0, 1).otherwise(0)
    return out.select(*keys, rate(F.col("exact"), F.col("gold"), none).alias("structure_exact"), rate(F.col("shapes"), F.col("gold"), none).alias("row_column_topology_exact"), rate(F.col("hit"), F.col("cells"), none).alias("cell_exactness"))


def typed_tokens(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token): ``field:text`` of the value, unit and symbol of each cell, and ``number:n`` of the numbers in its text."""
    norm = lambda c: T.collapse_space(T.fold(F.coalesce(F.col(c), F.lit(""))))
    fields = [F.when(norm(c) != "", F.concat(F.lit(f"{c}_candidate:"), norm(c))) for c in ("value", "unit", "symbol")]
    numbers = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(NUMBER), F.lit(0)), lambda n: F.concat(F.lit("number:"), n))
    return cells.select(*keys, F.explode(F.concat(F.array_compact(F.array(*fields)), numbers)).alias("token"))


def exactness(gold: Column, predicted: Column) -> Column:
    """1 where both are the same, 0 where not, null where both are null."""
    return F.when(gold.isNull() & predicted.isNull(), None).otherwise(F.when(gold.eqNullSafe(predicted), 1.0).otherwise(0.0))


def presence(rows: DataFrame, keys: list[str], gold: Column, predicted: Column) -> DataFrame:
    """(keys, precision, recall, f1, n): presence of something in each item; ratios without a denominator are null."""
    c = rows.groupBy(*keys).agg(F.count_if(gold & predicted).alias("h"), F.count_if(predicted).alias("p"), F.count_if(gold).alias("g"), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select(*keys, ratio(F.col("h"), F.col("p")).alias("precision"), ratio(F.col("h"), F.col("g")).alias("recall"), ratio(2 * F.col("h"), F.col("p") + F.col("g")).alias("f1"), "n")


def word_errors(rows: DataFrame, keys: list[str], gold: str, predicted: str) -> DataFrame:
    """(keys, words, distance, wer): micro-averaged word error rate."""
    words = lambda c: F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != "")
    own = rows.select(*keys, words(gold).alias("g"), words(predicted).alias("p"))
    out = own.groupBy(*keys).agg(F.sum(F.size("g")).alias("words"), F.sum(T.edit_distance_words(F.col("p"), F.col("g"))).alias("distance"))
    return out.withColumn("wer", F.round(F.try_divide("distance", "words"), 6))


def numeric_accuracy(rows: DataFrame, keys: list[str], gold: str, predicted: str) -> DataFrame:
    """(keys, tokens, hits, accuracy): numbers that stand at the same place among the numbers of both texts."""
    found = lambda c: F.regexp_extract_all(F.col(c), F.lit(NUMBER), F.lit(0))
    own = rows.select(*keys, found(gold).alias("g"), found(predicted).alias("p"))
    hits = F.size(F.filter(F.arrays_zip(F.col("g").alias("g"), F.col("p").alias("p")), lambda z: z["g"] == z["p"]))
    out = own.groupBy(*keys).agg(F.sum(F.size("g")).alias("tokens"), F.sum(hits).alias("hits"))
    return out.withColumn("accuracy", F.round(F.try_divide("hits", "tokens"), 6))


def pixel_errors(left: DataFrame, right: DataFrame, key: str, values: str, channels: int) -> DataFrame:
    """(key, mae, rmse, max_error, changed_ratio) of two arrays of numbers of one length; a pixel has ``channels`` of them."""
    both = left.select(key, F.col(values).alias("a")).join(right.select(key, F.col(values).alias("b")), key)
    off = both.select(key, F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))).alias("e"))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda s, x: s + f(x))
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / channels).cast("int") - 1), lambda i: F.exists(F.slice("e", i * channels + 1, channels), lambda x: x != 0))
    changed = F.size(F.filter(pixels, lambda c: c))
    n = F.size("e")
    return off.select(key, F.round(total(lambda x: x) / n, 6).alias("mae"), F.round(F.sqrt(total(lambda x: x * x) / n), 6).alias("rmse"), F.round(F.array_max("e"), 6).alias("max_error"), F.round(changed / F.size(pixels), 6).alias("changed_ratio"))


def layer_counts(cases: DataFrame, results: DataFrame, *, case: str, layer: str, status: str) -> DataFrame:
    """(layer, planned, executed, passed, failed, skipped, blocked, not_run): a case without a result isn't run."""
    names = ("passed", "failed", "skipped", "blocked", "not_run")
    both = cases.select(case, layer).join(results.select(case, status), case, "left")
    counts = [F.count_if(F.coalesce(F.col(status), F.lit("not_run")) == n).alias(n) for n in names]
    return both.groupBy(layer).agg(F.count("*").alias("planned"), *counts).withColumn("executed", F.col("passed") + F.col("failed"))


def blind_gates(cases: DataFrame, *, category: str, split: str, categories: list[str]) -> DataFrame:
    """One row (n_blind, least, reasons): gates that the blind cases of a suite don't meet."""
    blind = F.col(split) == "blind"
    counts = [F.count_if(blind & (F.col(category) == c)) for c in categories]
    out = cases.agg(F.count_if(blind).alias("n_blind"), (F.least(*counts) if len(counts) > 1 else counts[0]).alias("least"))
    reasons = F.array_compact(F.array(F.when(F.col("n_blind") == 0, "independent_blind_cases_required"), F.when((F.col("n_blind") < BLIND_CASES) | (F.col("least") < BLIND_PER_CATEGORY), "blind_minimum_100_and_20_per_category_required")))
    return out.withColumn("reasons", F.array_join(reasons, ","))


def certification(challenges: DataFrame, receipts: DataFrame, *, challenge: str, attempts: int) -> DataFrame:
    """(challenge, state, passed): each challenge needs every attempt from 1 on exactly once."""
    seen = receipts.groupBy(challenge).agg(F.count("*").alias("n"), F.count_distinct("attempt").alias("d"), F.count_if(F.col("attempt").between(1, attempts)).alias("fit"), F.count_if("ok").alias("passed"))
    both = challenges.select(challenge).join(seen, challenge, "left")
    complete = (F.col("n") == attempts) & (F.col("d") == attempts) & (F.col("fit") == attempts)
    state = F.when(F.col("n").isNull(), "missing").when(~complete, "incomplete").when(F.col("passed") == attempts, "passed").otherwise("failed")
    return both.select(challenge, state.alias("state"), F.coalesce("passed", F.lit(0)).alias("passed"))


def visual_coverage(routes: DataFrame, status: str) -> DataFrame:
    """``routes`` plus coverage, gap and review_required, by the state that routing left a page in (processed if none is known)."""
    table = F.create_map(*(F.lit(x) for pair in COVERAGE.items() for x in pair))
    own = routes.withColumn("coverage", F.coalesce(F.element_at(table, F.col(status)), F.lit("processed")))
    return own.withColumns({"gap": F.col("coverage").isin("budget-exhausted", "not-inspected-by-policy"), "review_required": F.col("coverage").isin("candidate", "review-required", "conflict")})


def budget_receipt(used: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, sums of the limited columns, status): exhausted where a sum is over its limit; reaching it is complete."""
    sums = used.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in limits))
    over = F.lit(False)
    for c, limit in limits.items():
        over = over | (F.col(c) > limit)
    return sums.withColumn("status", F.when(over, "budget-exhausted").otherwise("complete"))


def candidate_kinds(labels: dict[str, Column], *, rows: Column, images: Column, forms: Column, line_ops: Column, stroke_ops: Column) -> Column:
    """The kinds of objects that a page's counts speak for. ``labels``: how many labels of each kind it has (missing: none)."""
    none = F.lit(0)
    tables, figures, charts, diagrams, equations = (labels.get(k, none) for k in ("table", "figure", "chart", "diagram", "equation"))
    return F.array_compact(F.array(
        F.when((tables > 0) | (rows >= 1) | ((line_ops >= 2) & (stroke_ops >= 2)), "table"),
        F.when((figures > 0) | (images + forms > 0), "figure"),
        F.when((charts > 0) | ((line_ops >= 2) & (rows == 0) & (images > 0)), "chart"),
        F.when(diagrams > 0, "diagram"),
        F.when(equations > 0, "equation"),
    ))


def quality_routing(pages: DataFrame, observations: DataFrame, conflicts: DataFrame, *, page: str, threshold: float) -> DataFrame:
    """(page, route, reasons): manual pages, pages for OCR with what is to be looked at in its output, and native text.

    Pages have manual and routed (booleans); observations kind, text and
    confidence; conflicts their page. Both are aggregated to a row per page before the join.
    """
    kind = F.lower("kind")
    seen = observations.groupBy(page).agg(
        F.min("confidence").alias("least"), F.bool_or(kind == "formula").alias("formula"), F.bool_or(kind == "table").alias("table"),
        F.bool_or(F.col("text").rlike(r"\d\s*(?:kg|m|s|K|Pa)\b")).alias("unit"), F.bool_or(kind.isin("formula", "equation", "table")).alias("structured"),
    )
    both = pages.join(seen, page, "left").join(conflicts.select(page).distinct().withColumn("conflict", F.lit(True)), page, "left")
    yes = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    reason = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        reason(F.col("least").isNull(), "ocr_no_observations"), reason(yes(F.col("least") < threshold), "low_confidence"),
        reason(yes("formula"), "formula_visual_review_required", "formula_ast_review_required"), reason(yes("table"), "table_visual_review_required"),
        reason(yes("unit"), "unit_visual_review_required"), reason(yes("structured"), "structured_candidate_requires_visual_review"), reason(yes("conflict"), "ocr_conflict_or_duplicate"),
    )
    route = F.when(yes("manual"), "manual-review-required").when(yes("routed"), "ocr-candidate").otherwise("native-text")
    reasons = F.when(yes("manual"), F.array(F.lit("blank-or-unusable-native-page"))).when(yes("routed"), F.array_sort(found)).otherwise(F.array(F.lit("native-text-first-preserved")))
    return both.select(page, route.alias("route"), F.array_join(reasons, ",").alias("reasons"))


def plan_summary(coverage: DataFrame, book: str, unresolved: DataFrame) -> DataFrame:
    """(book, n_pages, next_action): the first thing that a book's plan still needs."""
    open_headings = unresolved.select(book).distinct().withColumn("open", F.lit(True))
    counts = coverage.groupBy(book).agg(F.count("*").alias("n_pages"), F.bool_or(F.col("status") == "ocr-candidate").alias("ocr"), F.bool_or(F.col("status") == "visual-review").alias("visual"))
    action = F.when(F.col("open"), "heading_resolution_required").when(F.col("ocr"), "ocr_candidate_review_required").when(F.col("visual"), "visual_review_required").otherwise("independent_semantic_review_required")
    return counts.join(open_headings, book, "left").select(book, "n_pages", action.alias("next_action"))


def attestation_manifest(objects: DataFrame, attestations: DataFrame, *, key: str) -> DataFrame:
    """(key, n_accepted, n_reviewers, sha256): accepted attestations of each object and a hash over their sorted ids."""
    accepted = attestations.filter("accepted").groupBy(key).agg(F.count("*").alias("n_accepted"), F.count_distinct("reviewer").alias("n_reviewers"), F.array_sort(F.collect_set("id")).alias("ids"))
    both = objects.select(key).join(accepted, key, "left")
    return both.select(key, F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), F.coalesce("n_reviewers", F.lit(0)).alias("n_reviewers"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("sha256"))


def response_checks(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, failed): parts of which the expected set isn't within the actual one, or the forbidden one meets it.

    Each part p has arrays p_expected, p_actual and p_forbidden.
    """
    bad = [F.when((F.size(F.array_except(f"{p}_expected", f"{p}_actual")) > 0) | F.arrays_overlap(f"{p}_forbidden", f"{p}_actual"), p) for p in parts]
    return rows.select(key, F.array_join(F.array_compact(F.array(*bad)), ",").alias("failed"))


def symbols(bindings: DataFrame, asked: DataFrame, glyph: str, scope: str) -> DataFrame:
    """``asked`` plus n and status: resolved for one binding of the glyph in the scope whose definition is known, ambiguous for several, else unknown."""
    known = bindings.groupBy(glyph, scope).agg(F.count("*").alias("n"), F.bool_and(F.col("definition").isNotNull()).alias("defined"))
    both = asked.join(known, [glyph, scope], "left")
    status = F.when(F.col("n") > 1, "ambiguous").when((F.col("n") == 1) & F.col("defined"), "resolved").otherwise("unknown")
    return both.select(*asked.columns, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def properties(requested: DataFrame, available: DataFrame, *, item: str) -> DataFrame:
    """(item, status, trace): wanted conditions (item, name, value) against known ones, which may be missing (unknown).

    violated if one differs, else unknown if one is missing, else satisfied.
    """
    both = requested.select(item, "name", F.col("value").alias("wanted")).join(available.select(item, "name", "value"), [item, "name"], "left")
    one = P.outcome(F.col("value") == F.col("wanted"))
    states = both.select(item, "name", one.alias("state")).groupBy(item).agg(F.collect_set("state").alias("s"), F.array_sort(F.collect_list(F.concat_ws("=", "name", "state"))).alias("t"))
    status = F.when(F.array_contains("s", "violated"), "violated").when(F.array_contains("s", "unknown"), "unknown").otherwise("satisfied")
    return states.select(item, status.alias("status"), F.array_join("t", ",").alias("trace"))


def permitted(issued: Column, expires: Column, now: Column, seconds: int = 3600) -> Column:
    """Whether a permission holds now and for no longer than ``seconds`` in all; unknown times don't permit."""
    span = F.unix_timestamp(expires) - F.unix_timestamp(issued)
    return F.coalesce((issued <= now) & (now < expires) & (span <= seconds), F.lit(False))


def first_gate(rows: DataFrame, job: str, gates: dict[str, tuple[Column, str]]) -> DataFrame:
    """(job, state, code): the first gate that isn't met decides; ready where all are. ``gates``: code -> (condition, state)."""
    state, code = F.lit("complete"), F.lit("all_gates_met")
    for name, (met, outcome) in reversed(gates.items()):
        open_one = ~F.coalesce(met, F.lit(False))
        state, code = F.when(open_one, outcome).otherwise(state), F.when(open_one, name).otherwise(code)
    return rows.select(job, state.alias("state"), code.alias("code"))


def strict_json(rows: DataFrame, key: str, text: str, schema: str, checks: dict[str, Column] | None = None) -> DataFrame:
    """(key, state, failed): JSON texts under a schema: invalid, incomplete (a field is missing or of another type), out_of_range, valid.

    ``checks`` are conditions over ``x``, the parsed struct.
    """
    parsed = rows.select(key, F.col(text).alias("raw"), F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("x"))
    fields = parsed.schema["x"].dataType.names
    missing = F.array_compact(F.array(*(F.when(F.col(f"x.{f}").isNull(), f) for f in fields)))
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in (checks or {}).items()))).cast("array<string>")
    broken = F.try_parse_json("raw").isNull()
    state = F.when(broken, "invalid").when(F.size(missing) > 0, "incomplete").when(F.size(wrong) > 0, "out_of_range").otherwise("valid")
    failed = F.when(broken, F.lit("")).when(F.size(missing) > 0, F.array_join(missing, ",")).otherwise(F.array_join(wrong, ","))
    return parsed.select(key, state.alias("state"), failed.alias("failed"))


def decimal_text(text: Column) -> Column:
    """A strictly written number between 1e-100 and 1e100 in size as plain text without an exponent; null for any other text.

    Numbers of up to 38 digits; longer ones are null as well.
    """
    good = (F.length(text) <= 128) & text.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d{1,3})?$")
    value = F.when(good, text).try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, "0").otherwise(plain)


def changes_by_kind(rows: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """``rows`` (kind, change, ...) plus ``reason``: what a change of that kind of node is called."""
    table = F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair))
    reason = F.when(F.col("change") == "added", "node_added").when(F.col("change") == "removed", "node_deleted").when(F.col("change") == "changed", F.coalesce(F.element_at(table, F.col("kind")), F.lit("node_changed")))
    return rows.withColumn("reason", reason)


def runs_in_order(rows: DataFrame, keys: list[str], order: list[str], seq: str) -> DataFrame:
    """(keys, state): numbered states of a checkpoint: ordered, duplicate (a number twice) or out_of_order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = rows.withColumn("last", F.lag(seq).over(w))
    out = steps.groupBy(*keys).agg(F.count_if(F.col("last") > F.col(seq)).alias("back"), F.count(seq).alias("n"), F.count_distinct(seq).alias("d"))
    return out.select(*keys, F.when(F.col("n") > F.col("d"), "duplicate").when(F.col("back") > 0, "out_of_order").otherwise("ordered").alias("state"))
