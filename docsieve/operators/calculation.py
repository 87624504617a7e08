"""Calculations over requests: several formulas in the order of their dependencies, inputs bound and brought to units, sealed receipts and their replay."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import units as U


@dataclass(frozen=True)
class Formula:
    """A formula tree (see ``units``) for ``output`` in ``unit``; ``inputs`` gives each symbol the unit that the tree counts in.

    ``domains``: positive or nonnegative for symbols that must be so.
    """

    output: str
    unit: str
    tree: list
    inputs: dict[str, str]
    domains: dict[str, str] = field(default_factory=dict)


def in_order(formulas: list[Formula]) -> list[Formula]:
    """Formulas after those that give their inputs; raises on outputs given twice, symbols without a unit, wrong dimensions and cycles."""
    by = {f.output: f for f in formulas}
    if len(by) < len(formulas):
        raise ValueError("two formulas have one output")
    for f in formulas:
        if U.dimension(f.tree, f.inputs) != U.parse_unit(f.unit)[1]:
            raise ValueError(f"{f.output} is not in {f.unit}")
        for symbol, unit in f.inputs.items():
            if symbol in by and U.unit_factor(by[symbol].unit, unit) is None:
                raise ValueError(f"{symbol} has another dimension in {f.output}")
    out: list[Formula] = []
    while len(out) < len(formulas):
        known = {f.output for f in out}
        ready = [f for f in formulas if f.output not in known and all(s in known or s not in by for s in f.inputs)]
        if not ready:
            raise ValueError("formulas depend on each other")
        out += ready
    return out


def _bound(symbol: str, unit: str, made: dict[str, Formula]) -> tuple[Column, Column]:
    """(value in ``unit``, trouble) of a symbol: of an earlier formula, or of the request's facts."""
    if symbol in made:
        own = F.col(f"f_{symbol}")
        return own["value"] * F.lit(U.unit_factor(made[symbol].unit, unit)), F.when(own["state"] != "computed", F.concat(F.lit("blocked:"), F.lit(symbol)))
    fact = F.element_at("facts", symbol)
    factors = {u: U.unit_factor(u, unit) for u in U.UNITS}
    factor = F.element_at(F.create_map(*(F.lit(x) for u, k in factors.items() if k is not None for x in (u, k))), fact["unit"])
    trouble = F.when(fact.isNull() | fact["value"].isNull(), "missing:").when(fact["n"] > 1, "ambiguous:").when(factor.isNull(), "unit:")
    return fact["value"] * factor, F.concat(trouble, F.lit(symbol))


def run(facts: DataFrame, formulas: list[Formula], *, gate: Column | None = None) -> DataFrame:
    """(request, formula, value, unit, state, detail, inputs, seal): every formula of every request.

    Facts are (request, symbol, value, unit); a symbol with two different facts
    is ambiguous. ``state``: computed; gate_closed where the request's ``gate``, a
    condition over its map ``facts`` of (value, unit, n), isn't met; blocked with
    ``detail`` saying what is missing, ambiguous, in a wrong unit, out of its
    domain, or which earlier formula gave nothing; no_value for divisions by
    zero and the like. ``inputs`` are the bound values, ``seal`` the hash of formula,
    inputs and value.

    Formulas are few and known beforehand, so that all of them are one projection
    over the facts of a request, which meet in one aggregate of the symbols in use.
    """
    order = in_order(formulas)
    made = {f.output: f for f in order}
    wanted = sorted({s for f in order for s in f.inputs} - set(made))
    single = facts.filter(F.col("symbol").isin(*wanted)).groupBy("request", "symbol").agg(F.count_distinct(F.struct("value", "unit")).alias("n"), F.min(F.struct(F.col("value").cast("double").alias("value"), "unit")).alias("x"))
    known = single.groupBy("request").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("x.value", "x.unit", "n")))).alias("facts"))
    rows = facts.select("request").distinct().join(known, "request", "left")
    for f in order:
        bound = {s: _bound(s, u, made) for s, u in f.inputs.items()}
        outside = {"positive": lambda v: v <= 0, "nonnegative": lambda v: v < 0}
        troubles = [F.coalesce(t, F.when(outside[f.domains[s]](v), F.lit(f"domain:{s}"))) if s in f.domains else t for s, (v, t) in sorted(bound.items())]
        detail = F.array_join(F.array_compact(F.array(*troubles)), ",")
        value = U.compile_formula(f.tree, {s: v for s, (v, _) in bound.items()})
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        closed = F.lit(False) if gate is None else ~F.coalesce(gate, F.lit(False))
        state = F.when(closed, "gate_closed").when(detail != "", "blocked").when(value.isNull(), "no_value").otherwise("computed")
        inputs = F.array_join(F.array(*(F.concat(F.lit(f"{s}="), v.cast("string")) for s, (v, _) in sorted(bound.items()))), ";")
        rows = rows.withColumn(f"f_{f.output}", F.struct(F.lit(f.output).alias("formula"), F.when(state == "computed", value).alias("value"), F.lit(f.unit).alias("unit"), state.alias("state"), F.when(state == "blocked", detail).otherwise("").alias("detail"), F.when(state == "computed", inputs).alias("inputs"), F.lit(json.dumps(f.tree)).alias("tree")))
    out = rows.select("request", F.inline(F.array(*(F.col(f"f_{f.output}") for f in order))))
    return out.withColumn("seal", F.when(F.col("state") == "computed", _seal())).drop("tree")


def _seal(tree: str = "tree") -> Column:
    return F.sha2(F.concat_ws("|", "formula", tree, "inputs", F.col("value").cast("string"), "unit"), 256)


def replay(receipts: DataFrame, facts: DataFrame, formulas: list[Formula], *, gate: Column | None = None) -> DataFrame:
    """(request, formula, status): stored rows of :func:`run` against the facts as they are now.

    modified: the receipt isn't what was sealed; blocked: its gate is closed or
    an input is gone; stale: another input or value now; valid. Only computed
    receipts are replayed.
    """
    trees = F.create_map(*(F.lit(x) for f in formulas for x in (f.output, json.dumps(f.tree))))
    own = receipts.filter("state = 'computed'").withColumn("tree", F.element_at(trees, F.col("formula")))
    own = own.select("request", "formula", F.col("seal").alias("was"), _seal().alias("is"))
    now = run(facts, formulas, gate=gate).select("request", "formula", "state", F.col("seal").alias("now"))
    status = F.when(~F.col("was").eqNullSafe(F.col("is")), "modified").when(~F.col("state").eqNullSafe("computed"), "blocked").when(F.col("was") != F.col("now"), "stale").otherwise("valid")
    return own.join(now, ["request", "formula"], "left").select("request", "formula", status.alias("status"))
