"""Conditions with three outcomes, compiled to Columns: satisfied (true), violated (false), unknown (null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_predicate(tree: list, columns: dict[str, Column]) -> Column:
    """A tree of lists: ["all" | "any", p, ...], ["not", p], ["known", name], ["eq" | "gt" | "ge" | "lt" | "le", name, value],
    ["between", name, low, high], ["in", name, [values]], ["same", name, name].

    SQL's AND, OR and NOT are Kleene's, so unknown inputs stay unknown unless
    the other side decides.
    """
    op, *args = tree
    if op in ("all", "any"):
        out = F.lit(op == "all")
        for a in args:
            part = compile_predicate(a, columns)
            out = out & part if op == "all" else out | part
        return out
    if op == "not":
        return ~compile_predicate(args[0], columns)
    x = columns[args[0]]
    if op == "known":
        return x.isNotNull()
    if op == "between":
        return (x >= args[1]) & (x <= args[2])
    if op == "in":
        return x.isin(*args[1])
    if op == "same":
        return x == columns[args[1]]
    return {"eq": x == args[1], "gt": x > args[1], "ge": x >= args[1], "lt": x < args[1], "le": x <= args[1]}[op]


def outcome(condition: Column) -> Column:
    return F.when(condition, "satisfied").when(~condition, "violated").otherwise("unknown")


def assess(conditions: dict[str, list], columns: dict[str, Column]) -> Column:
    """Outcome of all conditions together, and each one's as a trace."""
    parts = {name: compile_predicate(tree, columns) for name, tree in conditions.items()}
    every = F.lit(True)
    for p in parts.values():
        every = every & p
    trace = F.array(*(F.struct(F.lit(n).alias("condition"), outcome(p).alias("outcome")) for n, p in parts.items()))
    return F.struct(outcome(every).alias("outcome"), trace.alias("trace"))


def gates(**conditions: Column) -> Column:
    """Names of the gates that don't hold (unknown counts as not holding), in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items())))
