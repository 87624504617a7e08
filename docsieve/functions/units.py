"""Units, quantities and formula trees, compiled to Columns.

Values are doubles on the fast path. Where 50 digits matter,
:func:`evaluate_exactly` runs the same tree with decimal arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI exponents in the order length, mass, time, current, temperature, amount, light.
DIMENSIONS = ("m", "kg", "s", "A", "K", "mol", "cd")
#: Units: scale to SI and exponents of the base units they differ in (fixed values).
UNITS: dict[str, tuple[str, dict[str, int]]] = {
    "1": ("1", {}), "m": ("1", {"m": 1}), "mm": ("0.001", {"m": 1}), "cm": ("0.01", {"m": 1}), "km": ("1000", {"m": 1}),
    "kg": ("1", {"kg": 1}), "g": ("0.001", {"kg": 1}), "s": ("1", {"s": 1}), "min": ("60", {"s": 1}), "h": ("3600", {"s": 1}),
    "A": ("1", {"A": 1}), "K": ("1", {"K": 1}), "mol": ("1", {"mol": 1}), "cd": ("1", {"cd": 1}),
    "N": ("1", {"kg": 1, "m": 1, "s": -2}), "Pa": ("1", {"kg": 1, "m": -1, "s": -2}), "kPa": ("1000", {"kg": 1, "m": -1, "s": -2}), "MPa": ("1000000", {"kg": 1, "m": -1, "s": -2}),
    "J": ("1", {"kg": 1, "m": 2, "s": -2}), "kJ": ("1000", {"kg": 1, "m": 2, "s": -2}), "W": ("1", {"kg": 1, "m": 2, "s": -3}), "kW": ("1000", {"kg": 1, "m": 2, "s": -3}),
    "Hz": ("1", {"s": -1}), "L": ("0.001", {"m": 3}),
}
#: Affine units by quantity kind: value * scale + offset is the canonical value (fixed values).
AFFINE: dict[tuple[str, str], tuple[float, float]] = {
    ("temperature", "K"): (1.0, 0.0), ("temperature", "degC"): (1.0, 273.15), ("temperature", "degF"): (5 / 9, 459.67 * 5 / 9),
    ("temperature_difference", "K"): (1.0, 0.0), ("temperature_difference", "degC"): (1.0, 0.0),
    ("length", "m"): (1.0, 0.0), ("length", "mm"): (0.001, 0.0), ("mass", "kg"): (1.0, 0.0), ("mass", "g"): (0.001, 0.0),
    ("pressure", "Pa"): (1.0, 0.0), ("pressure", "kPa"): (1000.0, 0.0), ("pressure", "bar"): (100000.0, 0.0),
    ("fraction", "1"): (1.0, 0.0), ("fraction", "%"): (0.01, 0.0), ("time", "s"): (1.0, 0.0), ("time", "h"): (3600.0, 0.0),
}


def parse_unit(text: str) -> tuple[Decimal, tuple[int, ...]]:
    """Scale and exponents of a product of units such as ``kg*m/s^2``."""
    scale, powers, sign = Decimal(1), [0] * len(DIMENSIONS), 1
    for piece in text.replace("/", " / ").replace("*", " * ").split():
        if piece in "*/":
            sign = -1 if piece == "/" else 1
            continue
        name, _, power = piece.partition("^")
        if name not in UNITS:
            raise ValueError(f"unknown unit {name!r}")
        n = sign * int(power or 1)
        own, exponents = UNITS[name]
        scale *= Decimal(own) ** n
        for base, e in exponents.items():
            powers[DIMENSIONS.index(base)] += e * n
        sign = 1
    return scale, tuple(powers)


def convert(value: Column, kind: Column, unit: Column) -> Column:
    """Canonical value of a quantity; null for an unknown unit or a value out of its kind's range."""
    out = F.lit(None).cast("double")
    for (k, u), (scale, offset) in AFFINE.items():
        out = F.when((kind == k) & (unit == u), value * scale + offset).otherwise(out)
    in_range = ~((kind == "temperature") & (out < 0)) & ~((kind == "fraction") & ((out < 0) | (out > 1)))
    return F.when(in_range, F.round(out, 9))


def unit_factor(a: str, b: str) -> float | None:
    """Factor from unit a to unit b, or None where their dimensions differ."""
    (sa, da), (sb, db) = parse_unit(a), parse_unit(b)
    return float(round(sa / sb, 15)) if da == db else None


# A formula is nested lists: ["symbol", name], ["number", text], ["add" | "subtract" | "multiply" | "divide", a, b],
# ["negate", a], ["sqrt", a], ["power", a, integer].
LEAST_NODES, MOST_NODES, MOST_SYMBOLS = 1, 128, 32


def dimension(tree: list, symbols: dict[str, str]) -> tuple[int, ...]:
    """Exponents of a formula's value; raises where dimensions don't fit or the tree is too large."""
    nodes, names = _size(tree)
    if nodes > MOST_NODES or len(names) > MOST_SYMBOLS:
        raise ValueError("formula too large")

    def of(node: list) -> list[int]:
        op, *args = node
        if op == "symbol":
            return list(parse_unit(symbols[args[0]])[1])
        if op == "number":
            return [0] * len(DIMENSIONS)
        parts = [of(a) for a in args if isinstance(a, list)]
        if op in ("add", "subtract"):
            if parts[0] != parts[1]:
                raise ValueError(f"{op} of different dimensions")
            return parts[0]
        if op == "multiply":
            return [x + y for x, y in zip(*parts, strict=True)]
        if op == "divide":
            return [x - y for x, y in zip(*parts, strict=True)]
        if op == "negate":
            return parts[0]
        if op == "power":
            return [x * int(args[1]) for x in parts[0]]
        if op == "sqrt":
            if any(x % 2 for x in parts[0]):
                raise ValueError("sqrt of an odd dimension")
            return [x // 2 for x in parts[0]]
        raise ValueError(f"unknown operation {op!r}")

    return tuple(of(tree))


def _size(node: list) -> tuple[int, set]:
    nodes, names = 1, {node[1]} if node[0] == "symbol" else set()
    for a in node[1:]:
        if isinstance(a, list):
            n, more = _size(a)
            nodes, names = nodes + n, names | more
    return nodes, names


def compile_formula(tree: list, columns: dict[str, Column]) -> Column:
    """The tree as a Column; division by zero and roots of negative numbers are null."""
    op, *args = tree
    if op == "symbol":
        return columns[args[0]]
    if op == "number":
        return F.lit(float(args[0]))
    parts = [compile_formula(a, columns) for a in args if isinstance(a, list)]
    if op == "power":
        return F.pow(parts[0], F.lit(float(args[1])))
    return {
        "add": lambda: parts[0] + parts[1],
        "subtract": lambda: parts[0] - parts[1],
        "multiply": lambda: parts[0] * parts[1],
        "divide": lambda: F.try_divide(parts[0], parts[1]),
        "negate": lambda: -parts[0],
        "sqrt": lambda: F.sqrt(F.when(parts[0] >= 0, parts[0])),
    }[op]()


def evaluate_exactly(tree: list, **columns: Column) -> Column:
    """The tree over decimal texts with 50 digits, as plain text; null where it has no value."""
    names = sorted(columns)

    def value(node: list, given: dict[str, Decimal]) -> Decimal:
        op, *args = node
        if op == "symbol":
            return given[args[0]]
        if op == "number":
            return Decimal(args[0])
        parts = [value(a, given) for a in args if isinstance(a, list)]
        if op == "power":
            return parts[0] ** int(args[1])
        return {"add": lambda: parts[0] + parts[1], "subtract": lambda: parts[0] - parts[1], "multiply": lambda: parts[0] * parts[1], "divide": lambda: parts[0] / parts[1], "negate": lambda: -parts[0], "sqrt": lambda: parts[0].sqrt()}[op]()

    @F.pandas_udf("string")
    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            with localcontext() as context:
                context.prec = 50
                for given in rows.itertuples(index=False):
                    try:
                        out.append(format(value(tree, {n: Decimal(v) for n, v in zip(names, given, strict=True)}).normalize(), "f"))
                    except (ArithmeticError, TypeError, ValueError):
                        out.append(None)
            yield pd.Series(out, dtype=object)

    return evaluate(F.struct(*(columns[n].cast("string").alias(n) for n in names)))
