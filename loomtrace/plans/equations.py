"""Declarative equations: a JSON tree of literals, inputs, constants and operations, compiled to a Column.

The contract fixes the shape of the tree and the twelve operator names, not their evaluation; the choices
here are our own. A null argument makes any result null: what can't be computed is unavailable, never 0.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class EquationError(ValueError):
    pass


def canonical(node: dict) -> str:
    """The same text for equal trees."""
    return json.dumps(node, sort_keys=True, separators=(",", ":"))


def strict(value: Column, args: list[Column]) -> Column:
    return F.when(reduce(lambda a, b: a & b, (x.isNotNull() for x in args)), value)


def folded(step):
    return lambda args: reduce(step, args)


#: Operators over the arguments of one row, with the least and most numbers of arguments.
OPERATORS = {
    "add": (1, None, folded(lambda a, b: a + b)),
    "subtract": (1, None, folded(lambda a, b: a - b)),
    "multiply": (1, None, folded(lambda a, b: a * b)),
    "divide": (2, None, folded(F.try_divide)),
    "max": (1, None, lambda a: strict(F.greatest(*a) if len(a) > 1 else a[0], a)),
    "min": (1, None, lambda a: strict(F.least(*a) if len(a) > 1 else a[0], a)),
    "abs": (1, 1, lambda a: F.abs(a[0])),
    "mean": (1, None, lambda a: folded(lambda x, y: x + y)(a) / len(a)),
    "geometric_mean": (1, None, lambda a: strict(F.when(reduce(lambda x, y: x & y, (c > 0 for c in a)), F.exp(folded(lambda x, y: x + y)([F.ln(c) for c in a]) / len(a))), a)),
    "clamp": (3, 3, lambda a: strict(F.greatest(a[1], F.least(a[2], a[0])), a)),
}


def compile_node(node: dict, inputs: dict[str, Column], constants: dict[str, float], known: dict[str, Column] | None = None) -> Column:
    """A tree as one Column. Unknown nodes, names and operators, and wrong numbers of arguments are errors.

    known has Columns for whole sub-trees (by `canonical`), which are put in their place.
    """
    if known and (found := known.get(canonical(node))) is not None:
        return found
    kind = node.get("kind")
    if kind == "literal":
        return F.lit(float(node["value"]))
    if kind in ("input", "constant"):
        name = node.get("name")
        if kind == "input" and name in inputs:
            return inputs[name].cast("double")
        if kind == "constant" and name in constants:
            return F.lit(float(constants[name]))
        raise EquationError(f"unknown {kind}: {name}")
    if kind == "operation":
        operator, args = node.get("operator"), [compile_node(x, inputs, constants, known) for x in node.get("arguments", [])]
        if operator not in OPERATORS:
            raise EquationError(f"unknown operator: {operator}")
        least, most, build = OPERATORS[operator]
        if len(args) < least or most is not None and len(args) > most:
            raise EquationError(f"{operator} takes another number of arguments")
        return build(args)
    raise EquationError(f"unknown node: {node}")


def slope(df: DataFrame, key: str, value: str, seconds: Column) -> DataFrame:
    """By key the least-squares slope of value over time."""
    return df.groupBy(key).agg(F.regr_slope(value, seconds).alias("slope"))


def integral_positive_excess(df: DataFrame, key: str, order: list[str], value: str, seconds: Column, threshold: float) -> DataFrame:
    """By key the area of value above threshold, by trapezoids between neighbours in time."""
    w = Window.partitionBy(key).orderBy(*order)
    excess = F.greatest(F.col(value) - threshold, F.lit(0.0))
    parts = df.select(key, *order, excess.alias("e"), seconds.alias("t")).withColumns({"pe": F.lag("e").over(w), "pt": F.lag("t").over(w)})
    return parts.groupBy(key).agg(F.coalesce(F.sum((F.col("e") + F.col("pe")) / 2 * (F.col("t") - F.col("pt"))), F.lit(0.0)).alias("integral"))


def usable(age_ms: Column, most_age_ms: Column, quality: Column, accepted: Column) -> Column:
    """An input counts only if it is fresh enough and of an accepted quality."""
    return F.coalesce((age_ms <= most_age_ms) & F.array_contains(accepted, quality), F.lit(False))
