"""Equations with series operators anywhere in the tree, compiled to stages.

slope and integral_positive_excess turn a series (an argument's values over the rows of a key) into one value
of the key. They are lifted out of the tree, innermost first: a stage works out all series of one depth over
the same partitioning by key, so one shuffle serves all stages, and what is left of the tree is a Column.
Equal sub-trees are worked out once.

The contract names the operators and leaves their meaning open. Ours: time is in the unit that the caller
hands in; rows where the argument is null are no part of a series; a slope is least squares and null below
two times; an integral takes trapezoids between neighbours in time of what is above the threshold, 0 for a
series of one row, null for an empty one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.plans.equations import EquationError, canonical, compile_node

#: Operators over a series, with their numbers of arguments.
SERIES = {"slope": 1, "integral_positive_excess": 2}


def children(node: dict) -> list[dict]:
    return node.get("arguments", []) if node.get("kind") == "operation" else []


def depth(node: dict) -> int:
    """How many series operators lie within each other."""
    return max(map(depth, children(node)), default=0) + (node.get("operator") in SERIES if node.get("kind") == "operation" else 0)


def sub_trees(node: dict) -> list[dict]:
    return [node, *(x for c in children(node) for x in sub_trees(c))]


@dataclass
class Stages:
    """What to work out in which order: by depth the distinct series nodes, and the sub-trees that stand more than once."""

    trees: list[dict]
    series: dict[int, dict[str, dict]] = field(default_factory=dict)
    shared: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        nodes = [n for t in self.trees for n in sub_trees(t)]
        for n in nodes:
            if n.get("kind") == "operation" and n.get("operator") in SERIES:
                if len(n.get("arguments", [])) != SERIES[n["operator"]]:
                    raise EquationError(f"{n['operator']} takes {SERIES[n['operator']]} arguments")
                self.series.setdefault(depth(n), {})[canonical(n)] = n
        uses = Counter(canonical(n) for n in nodes if n.get("kind") == "operation" and n.get("operator") not in SERIES)
        by_text = {canonical(n): n for n in nodes}
        # Of sub-trees that are shared only within one that is, the outer one is enough.
        self.shared = {t: by_text[t] for t, n in uses.items() if n > 1 and not any(n == m and t != u and t in u for u, m in uses.items())}


def series_stage(df: DataFrame, nodes: dict[str, dict], known: dict[str, Column], inputs: dict[str, Column], constants: dict[str, float], key: list[str], order: list[str], time: Column, names: dict[str, str], per_key: dict[str, Column] | None) -> DataFrame:
    """df with a column for each series node, or (per_key) one row for each key with them and what per_key has."""
    ordered = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = (lambda c: c.over(Window.partitionBy(*key))) if per_key is None else (lambda c: c)
    at, lags, totals = {"__time": time.cast("double")}, {}, {}
    for text, n in nodes.items():
        name, args = names[text], [compile_node(a, inputs, constants, known) for a in n["arguments"]]
        if n["operator"] == "slope":
            at[f"__y{name}"] = args[0]
            totals[name] = total(F.regr_slope(f"__y{name}", "__time"))
        else:
            above = F.when(args[0].isNotNull() & args[1].isNotNull(), F.greatest(args[0] - args[1], F.lit(0.0)))
            at[f"__y{name}"] = above
            point = F.when(F.col(f"__y{name}").isNotNull() & F.col("__time").isNotNull(), F.struct(F.col(f"__y{name}").alias("y"), F.col("__time").alias("t")))
            before = F.last(point, ignorenulls=True).over(ordered)
            lags[f"__a{name}"] = (F.col(f"__y{name}") + before["y"]) / 2 * (F.col("__time") - before["t"])
            totals[name] = F.coalesce(total(F.sum(f"__a{name}")), F.when(total(F.count(f"__y{name}")) > 0, F.lit(0.0)))
    rows = df.withColumns(at)
    rows = rows.withColumns(lags) if lags else rows
    if per_key is not None:
        return rows.groupBy(*key).agg(*(c.alias(n) for n, c in {**totals, **per_key}.items()))
    return rows.withColumns(totals).drop(*at, *lags)


def evaluated(df: DataFrame, trees: dict[str, dict], inputs: dict[str, Column], constants: dict[str, float], key: list[str], order: list[str], time: Column, per_key: bool = False) -> DataFrame:
    """df with a column for each tree, or one row for each key with the key and the trees' values.

    inputs are Columns of df. Per key, inputs may only stand within series operators. order must tell the
    rows of a key apart where times are equal.
    """
    plan = Stages(list(trees.values()))
    known: dict[str, Column] = {}
    deepest = max(plan.series, default=0)
    names = {t: f"__s{i}" for i, t in enumerate(t for d in sorted(plan.series) for t in plan.series[d])}
    if per_key and not deepest:
        raise EquationError("without series operators there is no value of a key")
    if per_key:
        for name, t in trees.items():
            for n in outside_series(t):
                if n.get("kind") == "input":
                    raise EquationError(f"{name}: input {n.get('name')} stands outside of a series")
    rows = df
    for d in range(1, deepest + 1):
        rows, known = with_shared(rows, plan, known, inputs, constants, d - 1)
        last = per_key and d == deepest
        lower = {names[t]: F.first(names[t]) for e in range(1, d) for t in plan.series[e]} if last else None
        rows = series_stage(rows, plan.series[d], known, inputs, constants, key, order, time, names, lower)
        known = {t: c for t, c in known.items() if not last} | {t: F.col(names[t]) for e in range(1, d + 1) for t in plan.series[e]}
    if not per_key:
        rows, known = with_shared(rows, plan, known, inputs, constants, deepest)
    out = rows.withColumns({name: compile_node(t, inputs, constants, known) for name, t in trees.items()})
    return out.select(*(key if per_key else df.columns), *trees)


def outside_series(node: dict) -> list[dict]:
    """The nodes that don't lie within a series operator."""
    if node.get("kind") == "operation" and node.get("operator") in SERIES:
        return []
    return [node, *(x for c in children(node) for x in outside_series(c))]


def with_shared(rows: DataFrame, plan: Stages, known: dict[str, Column], inputs: dict[str, Column], constants: dict[str, float], d: int) -> tuple[DataFrame, dict[str, Column]]:
    """rows with a column for each shared sub-tree that has d series operators within each other."""
    mine = sorted((t for t, n in plan.shared.items() if depth(n) == d and t not in known), key=len)
    for t in mine:  # shorter ones may stand within longer ones
        name = f"__c{len(known)}"
        rows = rows.withColumn(name, compile_node(plan.shared[t], inputs, constants, known))
        known = known | {t: F.col(name)}
    return rows, known
