"""Staged equations and calculation runs against plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import contracts
from loomtrace.plans import calculations, runs, stages
from loomtrace.plans.calculations import call, given, literal
from loomtrace.plans.equations import EquationError


def slope(points):
    n, mt, my = len(points), sum(t for t, _ in points) / max(1, len(points)), sum(y for _, y in points) / max(1, len(points))
    var = sum((t - mt) ** 2 for t, _ in points)
    return sum((t - mt) * (y - my) for t, y in points) / var if n > 1 and var else None


def integral(points):
    return sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in itertools.pairwise(points)) if points else None


KNOWN: dict = {}


def plain(node, rows, k):
    """The value of a tree at row k of the ordered rows of a key; of a series once for all rows."""
    name = (json.dumps(node), id(rows), k * (node.get("operator") not in ("slope", "integral_positive_excess")))
    if name not in KNOWN:
        KNOWN[name] = worked_out(node, rows, k)
    return KNOWN[name]


def worked_out(node, rows, k):
    if node["kind"] == "literal":
        return float(node["value"])
    if node["kind"] == "input":
        return rows[k][node["name"]]
    name, args = node["operator"], node["arguments"]
    if name in ("slope", "integral_positive_excess"):
        over = [[plain(a, rows, i) for a in args] for i in range(len(rows))]
        points = [(r["t"], v[0] if name == "slope" else max(v[0] - v[1], 0.0)) for r, v in zip(rows, over, strict=True) if None not in v]
        return (slope if name == "slope" else integral)(points)
    v = [plain(a, rows, k) for a in args]
    if None in v:
        return None
    return {"add": lambda: sum(v), "subtract": lambda: v[0] - v[1], "multiply": lambda: v[0] * v[1], "divide": lambda: v[0] / v[1] if v[1] else None, "abs": lambda: abs(v[0]), "max": lambda: max(v)}[name]()


TREES = {
    "plain": call("add", given("x"), call("multiply", given("y"), given("y"))),
    "one": call("slope", given("x")),
    "both": call("subtract", call("integral_positive_excess", given("x"), literal(1)), call("slope", given("x"))),
    "deep": call("integral_positive_excess", call("subtract", given("x"), call("multiply", call("slope", call("subtract", given("x"), call("integral_positive_excess", given("y"), call("slope", given("y"))))), given("y"))), literal(0.5)),
    "mixed": call("divide", call("abs", call("subtract", given("x"), call("slope", given("x")))), call("max", literal(1), call("abs", call("subtract", given("x"), call("slope", given("x")))))),
    "moving": call("integral_positive_excess", given("x"), given("y")),
}


def test_staged_trees(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, float(i // 2), rng.choice([None, rng.uniform(-3, 5)]), rng.uniform(0, 2)) for i in range(120)] + [("single", 500, 1.0, 2.0, 1.0), ("empty", 501, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, t double, x double, y double").repartition(5)
    inputs = {"x": F.col("x"), "y": F.col("y")}
    by_key = {}
    for k, i, t, x, y in rows:
        by_key.setdefault(k, []).append({"id": i, "t": t, "x": x, "y": y})
    close = lambda a, b: a is None and b is None or None not in (a, b) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    out = stages.evaluated(df, TREES, inputs, {}, ["k"], ["t", "id"], F.col("t"))
    assert out.columns == [*df.columns, *TREES]
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, own in by_key.items():
        for n, r in enumerate(own):
            for name, tree in TREES.items():
                assert close(got[r["id"]][name], plain(tree, own, n)), (name, k, n)
    of_key = {n: t for n, t in TREES.items() if n in ("one", "both", "deep", "moving")}
    for r in stages.evaluated(df, of_key, inputs, {}, ["k"], ["t", "id"], F.col("t"), per_key=True).collect():
        assert all(close(r[name], plain(tree, by_key[r.k], 0)) for name, tree in of_key.items())


def test_stages_share_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0)], "k int, id int, t double, x double, y double")
    plan = stages.evaluated(df, TREES, {"x": F.col("x"), "y": F.col("y")}, {}, ["k"], ["t", "id"], F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = stages.Stages(list(TREES.values()))
    assert {d: len(s) for d, s in plan.series.items()} == {1: 4, 2: 1, 3: 1, 4: 1}
    assert len(plan.shared) == 1  # the absolute difference in `mixed`
    for tree in (call("slope"), call("slope", given("x"), literal(1)), call("integral_positive_excess", given("x"))):
        with pytest.raises(EquationError):
            stages.evaluated(df, {"v": tree}, {"x": F.col("x")}, {}, ["k"], ["t"], F.col("t"))
    for tree in (given("x"), call("add", given("x"), call("slope", given("x")))):
        with pytest.raises(EquationError):
            stages.evaluated(df, {"v": tree}, {"x": F.col("x")}, {}, ["k"], ["t"], F.col("t"), per_key=True)


def simple(name, *needs, **derived):
    inputs = {n: ("1", 10, ["GOOD"]) for n in [*needs, *derived]}
    return runs.Equation(calculations.definition(name, call("add", *map(given, inputs)), inputs, "1"), derived)


def test_order_of_a_registry():
    a, b, c, d = simple("e.a", "x"), simple("e.b", p="e.a"), simple("e.c", p="e.a", q="e.b"), simple("e.d", "x", p="e.c")
    for some in itertools.permutations([a, b, c, d]):
        plan = runs.planned(list(some))
        assert [e.id for e in plan.order] == ["e.a", "e.b", "e.c", "e.d"] and plan.refused == {}
    around = [a, simple("e.l", p="e.n"), simple("e.m", p="e.l"), simple("e.n", p="e.m", q="e.a"), simple("e.o", p="e.n", q="e.a"), simple("e.p", p="e.nowhere"), simple("e.q", p="e.p")]
    plan = runs.planned(around)
    assert [e.id for e in plan.order] == ["e.a"]
    assert plan.refused == {"e.l": "on a cycle: e.l -> e.n -> e.m -> e.l", "e.m": "on a cycle: e.m -> e.l -> e.n -> e.m", "e.n": "on a cycle: e.n -> e.m -> e.l -> e.n", "e.o": "needs e.n, which is unavailable", "e.p": "no equation e.nowhere", "e.q": "needs e.p, which is unavailable"}
    with pytest.raises(EquationError):
        runs.planned([a, simple("e.a", "y")])
    with pytest.raises(EquationError):
        runs.planned([runs.Equation(calculations.definition("e.z", call("add", given("other")), {"x": ("1", 1, ["GOOD"])}, "1"))])


def test_runs_are_valid_documents(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = runs.runs(calculations.line_inputs(lines), calculations.REGISTRY, ["l_orderkey", "l_linenumber", "l_partkey"], "at_ms")
    vehicle = F.concat(F.lit("veh_"), F.lpad(F.col("l_orderkey").cast("string"), 26, "0"))
    docs = runs.documents(found, "at_ms", vehicle, {"vehicle_config_pack": "1.0.0", "equation_contract": "1.0.0", "runtime": "1.0.0"})
    assert docs.count() > 3000
    assert contracts.contract_errors(docs, "document", "l_orderkey", only=("calculation.run",)).collect() == []
    doc = json.loads(docs.where("run.equation_id = 'order.taxed'").first().document)
    assert [i["name"] for i in doc["inputs"]] == ["net", "tax"] and doc["inputs"][0]["evidence_ref"].startswith("calc_")
    assert math.isclose(doc["output"]["value"], doc["inputs"][0]["value"] * doc["intermediates"][0]["value"])
    assert doc["confidence"] == min(doc["confidence_factors"].values())
    # The run of net that taxed rests on is there.
    refs = docs.where("run.equation_id = 'order.taxed'").select(F.col("run.inputs")[0]["evidence_ref"].alias("ref"))
    made = found.where("run.equation_id = 'order.net'").select(F.col("run.evidence_ref").alias("ref"))
    assert refs.join(made, "ref", "left_anti").count() == 0


def test_missing_inputs(spark):
    """Null structs, null values, stale and refused ones; a derived input that wasn't calculated; division by zero; bounds on both sides."""
    kind = "struct<value:double,age_ms:long,quality:string,evidence_ref:string>"
    rows = [(1, (4.0, 5, "GOOD", "s1"), (2.0, 0, "GOOD", "s2")), (2, None, (2.0, 0, "GOOD", "s2")), (3, (4.0, 5, "GOOD", "s1"), (None, 0, "GOOD", "s2")), (4, (4.0, 11, "GOOD", "s1"), (2.0, 0, "STALE", "s2")), (5, (4.0, 10, "GOOD", "s1"), (0.0, 0, "GOOD", "s2")), (6, (4000.0, 1, "GOOD", "s1"), (2.0, 0, "GOOD", "s2")), (7, (-4.0, None, "GOOD", "s1"), (2.0, 0, None, "s2")), (8, (-4.0, 1, "GOOD", "s1"), (2.0, 0, "GOOD", "s2"))]
    df = spark.createDataFrame([(i, 1000, a, b) for i, a, b in rows], f"id long, at long, x {kind}, y {kind}")
    ratio = runs.Equation(calculations.definition("e.ratio", call("divide", given("x"), given("y")), {"x": ("1", 10, ["GOOD"]), "y": ("1", 0, ["GOOD"])}, "1", minimum=0.0, maximum=100.0))
    twice = runs.Equation(calculations.definition("e.twice", call("multiply", literal(2), given("r")), {"r": ("1", 10, ["GOOD"])}, "1"), {"r": "e.ratio"})
    got = {(r.id, r.run.equation_id): (r.run.status, r.run.value, tuple(r.run.reasons)) for r in runs.runs(df, [twice, ratio], ["id"], "at").collect()}
    bad, none = "too old or of a quality that is not accepted", ("UNAVAILABLE", None)
    expected = {1: ("CALCULATED", 2.0, ()), 2: (*none, ("x: missing",)), 3: (*none, ("y: missing",)), 4: (*none, (f"x: {bad}", f"y: {bad}")), 5: (*none, ("no value",)), 6: ("OUT_OF_RANGE", None, ("outside of the output's bounds",)), 7: (*none, (f"x: {bad}", f"y: {bad}")), 8: ("OUT_OF_RANGE", None, ("outside of the output's bounds",))}
    assert {i: got[i, "e.ratio"] for i in expected} == expected
    assert {i: got[i, "e.twice"] for i in expected} == {i: ("CALCULATED", 4.0, ()) if i == 1 else (*none, ("r: missing",)) for i in expected}
    assert runs.runs(df.limit(0), [ratio], ["id"], "at").collect() == []
