"""Closure of references: diamonds, cycles, dangling and null references, directions, bounds; levels of kinds, random graphs."""

import random

from loomtrace.operators import closure


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def graph(spark):
    rows = [
        ("finding_1", ["calc_1", "calc_1", None]), ("calc_1", ["sample_1", "sample_2"]), ("sample_1", ["obs_1"]), ("sample_2", ["obs_1", "obs_gone"]),
        ("calc_2", ["calc_3"]), ("calc_3", ["calc_2", "calc_3", "odd"]), (None, ["obs_1"]), ("finding_2", None), ("finding_3", []), ("metric_1", ["other_1"]),
    ]
    return closure.reference_edges(spark.createDataFrame(rows, "id string, evidence_refs array<string>"))


def test_edges(spark):
    assert ("calc_3", "odd") not in found(graph(spark), "src", "dst") and graph(spark).count() == 9


def test_diamond_and_cycle(spark):
    starts = spark.createDataFrame([("finding_1", "a"), ("finding_1", "a"), ("calc_2", "b"), ("calc_1", None), ("finding_2", "c"), (None, "d")], "id string, who string")
    got = closure.reachable(graph(spark), starts, ("who",)).collect()
    assert {(r.id, r.depth) for r in got if r.who == "a"} == {("finding_1", 0), ("calc_1", 1), ("sample_1", 2), ("sample_2", 2), ("obs_1", 3), ("obs_gone", 3)}
    assert {(r.id, r.depth) for r in got if r.who == "b"} == {("calc_2", 0), ("calc_3", 1)}
    assert {(r.id, r.depth) for r in got if r.who is None} == {("calc_1", 0), ("sample_1", 1), ("sample_2", 1), ("obs_1", 2), ("obs_gone", 2)}
    assert {(r.id, r.depth) for r in got if r.who == "c"} == {("finding_2", 0)} and len(got) == 14


def test_forward_and_bound(spark):
    start = spark.createDataFrame([("obs_1",)], "id string")
    assert found(closure.reachable(graph(spark), start, forward=True), "depth", "id") == [(0, "obs_1"), (1, "sample_1"), (1, "sample_2"), (2, "calc_1"), (3, "finding_1")]
    assert found(closure.reachable(graph(spark), start, forward=True, most=1), "id") == [("obs_1",), ("sample_1",), ("sample_2",)]


def test_empty(spark):
    none = spark.createDataFrame([], "id string")
    assert closure.reachable(graph(spark), none).count() == 0
    assert found(closure.reachable(graph(spark).where("false"), spark.createDataFrame([("obs_1",)], "id string")), "id", "depth") == [("obs_1", 0)]


def test_orphan_samples(spark):
    samples = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "o long, v string")
    got = closure.with_observations(samples, spark.createDataFrame([(1, 9)], "o long, at long"), "o", "at")
    assert found(got, "v", "at", "orphan") == [("x", 9, False), ("y", None, True), ("z", None, True)]


def test_levels():
    pairs = {("finding", "calc"), ("calc", "calc"), ("calc", "sample"), ("sample", "obs"), ("sample", "inspection"), ("finding", "obs")}
    assert closure.levels({"finding", "calc", "sample", "obs", "inspection"}, pairs) == [["finding"], ["calc"], ["sample"], ["inspection", "obs"]]
    assert closure.levels({"calc", "metric", "obs", ""}, {("calc", "metric"), ("metric", "calc"), ("metric", "obs")}) == [["", "calc", "metric"], ["obs"]]
    assert closure.levels(set(), set()) == []


def test_rounds_read_edges_inside_a_level_only(spark, monkeypatch):
    """However long a chain of calculations is, its samples are joined once."""
    written, saved = [], closure.saved

    def counted(df, tag, *more):
        out = saved(df, tag, *more)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(closure, "saved", counted)
    rows = [("finding_1", ["calc_1"])] + [(f"calc_{i}", [f"calc_{i % 4 + 1}", f"sample_{i}", f"sample_{i + 1}"]) for i in range(1, 5)] + [(f"sample_{i}", ["obs_1", f"obs_{i}"]) for i in range(1, 6)]
    edges = closure.reference_edges(spark.createDataFrame(rows, "id string, evidence_refs array<string>"), repeats=True)
    assert edges.count() == 23
    got = closure.reachable(edges, spark.createDataFrame([("finding_1",)], "id string"))
    assert found(got.groupBy("depth").count(), "depth", "count") == [(0, 1), (1, 1), (2, 3), (3, 4), (4, 3), (5, 2), (6, 1)]
    assert [n for tag, n in written if tag == "edges"] == [23, 4]
    assert [n for tag, n in written if tag == "reached"] == [1, 1, 1, 1, 0, 4, 5, 5]


def test_shorter_way_found_later(spark):
    """calc_9 is first reached in five steps and then in three, over another kind's level."""
    rows = [("finding_1", ["metric_1", "calc_1"]), ("metric_1", ["metric_2"]), ("metric_2", ["metric_3"]), ("metric_3", ["calc_9"]), ("calc_1", ["calc_2"]), ("calc_2", ["calc_9"]), ("calc_9", ["calc_10"]), ("calc_10", ["obs_1"])]
    edges = closure.reference_edges(spark.createDataFrame(rows, "id string, evidence_refs array<string>"))
    got = closure.reachable(edges, spark.createDataFrame([("finding_1",)], "id string"))
    assert found(got, "id", "depth") == sorted([("finding_1", 0), ("metric_1", 1), ("metric_2", 2), ("metric_3", 3), ("calc_1", 1), ("calc_2", 2), ("calc_9", 3), ("calc_10", 4), ("obs_1", 5)])


def test_random_graphs(spark):
    """Against a plain search: edges between all kinds and others, repeats, cycles, several starts, both directions, bounds."""
    rng = random.Random(4)
    ids = [f"{k}_{i}" for k in ("calc", "metric", "sample", "obs", "odd") for i in range(12)]
    for forward, most in ((False, None), (True, 2), (False, 3)):
        near = [("calc", "calc"), ("calc", "metric"), ("metric", "sample"), ("sample", "sample"), ("sample", "obs"), ("odd", "calc")]
        pairs = [(a, b) for a in ids for b in ids if (a.split("_")[0], b.split("_")[0]) in near and rng.random() < 0.08]
        pairs += rng.choices(pairs, k=20)
        begun = [(rng.choice(ids), rng.choice(["a", "b", None])) for _ in range(5)]
        want = {}
        for who in {w for _, w in begun}:
            now, depth, seen = {i for i, w in begun if w == who}, 0, set()
            while now and (most is None or depth <= most):
                want |= {(who, i): depth for i in now}
                seen |= now
                now = {(s if forward else d) for s, d in pairs if (d if forward else s) in now} - seen
                depth += 1
        got = closure.reachable(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(begun, "id string, who string"), ("who",), forward, most).collect()
        assert {(r.who, r.id): r.depth for r in got} == want and len(got) == len(want)
