"""Prefix scans, overlaps of ranges of any width, and alignment, against brute force, with keys that go over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import alignment, ranges, scan, series


def test_carried(spark):
    """A key with most rows, single-row keys and a null key; values with nulls."""
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 7, None, *range(20, 60)]), t, rng.choice([None, rng.randrange(100)])) for t in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(5)
    states = {"last": (scan.LAST, F.col("v")), "most": (scan.MOST, F.col("v")), "total": (scan.SUM, F.col("v"))}
    got = {(r.k, r.t): (r.last, r.most, r.total) for r in scan.carried(df, ["k"], ["t"], states).collect()}
    seen: dict = {}
    for k, t, v in rows:
        s = seen.setdefault(k, [])
        s += [v] if v is not None else []
        assert got[k, t] == ((s[-1], max(s), sum(s)) if s else (None, None, None))
    whole = {r.t: r.total for r in scan.carried(df, [], ["t"], {"total": (scan.SUM, F.lit(1))}).collect()}
    assert whole == {t: t + 1 for t in range(900)}
    assert scan.carried(df.limit(0), ["k"], ["t"], states).collect() == []


def drawn(rng, n, far):
    rows = []
    for i in range(n):
        s = rng.randrange(-far, far)
        rows.append((i, s, s + rng.choice([0, 1, 2, 3, 17, 64, 65, 1000, -5, -300])))
    return rows


@pytest.mark.parametrize("full", [20_000, 30])
def test_overlaps_of_any_width(spark, monkeypatch, full):
    """Empty, inverted, equal and very long ranges: literal rule, on both sides of the limit of rows, in pairs, and with full cells dealt."""
    rng = random.Random(full)
    monkeypatch.setattr(ranges, "FULL", full)
    left = [*drawn(rng, 300, 2000), (1000, -(10**12), 10**12), (1001, 5, 5), (1002, None, 3), (1003, 4, None), (1004, 7, 2), (1005, -(2**62), 2**62 - 1)]
    right = [*drawn(rng, 200, 3000), *((900 + i, 40, 45) for i in range(60)), (2000, 0, 10**12), (2001, 10**13, 10**13 + 1), (2002, None, None), (2003, 9, 1)]
    pairs = {(a, b) for a, s, e in left for b, s2, e2 in right if None not in (s, e, s2, e2) and s < e2 and e > s2}
    lf, rf = spark.createDataFrame(left, "id long, start long, end long"), spark.createDataFrame(right, "id long, start long, end long")
    for small in (10_000, 10):
        monkeypatch.setattr(ranges, "SMALL", small)
        got = sorted(r.id for r in ranges.overlapping(lf, rf).collect())
        assert got == sorted({a for a, _ in pairs})
    found = [(r.left.id, r.right.id) for r in ranges.overlap_pairs(lf, rf).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    assert ranges.overlap_pairs(lf.limit(0), rf).collect() == []


def test_one_very_long_range_among_many_short_ones(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 10)
    short = spark.range(200_000).select((F.col("id") * 10).alias("start"), (F.col("id") * 10 + 3).alias("end"))
    right = short.where("start % 70 = 0").unionByName(spark.createDataFrame([(1_000_000, 10**12)], "start long, end long"))
    got = ranges.overlapping(short, right)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    expected = short.where("start % 70 = 0 OR end > 1000000")
    assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()
    pairs = ranges.overlap_pairs(short, right)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.where("right.end = 1000000000000").count() == 200_000 - 100_000 and pairs.where("right.end < 1000000000000").count() == 28_572


def plain_inputs(requests, samples, inputs):
    out = []
    for rid, k, t in requests:
        row = [rid]
        for i in inputs:
            known = [s for s in samples if s[0] == k and t is not None and s[2] is not None and s[2] <= t and s[1] == i.signal and s[4] in i.accepted_quality]
            best = max(known, key=lambda s: (s[2], s[5]), default=None)
            row.append((best[3], (t - best[2]) // 1000, best[4], best[5]) if best and t - best[2] <= 1000 * i.maximum_age_ms else None)
        out.append(tuple(row))
    return sorted(out)


def test_aligned_inputs(spark):
    """Three inputs with their own ages and qualities; a user with most rows goes over all partitions; ties, null times, keys and qualities."""
    rng = random.Random(4)
    key = lambda: rng.choice([1, 1, 1, 1, 1, 2, 3, None])
    samples = [(key(), rng.choice(["a", "b", "c", "d"]), rng.choice([None, *range(0, 4_000_000, 500)]), rng.choice([None, 1.5, 2.5]), rng.choice(["GOOD", "SUSPECT", None, "BAD"]), f"s{n:05}") for n in range(900)]
    requests = [(n, key(), rng.choice([None, *range(0, 4_000_000, 500)])) for n in range(300)]
    inputs = [alignment.Input("x", "a", 60, ("GOOD",)), alignment.Input("y", "b", 400, ("GOOD", "SUSPECT")), alignment.Input("z", "a", 0, ("GOOD", "BAD"))]
    rf = spark.createDataFrame(requests, "request_id long, user long, t long").repartition(3)
    sf = spark.createDataFrame(samples, "user long, signal_id string, t long, value double, quality string, evidence_ref string").repartition(4)
    got = sorted((r.request_id, *(tuple(r[i.name]) if r[i.name] else None for i in inputs)) for r in alignment.aligned(rf, sf, "user", "t", inputs, "evidence_ref").collect())
    expected = plain_inputs([r for r in requests if r[1] is not None], [s for s in samples if s[0] is not None], inputs)
    expected = sorted(expected + plain_inputs([(a, "none", c) for a, b, c in requests if b is None], [("none", *s[1:]) for s in samples if s[0] is None], inputs))
    assert got == expected and sum(x[1] is not None for x in got) > 30
    assert alignment.aligned(rf.limit(0), sf, "user", "t", inputs, "evidence_ref").collect() == []
    assert alignment.aligned(rf, sf.limit(0), "user", "t", inputs, "evidence_ref").where("x IS NOT NULL").count() == 0


def test_stuck_runs(spark):
    """A key with most rows goes over all partitions, one of its runs over several; ties, null values and times."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice([i, i - i % 3]), 7.0 if 200 < i < 900 else rng.choice([None, 1.0, 1.5, 9.0])) for i in range(1200)] + [(rng.choice([2, None]), i, rng.choice([None, i]), rng.choice([1.0, 5.0])) for i in range(60)]
    expected = set()
    for key in (1, 2, None):
        before, runs = None, []
        for k, i, t, v in sorted((r for r in rows if r[0] == key and r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[1])):
            if before is None or abs(v - before) > 0.6:
                runs.append([])
            runs[-1].append((t, v))
            before = v
        expected |= {(key, n, len(r), r[0][0], r[-1][0], min(v for _, v in r), max(v for _, v in r)) for n, r in enumerate(runs, 1) if len(r) >= 2}
    df = spark.createDataFrame(rows, "k long, i long, at long, v double").repartition(5)
    got = {tuple(r) for r in series.stuck_runs(df, "k", "at", "i", "v", 0.6, 2).collect()}
    assert got == expected and max(n for _, _, n, *_ in got) >= 699


def test_telling_points(spark):
    """A spike in each bucket is the point that stays; buckets of one row, an empty table."""
    rows = [("a", i, i * 10_000_000, 50.0 if i % 10 == 3 else float(i % 2)) for i in range(100)] + [("b", 0, 5, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, at long, v double")
    got = {(r.k, r.bucket): (r.i, r.v) for r in series.telling_points(df, "k", "at", "i", "v", 100_000_000).collect()}
    assert got == {("b", 0): (0, 1.0)} | {("a", b): (b * 10 + 3, 50.0) for b in range(10)}
    assert series.telling_points(df.limit(0), "k", "at", "i", "v", 100_000_000).collect() == []
    bucket = next(r for r in series.buckets(df, "k", "at", "i", "v", 100_000_000).collect() if r.k == "a" and r.bucket == 2)
    assert (bucket.n, bucket.least, bucket.most, bucket.first, bucket.last) == (10, 0.0, 50.0, 0.0, 1.0)
