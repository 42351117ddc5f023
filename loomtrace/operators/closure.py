"""What evidence documents rest on: references between them as edges, and all that is reached along these."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.sources.scratch import dropped, saved

#: Prefixes of ids that evidence may be referred to by.
KINDS = ("obs", "sample", "feature", "calc", "metric", "finding", "maintenance", "inspection")

#: Joins sort neither side where every part of one is at most this large, which Spark sees once it is shuffled.
HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


def kind_of(ref: Column) -> Column:
    """The kind of document that a reference names, null if it is none of the eight."""
    return F.coalesce(*(F.when(ref.startswith(f"{k}_"), k) for k in KINDS))


def is_kind(ref: Column, kinds: Iterable[str]) -> Column:
    """Whether a reference is of one of these kinds, "" for none of the eight; Parquet skips blocks by it."""
    one_of = lambda some: reduce(or_, (ref.startswith(f"{k}_") for k in some))
    return reduce(or_, (one_of([k]) if k else ~one_of(KINDS) for k in kinds))


def reference_edges(*tables: DataFrame, repeats: bool = False) -> DataFrame:
    """(src, dst): a row for each reference of each document; tables have id and evidence_refs, an array.

    Null ids and references are left out, repeated ones count once; with `repeats` they stay, which spares a shuffle of all
    references and changes nothing in what is reached. References of another kind are refused by the contract of their
    document and are left out here.
    """
    rows = reduce(DataFrame.unionByName, (t.select(F.col("id").alias("src"), F.explode("evidence_refs").alias("dst")) for t in tables))
    rows = rows.where(F.col("src").isNotNull() & kind_of(F.col("dst")).isNotNull())
    return rows if repeats else rows.distinct()


def levels(kinds: set[str], pairs: set[tuple[str, str]]) -> list[list[str]]:
    """Kinds by level: references of the kinds `pairs` lead to a later level, or back and forth inside one."""
    beyond = {k: {k} for k in kinds}
    for _ in kinds:
        for a, b in pairs:
            beyond[a] |= beyond[b]
    rank: dict[str, int] = {}
    for k in sorted(kinds, key=lambda k: -len(beyond[k])):
        rank[k] = max((rank[a] + 1 for a in kinds if k in beyond[a] and a not in beyond[k]), default=0)
    return [sorted(k for k in kinds if rank[k] == r) for r in range(max(rank.values(), default=-1) + 1)]


def reachable(edges: DataFrame, starts: DataFrame, by: tuple[str, ...] = (), forward: bool = False, most: int | None = None) -> DataFrame:
    """(by, id, depth): what is reached from `starts`, a table with id and the columns `by`, and in how few steps.

    Backward, from a document to what it rests on, or `forward`, to what rests on it. Each set of rows with equal
    `by` is a search of its own; without `by` all starts are one. Starts are reached in no steps, so a cycle ends
    where it began, and references to unknown documents are reached like others but lead nowhere. `most` bounds the steps.

    Kinds are taken level by level (`levels`), so an edge between levels is followed once, when all of its level is
    reached. Only edges inside a level, where kinds lead back to themselves, are followed in rounds: each follows what
    the round before reached first or in fewer steps. Levels and rounds are written tables, so a lost executor costs a
    part of one; a level has as many rounds as the longest of its shortest paths has steps.
    """
    src, dst = ("dst", "src") if forward else ("src", "dst")
    kind = lambda c: F.coalesce(kind_of(F.col(c)), F.lit("")).alias(c)
    key = [*by, "id"]
    steps = saved(edges.select(F.col(src).alias("__from"), F.col(dst).alias("__to")).where("__from IS NOT NULL AND __to IS NOT NULL"), "edges")
    begin = saved(starts.where("id IS NOT NULL").select(*key).distinct().withColumn("depth", F.lit(0)), "starts")
    pairs = {tuple(r) for r in steps.select(kind("__from"), kind("__to")).distinct().collect()}
    begun = {r["id"] for r in begin.select(kind("id")).distinct().collect()}

    def between(some: list[str], others: list[str]) -> DataFrame:
        return steps.where(is_kind(F.col("__from"), some) & is_kind(F.col("__to"), others))

    def followed(rows: DataFrame, along: DataFrame) -> DataFrame:
        rows = rows if most is None else rows.where(F.col("depth") < most)
        return rows.join(along, F.col("id") == F.col("__from")).select(*by, F.col("__to").alias("id"), (F.col("depth") + 1).alias("depth"))

    def least(*rows: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, rows).groupBy(*key).agg(F.min("depth").alias("depth"))

    done: list[tuple[list[str], DataFrame]] = []
    for level in levels({k for p in pairs for k in p} | begun, pairs):
        leads = lambda some, level=level: any(a in some and b in level for a, b in pairs)
        came = [begin.where(is_kind(F.col("id"), level))] if begun & set(level) else []
        ahead = [followed(rows, between(some, level)) for some, rows in done if leads(some)]
        if not came and not ahead:
            continue
        reached = saved(least(*came, *ahead), "reached", HASHED) if ahead else came[0]
        if leads(level):
            inner = saved(between(level, level), "edges")
            found = [reached]
            while True:
                a = least(followed(found[-1], inner)).alias("a")
                k = reduce(DataFrame.unionByName, found).alias("k")
                same = reduce(lambda x, y: x & y, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in by), F.col("a.id") == F.col("k.id"))
                found.append(saved(a.join(k, same & (F.col("k.depth") <= F.col("a.depth")), "left_anti"), "reached", HASHED))
                if found[-1].isEmpty():
                    break
            reached = saved(least(*found), "reached")
            dropped(inner, *(found if ahead else found[1:]))
        done.append((level, reached))
    dropped(steps)
    return reduce(DataFrame.unionByName, (rows for _, rows in done)) if done else begin


def with_observations(samples: DataFrame, observations: DataFrame, key: str, *columns: str) -> DataFrame:
    """Samples with the named columns of the observation that each was decoded from, and `orphan`: whether there is none.

    Observations have one row for each key; null keys are orphans.
    """
    held = observations.select(key, *columns, F.lit(False).alias("orphan"))
    return samples.join(held, key, "left").withColumn("orphan", F.coalesce("orphan", F.lit(True)))
