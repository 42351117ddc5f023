"""Connected components by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, up) of the nodes of all edges (a, b) given: up is the least node that a path leads to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for t in batches:
        for a, b in zip(t["a"].tolist(), t["b"].tolist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"a": list(above), "up": list(map(top, list(above)))}, dtype="int64")


def components(edges: DataFrame, last: int = 0) -> DataFrame:
    """(node, root) for each node of edges (a, b), two longs: nodes have the same root exactly if a path joins them.

    Each round every node joins its neighbour of least priority, if that is below its own; priorities are
    hashes that change by round, so a round leaves a constant share of the nodes on average, long chains
    and stars included. Aggregates combine before they shuffle, and tables are written between rounds, so
    lineage stays short and joins can split a node with many edges. Rounds end when at most `last` edges are
    left: one task joins those, which saves the many rounds over next to nothing.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        few = bool(last) and edges.count() <= last
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("node"))).alias("least"))
        up = F.when(F.struct(F.col("least.rank"), F.col("least.node")) < F.struct(rank("a"), F.col("a")), F.col("least.node")).otherwise(F.col("a"))
        step = saved(edges.coalesce(1).mapInPandas(joined, "a long, up long") if few else least.select("a", up.alias("up")), "step")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            moved = roots.join(step.withColumnRenamed("a", "root"), "root", "left_outer")
            roots = saved(moved.select("node", F.coalesce("up", "root").alias("root")), "roots")
        if few:
            break
        ends = edges.join(step.withColumnRenamed("up", "x"), "a").select("b", "x").join(step.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = saved(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
