"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Inner products become distances once every vector gets one more component that brings all to the same norm M:
of an anchor a (with 0 there) and a row c, a.c = (|a|^2 + M^2 - d^2) / 2. Rows go to the cell of their nearest
pivot, with their distance from it; anchors go to groups by their nearest pivot, large groups are split by hash.
For each group and cell the bounds of the group's anchors give an interval of distances from the pivot, by
the triangle inequality: only rows inside are sent to that group. There anchors and rows, in blocks of bounded
size, are compared in exact integers; the best of the blocks are merged.

Two joins: the nearest rows of the anchor's own label (their distance is first bounded by the radii of the few
rows of that label nearest to each pivot), then rows of other labels with scores in the windows that those give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, saved, table
from .vectors import exact_kind, extent, finite, integers, lists, matrix

POSITIVES, NEGATIVES, SCALE = 5, 3, 256.0
#: Least and most of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Cells; anchors of a group and rows of a block on average.
PIVOTS, GROUP, BLOCK = 32, 512, 16_384
#: Anchors of a block that are compared at once.
STEP = 64
FOUND = pa.schema([(n, pa.int64()) for n in ("anchor_row", "anchor_id", "window", "row", "id", "score")])


@dataclass
class Space:
    """The pivots (integers, a row each), the norm M to which all are brought, and the type in which scores are exact."""

    pivots: np.ndarray
    norm: float
    kind: np.dtype

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (self.norm + 1.0)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each row of x to each pivot; anchors have no component beside their own."""
        x, p, m = x.astype(np.float64), self.pivots.astype(np.float64), self.norm**2
        own = (x * x).sum(axis=1)
        rest = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(m - own, 0))
        whole = own if anchors else np.full(len(x), m)
        square = whole[:, None] + m - 2 * (x @ p.T + rest[:, None] * np.sqrt(np.maximum(m - (p * p).sum(axis=1), 0))[None, :])
        return np.sqrt(np.maximum(square, 0))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has that score with the anchors x."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.norm**2 - 2 * score, 0))


def placed(kept: DataFrame, space: Space, homes: int) -> DataFrame:
    """kept with the cell of each row, its distance from the cell's pivot, and of anchors the home: the nearest of the first pivots."""
    width, kind = space.pivots.shape[1], space.kind
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), width, kind)
            far = space.distances(x, anchors=False)
            cell = far.argmin(axis=1)
            home = space.distances(x, anchors=True)[:, :homes].argmin(axis=1)
            columns = [lists(x.astype(np.int64), pa.int64()) if n == "vector" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array(home.astype(np.int32))], names=[*names, "cell", "radius", "home"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", cell int, radius double, home int")


def intervals(anchors: DataFrame, space: Space) -> DataFrame:
    """(key, home, chunk, cell, low, high): between which distances from its pivot a cell's rows may serve an anchor of the group.

    Anchors have near and far: a row serves them only at a distance between these.
    """
    width, kind, cells = space.pivots.shape[1], space.kind, len(space.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            d = space.distances(matrix(b.column("vector"), width, kind), anchors=True)
            near, far = b.column("near").to_numpy()[:, None], b.column("far").to_numpy()[:, None]
            low, high = np.maximum(d - far, near - d) - space.slack, d + far + space.slack
            groups = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "home", "chunk")], axis=1)
            names, at = np.unique(groups, axis=0, return_inverse=True)
            at = at.reshape(-1)
            least, most = np.full((len(names), cells), np.inf), np.full((len(names), cells), -np.inf)
            np.minimum.at(least, at, low)
            np.maximum.at(most, at, high)
            columns = [pa.array(np.repeat(names[:, i], cells)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(cells, dtype=np.int32), len(names))), pa.array(least.reshape(-1)), pa.array(most.reshape(-1))], names=["key", "home", "chunk", "cell", "low", "high"])

    found = anchors.select("key", "home", "chunk", "vector", "near", "far").mapInArrow(run, "key long, home long, chunk long, cell int, low double, high double")
    return found.groupBy("key", "home", "chunk", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def best(scores: np.ndarray, number: int, none: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, scores) of the best column of each row, then of the next; of equal ones the first. Overwrites scores."""
    for _ in range(min(number, scores.shape[1])):
        at = scores.argmax(axis=1)
        rows = np.flatnonzero(scores[np.arange(len(at)), at] != none)
        if not len(rows):
            return
        yield rows, at[rows], scores[rows, at[rows]]
        scores[rows, at[rows]] = none


def searched(rows: DataFrame, anchors: DataFrame, space: Space, own_label: bool, number: int) -> DataFrame:
    """Of each anchor the best rows of its label, or in each of its windows those of others: (anchor_row, anchor_id, window, row, id, score).

    anchors have key (the label in the first case, else 0), home, near, far and windows, lists of the least
    and the most score.
    """
    width, kind = space.pivots.shape[1], space.kind
    none = -np.inf if kind == np.float64 else np.iinfo(np.int64).min
    count = anchors.groupBy("key", "home").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("chunks"))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks"))
    grouped = saved(anchors.join(count, ["key", "home"]).withColumn("chunk", chunk).drop("chunks"), "anchors")
    keyed = rows.select("row", "id", "label", "vector", "cell", "radius", (F.col("label") if own_label else F.lit(0).cast("long")).alias("key"))
    cells = keyed.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    plan = intervals(grouped, space).join(cells, ["key", "cell"]).where("low <= most AND high >= least")
    plan = saved(plan.select("key", "home", "chunk", "cell", "low", "high", "n"), "serving-cells")
    blocks = plan.groupBy("key", "home", "chunk").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    plan = plan.join(blocks, ["key", "home", "chunk"])
    group = ["key", "home", "chunk", "block"]
    sent = keyed.join(plan.drop("n"), ["key", "cell"]).where("radius >= low AND radius <= high")
    sent = sent.select("key", "home", "chunk", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").alias("block"), "row", "id", "label", "vector")
    asked = grouped.join(blocks, ["key", "home", "chunk"]).select("key", "home", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "row", "id", "label", "vector", "lows", "highs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids = right.column("id").combine_chunks()
            # Of equal scores the smaller id comes first, null ids last.
            order = np.lexsort((right.column("row").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
            right = right.take(pa.array(order))
            other, label, row = matrix(right.column("vector"), width, kind), right.column("label").to_numpy(), right.column("row").to_numpy()
            for i in range(0, len(left), STEP):
                some = left.slice(i, STEP)
                scores = matrix(some.column("vector"), width, kind) @ other.T
                same = some.column("label").to_numpy()[:, None] == label[None, :]
                scores[~same | (some.column("row").to_numpy()[:, None] == row[None, :]) if own_label else same] = none
                if own_label:
                    out += [(i + r, np.zeros(len(r), dtype=np.int64), c, s) for r, c, s in best(scores, number, none)]
                    continue
                lows, highs = some.column("lows").to_pylist(), some.column("highs").to_pylist()
                for w in range(max(map(len, lows))):
                    have = np.flatnonzero([len(x) > w for x in lows])
                    part = scores[have]
                    part[(part < np.array([lows[h][w] for h in have])[:, None]) | (part > np.array([highs[h][w] for h in have])[:, None])] = none
                    out += [(i + have[r], np.full(len(r), w), c, s) for r, c, s in best(part, number, none)]
        a, w, c, s = (np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.zeros(0, dtype=np.int64) for k in range(4))
        if not len(a):
            return FOUND.empty_table()
        return pa.table([left.column("row").take(pa.array(a)), left.column("id").take(pa.array(a)), pa.array(w), right.column("row").take(pa.array(c)), right.column("id").take(pa.array(c)), pa.array(s)], names=FOUND.names)

    found = asked.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(run, ", ".join(f"{n} long" for n in FOUND.names))
    w = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return saved(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= number), "nearest")


def bounded(anchors: DataFrame, rows: DataFrame, space: Space, number: int) -> DataFrame:
    """anchors with near (0) and far, at least the distance of the number-th nearest other row of the label.

    Of each label and cell the rows nearest to the pivot are known by their radius; an anchor is at most its
    own distance from the pivot and that radius away. One row more is counted, as one may be the anchor.
    """
    width, kind = space.pivots.shape[1], space.kind
    w = Window.partitionBy("label", "cell").orderBy("radius")
    some = rows.select("label", "cell", "radius").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= number + 1)
    some = some.groupBy("label").agg(F.collect_list(F.struct("cell", "radius")).alias("known"))  # at most number + 1 for each cell
    some = some.select("label", F.col("known.cell").alias("cells"), F.col("known.radius").alias("radii"))
    names = [*anchors.columns, "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, labels, far = space.distances(matrix(b.column("vector"), width, kind), anchors=True), b.column("label").to_numpy(), np.full(len(b), np.inf)
            for label, first in zip(*np.unique(labels, return_index=True), strict=True):
                at, cells, radii = np.flatnonzero(labels == label), np.array(b.column("cells")[first].as_py()), np.array(b.column("radii")[first].as_py())
                if len(cells) > number:
                    far[at] = np.partition(d[at][:, cells] + radii[None, :], number, axis=1)[:, number]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-2]), pa.array(np.zeros(len(b))), pa.array(far)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.join(some, "label").mapInArrow(run, f"{kinds}, near double, far double")


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first `negatives` rows of other labels in the window of each positive.

    Positives of an anchor are the first rows of its label beside itself, by score (inner product of the
    integers floor(scale * x)), of equal scores those of smaller ids, nulls last. Negatives have low to high
    hundredths of the positive's score. Rows whose label or vector is null, or whose vector holds null or
    non-finite components, take no part; ids and labels are integers. Repeated rows are rows like any other,
    anchors and positives of each other too. Vectors shorter than others count as filled up with zeros;
    scores beyond a long are refused with a ValueError. An empty table, or none of some kind of row, gives
    an empty result; other columns, whatever their names, are ignored.
    """
    fit = finite(named(vector_col)) & named(label_col).isNotNull()
    kept = vectors.where(fit).select(named(id_col).cast("long").alias("id"), named(label_col).cast("long").alias("label"), integers(named(vector_col), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    width, most, norm, asked = extent(kept, "vector", F.max(square("vector")), F.count_if("anchor"))
    kind = exact_kind(100 * max(width, 1) * most**2)
    few = kept.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(4 * PIVOTS).collect()  # repeated rows may be among them
    pivots = list(dict.fromkeys(tuple(r["vector"]) for r in few))[:PIVOTS]
    space = Space(matrix(pa.array(pivots, pa.list_(pa.int64())), width, kind), float(np.sqrt(norm or 0.0)), kind)
    rows = saved(placed(kept, space, max(1, min(len(pivots), -(-asked // GROUP)))), "placed")
    anchors = rows.where("anchor").select("row", "id", "label", "vector", F.col("home").cast("long").alias("home"))

    first = bounded(anchors, rows, space, positives).withColumn("key", F.col("label")).withColumns({c: F.lit(None).cast("array<long>") for c in ("lows", "highs")})
    found = searched(rows, first, space, True, positives)
    least, greatest = F.expr(f"({low} * score + 99) div 100"), F.expr(f"{high} * score div 100")  # of no negative score is there a window
    windows = found.where("score >= 0").select("anchor_row", F.struct("rank", least.alias("low"), greatest.alias("high"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).alias("w")).where("w.low <= w.high")
    windows = saved(windows.groupBy("anchor_row").agg(F.array_sort(F.collect_list("w")).alias("w")), "windows")  # at most `positives` of an anchor

    away = lambda score: F.sqrt(F.greatest(F.lit(0.0), square("vector") + space.norm**2 - 2 * score))
    second = anchors.join(windows, F.col("row") == F.col("anchor_row")).select("row", "id", "label", "vector", "home", F.lit(0).cast("long").alias("key"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), away(F.array_max("w.high")).alias("near"), away(F.array_min("w.low")).alias("far"))
    hard = searched(rows, second, space, False, negatives)
    of = windows.select("anchor_row", F.posexplode("w").alias("window", "w"))
    return hard.join(of, ["anchor_row", "window"]).select("anchor_id", "w.positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "w.positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir):
    vec, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, vec % 50 == 0)


SQL = f"""
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
