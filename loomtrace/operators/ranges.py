"""Overlap of half-open ranges: one begins below the other's end and ends above its start.

That rule holds literally at every size: an empty range overlaps what it lies inside of, and one whose end is
below its start overlaps what reaches over both of its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import scan
from loomtrace.sources.scratch import saved

#: Rows up to which the right side goes to all executors and is compared row by row.
SMALL = 10_000
#: Rows of a cell on one side beyond which the cell is dealt to several tasks.
FULL = 20_000


def overlapping(left: DataFrame, right: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Left rows that overlap any right range.

    A small right side is broadcast, after its rows were counted. A larger one is swept: right ranges stand
    at their start, left ones at their end, and a left range overlaps if the greatest end of the right
    ranges before it is above its start. Each range is one row, however long; no range is compared with
    another. Ranges with a null end overlap nothing.
    """
    r = right.select(F.col(start).alias("__s"), F.col(end).alias("__e"))
    touch = (F.col(start) < F.col("__e")) & (F.col(end) > F.col("__s"))
    if r.limit(SMALL + 1).count() <= SMALL:
        return left.join(F.broadcast(r), touch, "left_semi")
    row = F.struct(*left.columns)
    at = left.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(end).alias("__at"), F.lit(0).alias("__side"), F.xxhash64(start, end).alias("__tie"), row.alias("__row"), F.lit(None).cast(r.schema["__e"].dataType).alias("__e"))
    none = F.lit(None).cast(at.schema["__row"].dataType)
    swept = at.unionByName(r.where("__s IS NOT NULL AND __e IS NOT NULL").select(F.col("__s").alias("__at"), F.lit(1).alias("__side"), F.xxhash64("__s", "__e").alias("__tie"), none.alias("__row"), "__e"))
    reached = scan.carried(swept, [], ["__at", "__side", "__tie"], {"__reach": (scan.MOST, F.col("__e"))})
    return reached.where((F.col("__side") == 0) & (F.col("__reach") > F.col(f"__row.{start}"))).select("__row.*")


def level(start: Column, end: Column) -> Column:
    """The least n at which a cell of 2^n is as long as the range; exact in integers."""
    length = F.greatest(end, start) - F.least(end, start)
    return F.length(F.bin(F.greatest(length, F.lit(1)) - 1)) - F.when(length <= 1, 1).otherwise(0)


def cells_at(start: Column, end: Column, n: Column) -> Column:
    """The cells of 2^n that the range touches, its ends too: two at most from its own level on."""
    first, last = F.call_function("shiftright", F.least(start, end), n), F.call_function("shiftright", F.greatest(start, end), n)
    return F.array_distinct(F.array(first, last))


def overlap_pairs(left: DataFrame, right: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """All pairs of left and right rows that overlap: structs `left` and `right`. Ends are whole numbers.

    Cells are of the sizes 1, 2, 4 and so on. A range of the level of its length touches at most two cells
    there. A pair meets at the level of its longer range: that one stands in its own cells, the shorter one
    in those of every level above its own at which the other side has ranges, at most two each, so a range
    takes at most 128 cells however long it is. A pair that shares two cells counts in the lower one. Cells
    with many ranges of both sides are dealt: the fuller side by hash, the other one copied to each part.
    """
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.struct("*").alias(name), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
        sides.append(rows.withColumn("level", level(F.col("s"), F.col("e"))))
    found = None
    for long_side in (0, 1):
        own, other = sides[long_side], sides[1 - long_side]
        levels = [r[0] for r in own.select("level").distinct().collect()]  # at most 64
        if not levels:
            continue
        higher = F.filter(F.array(*map(F.lit, sorted(levels))), lambda n: n >= F.col("level") if long_side else n > F.col("level"))  # noqa: B023
        longer = own.withColumn("cell", F.explode(cells_at(F.col("s"), F.col("e"), F.col("level")))).withColumnsRenamed({"s": "ls", "e": "le"})
        shorter = other.withColumn("level", F.explode(higher)).withColumn("cell", F.explode(cells_at(F.col("s"), F.col("e"), F.col("level"))))
        longer, shorter = dealt(longer, shorter)
        touch = (F.col("ls") < F.col("e")) & (F.col("le") > F.col("s"))
        # The first cell that both touch.
        first = F.greatest(F.call_function("shiftright", F.least("ls", "le"), F.col("level")), F.call_function("shiftright", F.least("s", "e"), F.col("level")))
        pairs = longer.join(shorter, ["level", "cell", "part"]).where(touch & (F.col("cell") == first)).select("left", "right")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else left.select(F.struct("*").alias("left")).limit(0).join(right.select(F.struct("*").alias("right")).limit(0), how="cross")


def dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `part`: in full cells the fuller side's rows are dealt, the other side's stand in each part."""
    cell = ["level", "cell"]
    counts = [x.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "n"), (b, "m"))]
    full = counts[0].join(counts[1], cell).where(F.greatest("n", "m") > FULL)
    full = saved(full.select(*cell, (F.col("n") >= F.col("m")).alias("first"), F.ceil(F.greatest("n", "m") / FULL).alias("parts")), "full-cells")
    if full.isEmpty():
        return a.withColumn("part", F.lit(0).cast("long")), b.withColumn("part", F.lit(0).cast("long"))
    out = []
    for x, own in ((a, F.col("first")), (b, ~F.col("first"))):
        one = F.array(F.pmod(F.xxhash64(*(c for c in x.columns)), "parts"))
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(own, one).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        out.append(x.join(full, cell, "left").withColumn("part", F.explode(part)).drop("first", "parts"))
    return out[0], out[1]
