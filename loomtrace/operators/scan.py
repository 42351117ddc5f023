"""Prefix scans over ordered rows in which no key needs a task of its own.

Rows are range-partitioned by key and order, so a key with many rows is a run of partitions. Each partition is
scanned by itself; for the few keys that go over a partition's end, what each partition ends with is carried
on to those after it. That table has some two rows a partition, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.sources.scratch import saved

#: Kinds of scan.
LAST, MOST, SUM = "last", "max", "sum"


def together(kind: str, before: Column, own: Column) -> Column:
    """What rows before and own rows give in one; null is none."""
    if kind == LAST:
        return F.coalesce(own, before)
    if kind == MOST:
        return F.greatest(own, before)  # skips nulls
    return F.when(own.isNull() & before.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))


def carried(df: DataFrame, key: list[str], order: list[str], states: dict[str, tuple[str, Column]], with_own: bool = True) -> DataFrame:
    """df with a column for each state: the last value that isn't null, the greatest or the sum, over the key's rows up to and with (or without) this one.

    order must tell rows of a key apart for the result to be the same in each run. Rows without key columns are one run.
    Null keys are a key like any other.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = {name: f"__in_{name}" for name in states}
    rows = df.withColumns({inputs[n]: c for n, (_, c) in states.items()})
    rows = saved(rows.repartitionByRange(parts, *key, *order).withColumn("__part", F.spark_partition_id()), "scan")
    whole = F.struct(*(key or [F.lit(0).alias("one")]))

    # Keys of more than one partition are first in one and last in another.
    ends = rows.groupBy("__part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    over = ends.groupBy(F.col("last").alias("of_key")).agg(F.count(F.lit(1)).alias("n")).join(ends.groupBy(F.col("first").alias("of_key")).agg(F.count(F.lit(1)).alias("m")), "of_key")
    over = saved(ends.select("__part", F.explode(F.array_distinct(F.array("first", "last"))).alias("of_key")).join(over, "of_key", "left_semi"), "scan-ends")
    kept = rows.withColumn("__k", whole)
    at_end = {
        n: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(*order)))["v"] if kind == LAST else F.max(c) if kind == MOST else F.sum(c)
        for n, (kind, _) in states.items()
        for c in [inputs[n]]
    }
    both = (F.col("__part") == F.col("of_part")) & (F.col("__k") == F.col("of_key"))
    named = over.withColumnRenamed("__part", "of_part")
    left = kept.join(F.broadcast(named), both, "left_semi").groupBy("__part", F.col("__k").alias("of_key")).agg(*(c.alias(n) for n, c in at_end.items()))
    before = Window.partitionBy("of_key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    over_all = {n: {LAST: lambda c: F.last(c, ignorenulls=True), MOST: F.max, SUM: F.sum}[kind] for n, (kind, _) in states.items()}
    carry = saved(left.select(F.col("__part").alias("of_part"), "of_key", *(over_all[n](F.col(n)).over(before).alias(f"__before_{n}") for n in states)), "scan-carry")

    w = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
    scanned = kept.withColumns({f"__own_{n}": over_all[n](F.col(inputs[n])).over(w) for n in states})
    joined = scanned.join(F.broadcast(carry), both, "left")
    return joined.select(*df.columns, *(together(kind, F.col(f"__before_{n}"), F.col(f"__own_{n}")).alias(n) for n, (kind, _) in states.items()))
