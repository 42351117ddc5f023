"""Long series made short, and readings that don't move. Ours: no contract asks for them.

Time is in microseconds; `tie` tells rows of equal times apart. Rows whose time or value is null are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators import scan


def points(df: DataFrame, key: str, time_us: str, tie: str, value: str) -> DataFrame:
    return df.where(F.col(time_us).isNotNull() & F.col(value).isNotNull()).select(key, F.col(time_us).alias("t"), tie, F.col(value).cast("double").alias("v"))


def buckets(df: DataFrame, key: str, time_us: str, tie: str, value: str, width_us: int) -> DataFrame:
    """(key, bucket, n, least, most, first, last, mean, mean_at): a row for each bucket of time that has rows.

    One aggregate that combines before its only shuffle, so a key with many rows is spread by its buckets.
    """
    rows = points(df, key, time_us, tie, value).withColumn("bucket", F.floor(F.col("t") / width_us))
    at = F.struct("t", tie)
    return rows.groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"), F.avg("v").alias("mean"), F.avg("t").alias("mean_at")
    )


def telling_points(df: DataFrame, key: str, time_us: str, tie: str, value: str, width_us: int) -> DataFrame:
    """(key, bucket, t, tie, v): of each bucket the point that makes the largest triangle with the means of the buckets beside it.

    At the ends of a series the bucket's own mean stands in. Areas count in tenths of value times seconds; of
    equal ones the later point stays. The means are a row a bucket, so only they go through a window.
    """
    w = Window.partitionBy(key).orderBy("bucket")
    means = buckets(df, key, time_us, tie, value, width_us).select(key, "bucket", "mean", "mean_at")
    beside = means.select(key, "bucket", *(F.coalesce(f(c).over(w), F.col(c)).alias(f"{n}_{c}") for f, n in ((F.lag, "before"), (F.lead, "after")) for c in ("mean", "mean_at")))
    rows = points(df, key, time_us, tie, value).withColumn("bucket", F.floor(F.col("t") / width_us)).join(beside, [key, "bucket"])
    twice = (F.col("before_mean_at") - F.col("after_mean_at")) * (F.col("v") - F.col("before_mean")) - (F.col("before_mean_at") - F.col("t")) * (F.col("after_mean") - F.col("before_mean"))
    best = F.max_by(F.struct("t", tie, "v"), F.struct(F.round(F.abs(twice) / 1e6, 1), F.col("t"), F.col(tie)))
    return rows.groupBy(key, "bucket").agg(best.alias("p")).select(key, "bucket", "p.*")


def stuck_runs(df: DataFrame, key: str, time_us: str, tie: str, value: str, tolerance: float, least_rows: int) -> DataFrame:
    """(key, run, n, start, end, least, most): runs of at least least_rows rows in which no value is more than tolerance from the one before.

    Runs are numbered by key from 1. Both scans split within keys, so neither a long run nor a key with many
    rows is one task's work.
    """
    rows = scan.carried(points(df, key, time_us, tie, value), [key], ["t", tie], {"before": (scan.LAST, F.col("v"))}, with_own=False)
    new = F.when(F.col("before").isNull() | (F.abs(F.col("v") - F.col("before")) > tolerance), 1).otherwise(0)
    runs = scan.carried(rows, [key], ["t", tie], {"run": (scan.SUM, new.cast("long"))})
    found = runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.min("v").alias("least"), F.max("v").alias("most"))
    return found.where(F.col("n") >= least_rows)
