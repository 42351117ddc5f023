"""Order and gaps within a key: contiguity, increasing time, and gap accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: list[str | Column], *columns: str) -> DataFrame:
    """Add `previous_<column>`: the value in the row before, in arrival order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def contiguity_violations(df: DataFrame, key: str, order: list, sequence: str) -> DataFrame:
    """Rows whose sequence isn't one more than the row before; any first value is right."""
    rows = with_previous(df, key, order, sequence)
    return rows.where(F.col(f"previous_{sequence}").isNotNull() & (F.col(sequence) != F.col(f"previous_{sequence}") + 1))


def time_violations(df: DataFrame, key: str, order: list, time: str) -> DataFrame:
    """Rows whose time isn't after that of the row before; equal times are wrong."""
    rows = with_previous(df, key, order, time)
    return rows.where(F.col(time) <= F.col(f"previous_{time}"))


def gap_account(df: DataFrame, key: str, order: list, sequence: str) -> DataFrame:
    """By key: frames, discontinuities, and missing frames, of which only forward jumps count; never reordered."""
    expected = F.col(f"previous_{sequence}") + 1
    jump = F.col(sequence) - expected
    rows = with_previous(df, key, order, sequence)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"),
        F.coalesce(F.sum(F.when(jump != 0, 1)), F.lit(0)).alias("discontinuities"),
        F.coalesce(F.sum(F.when(jump > 0, jump)), F.lit(0)).alias("missing"),
    )


def prefix_offsets(df: DataFrame, key: str, order: list, size: str) -> DataFrame:
    """Add `start`: the sum of the sizes of the rows before, 0 for the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def tail(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The last k rows of each key, by descending order columns."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= k)
