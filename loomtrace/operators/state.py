"""Latest-state projections, lineage joins and status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an outcome of a protocol test makes of its state.
OUTCOME_STATE = {"NO_LOCK": "NO_LOCK", "PASSIVE_LOCK": "NETWORK_DETECTED", "READ_CONFIRMED": "OBD_CONFIRMED", "REJECTED_ERROR": "REJECTED", "INCONCLUSIVE": "INCONCLUSIVE"}


def latest_by(df: DataFrame, key: list[str], order: list[str], columns: list[str], where: Column | None = None) -> DataFrame:
    """Per key the columns of the last row, in arrival order; combines before the shuffle."""
    row = F.max_by(F.struct(*columns), F.struct(*order))
    rows = df if where is None else df.where(where)
    return rows.groupBy(*key).agg(row.alias("row")).select(*key, *(F.col(f"row.{c}").alias(c) for c in columns))


def with_default(dimension: DataFrame, latest: DataFrame, key: str, state: str, default: str) -> DataFrame:
    """All rows of the dimension, each with its latest state or the default."""
    return dimension.join(latest, key, "left").withColumn(state, F.coalesce(state, F.lit(default)))


def outcome_state(outcome: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in OUTCOME_STATE.items() for x in kv))
    return F.when(outcome.isNull(), F.lit("NOT_TESTED")).otherwise(F.coalesce(table[outcome], F.lit("NOT_TESTED")))


def signal_bucket(rssi: Column) -> Column:
    """Signal strength by two limits; missing evidence waits and never passes."""
    return F.when(rssi.isNull(), "WAIT").when(rssi <= -90, "BLOCKED").when(rssi <= -80, "CHECK").otherwise("PASS")


def counter_level(counter: Column) -> Column:
    return F.when(counter.isNull(), "WAIT").when(counter == 0, "PASS").otherwise("CHECK")


def backoff_seconds(attempt: Column) -> Column:
    steps = [1, 2, 4, 8, 15, 30]
    return F.element_at(F.array(*map(F.lit, steps)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(steps))).cast("int"))


def orphans(refs: DataFrame, ref: str, targets: dict[str, DataFrame]) -> DataFrame:
    """References whose prefix names a table that doesn't hold them, or no table at all."""
    known = None
    for prefix, df in targets.items():
        ids = df.select(F.col(df.columns[0]).alias(ref)).where(F.col(ref).startswith(f"{prefix}_"))
        known = ids if known is None else known.unionByName(ids)
    return refs.join(known, ref, "left_anti") if known is not None else refs


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time, of equal times the greatest value: one union, one window, no range join."""
    both = left.select(key, time, F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*left.columns).alias("row"), F.lit(1).alias("side")).unionByName(
        right.select(key, time, value, F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("row"), F.lit(0).alias("side"))
    )
    w = Window.partitionBy(key).orderBy(time, "side", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").select("row.*", value)
