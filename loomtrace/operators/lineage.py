"""Lineage of calculations: the equation they used, the run they recalculate, and evidence snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.canonical import canonical_json
from loomtrace.sources.scratch import dropped, saved

# What an agent that reads evidence may do.
AUTHORITY = {"may_activate_vehicle_experiment": False, "may_emit_raw_vehicle_frames": False, "may_interpret_evidence": True, "may_propose_signed_experiment_plans": True, "may_rank_hypotheses": True}


def unknown_equations(runs: DataFrame, equations: DataFrame) -> DataFrame:
    """Runs whose equation, in its version, is not in the registry."""
    return runs.join(equations.select("equation_id", "version").distinct(), ["equation_id", "version"], "left_anti")


def recalculation_roots(runs: DataFrame, id_col: str = "calculation_id", parent_col: str = "recalculation_of") -> DataFrame:
    """(id, root, depth): the run that each chain of recalculations goes back to, and how many steps.

    Pointers double each round, so a chain of n runs takes log n joins. A run whose parent is unknown is a
    root; runs of a cycle have no root and a null depth.
    """
    ids = runs.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    known = ids.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    at = ids.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up")).withColumns({"root": F.coalesce("up", "id"), "depth": F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"), "done": F.col("up").isNull()}).drop("up")
    at, left = saved(at, "lineage"), -1
    while True:
        open_runs = at.where("NOT done").count()
        if not open_runs or open_runs == left:  # only cycles are left
            break
        left = open_runs
        nxt = at.select(F.col("id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("done").alias("up_done"))
        before = at
        at = saved(at.join(nxt, "root").select("id", F.col("up").alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("up_done")).alias("done")), "lineage")
        dropped(before)
    return at.select("id", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def snapshot(states: DataFrame, results: DataFrame, key: str, generated_at: Column, order: str) -> DataFrame:
    """(key, document): by session its identity, motion and experiment results in order, as canonical JSON.

    A session without a handshake or health has no snapshot. Results of one session are one document.
    """
    listed = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in sorted(results.columns) if c not in (key, order))))).alias("experiment_results"))
    joined = states.where("handshake_version IS NOT NULL AND observed_at IS NOT NULL").join(listed, key, "left")
    none = F.array().cast(listed.schema["experiment_results"].dataType)
    doc = joined.select(
        key,
        F.lit("agent.evidence-handoff").alias("contract"),
        F.lit("1.0.0").alias("contract_version"),
        generated_at.alias("generated_at"),
        "gateway_id", "hardware_revision", "firmware_build_id", "active_config_id", "active_config_version", "vehicle_motion",
        F.coalesce("experiment_results", none).alias("experiment_results"),
        F.struct(*(F.lit(v).alias(k) for k, v in AUTHORITY.items())).alias("authority"),
    )
    return doc.select(key, canonical_json(doc.drop(key)).alias("document"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of current and changes, of each key the one of the greatest version; of equal versions the change's."""
    both = current.withColumn("__change", F.lit(0)).unionByName(changes.withColumn("__change", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(version, "__change")).alias("row")
    return both.groupBy(*keys).agg(best).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*current.columns)


def look_up(table: DataFrame, key: str, value: object) -> dict | None:
    """The row of one key, or None."""
    row = table.where(F.col(key) == F.lit(value)).limit(1).collect()
    return row[0].asDict(recursive=True) if row else None


def snake_case(name: str) -> str:
    """A field name as it is written in JSON: a capital letter after a small one or a digit begins a new part."""
    out = [name[:1].lower()]
    for a, b in zip(name, name[1:], strict=False):
        out.append(f"_{b.lower()}" if b.isupper() and not a.isupper() else b.lower())
    return "".join(out)


def with_json_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns})
