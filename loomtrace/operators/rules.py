"""Rules on rows: each is a named predicate that a row must meet; what fails is a violation row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.ids import is_domain_id
from loomtrace.functions.schemas import QUALITY, SOURCE_KINDS

# Fixed values of the contract of raw observations: patterns and limits, here and in raw_observation_rules.
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"
SHA256, HEX = "^[0-9a-f]{64}$", "^(?:[0-9a-f]{2})*$"


@dataclass(frozen=True)
class Rule:
    """`met` is true where the row is right; null counts as wrong."""

    name: str
    met: Column
    message: Column | str = ""


def implies(condition: Column, then: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(then, F.lit(False))


def violations(df: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """A row (keep..., check_order, rule, message) for each rule that a row breaks. All rules are checked in one pass."""
    found = [
        F.when(~F.coalesce(r.met, F.lit(False)), F.struct(F.lit(i).alias("check_order"), F.lit(r.name).alias("rule"), (r.message if isinstance(r.message, Column) else F.lit(r.message or r.name)).alias("message")))
        for i, r in enumerate(rules)
    ]
    return df.select(*keep, F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("v")).select(*keep, "v.*")


def first_violation(found: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Of each group the first violation, as a check that stops at the first error would raise it."""
    rest = [c for c in found.columns if c not in group]
    best = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("first")
    return found.groupBy(*group).agg(best).select(*group, *(F.col(f"first.{c}").alias(c) for c in rest))


def raw_observation_rules() -> list[Rule]:
    """The contract of raw observations, on typed columns."""
    source, simulated = F.col("source.kind"), F.col("source.kind") == "SIMULATOR"
    return [
        Rule("contract", F.col("contract") == "raw.observation"),
        Rule("contract_version", F.col("contract_version") == "1.0.0"),
        Rule("observation_id", is_domain_id(F.col("observation_id"), "obs")),
        Rule("vehicle_id", is_domain_id(F.col("vehicle_id"), "veh")),
        Rule("capture_id", is_domain_id(F.col("capture_id"), "capture")),
        Rule("sequence", F.col("sequence") >= 0),
        Rule("observed_at_monotonic_us", F.col("observed_at_monotonic_us") >= 0),
        Rule("wall_time", F.col("wall_time").isNotNull()),
        Rule("source.kind", source.isin(SOURCE_KINDS)),
        Rule("source.source_id", F.length("source.source_id").between(1, 128)),
        Rule("source.channel", F.length("source.channel").between(1, 128)),
        Rule("payload.encoding", F.col("payload.encoding") == "HEX"),
        Rule("payload.data", F.col("payload.data").rlike(HEX) & (F.length("payload.data") <= 8192)),
        Rule("payload.sha256", F.col("payload.sha256").rlike(SHA256)),
        Rule("quality", F.col("quality").isin(QUALITY)),
        Rule("versions.source", F.col("versions.source").rlike(SEMVER)),
        Rule("can_frame_fields", implies(source == "CAN_FRAME", F.col("source.bus_index").between(0, 255) & F.col("source.arbitration_id").between(0, 536870911) & F.col("source.extended_id").isNotNull())),
        Rule("simulator_namespace", implies(simulated, F.col("source.source_id").rlike("^sim\\.") & F.col("source.channel").rlike("^sim\\."))),
    ]
