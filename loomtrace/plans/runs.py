"""Calculation runs: a registry of equations that feed each other, worked out over rows of inputs, each result with its evidence.

Equations are put in the order in which they feed each other; those on a cycle, above one, or with an input that
nothing gives are unavailable for every row, and the plan says why. Each equation is a projection over the one
before, so a chain of any length is one pass without a shuffle.

The contract fixes the documents, not how confidence comes about. Ours: each factor lies between 0 and 1, and
the least one is the confidence. An input counts if it is there, fresh enough and of an accepted quality; one
that doesn't makes the result unavailable, as do a null result and one outside of the output's bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import ids
from loomtrace.functions.schemas import QUALITY
from loomtrace.plans.equations import EquationError, compile_node, usable

#: Ours: what a quality and a state of validation are worth.
QUALITY_WORTH = {"GOOD": 1.0, "MANUALLY_ENTERED": 0.8, "SENSOR_UNVERIFIED": 0.6, "DECODER_UNCERTAIN": 0.5, "STALE": 0.3, "TRANSPORT_GAP": 0.3, "OUT_OF_RANGE": 0.1, "MISSING": 0.0}
VALIDATION_WORTH = {"EXPERIMENTAL": 0.25, "BENCH_VALIDATED": 0.5, "VEHICLE_VALIDATED": 0.75, "CALIBRATED": 1.0}
CALCULATED, UNAVAILABLE, OUTSIDE = "CALCULATED", "UNAVAILABLE", "OUT_OF_RANGE"


@dataclass(frozen=True)
class Equation:
    """A definition document, and which of its inputs are outputs of other equations (by equation_id)."""

    definition: dict
    derived: dict[str, str] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return self.definition["equation_id"]

    @property
    def inputs(self) -> list[dict]:
        return self.definition["inputs"]


@dataclass(frozen=True)
class Plan:
    """Equations in the order in which they can be worked out, and by id why the others can't."""

    order: list[Equation]
    refused: dict[str, str]


def planned(registry: list[Equation]) -> Plan:
    """The order of a registry; of equal rank by id. Two definitions of one id are an error, as are unknown names and operators."""
    by_id = {e.id: e for e in registry}
    if len(by_id) < len(registry):
        raise EquationError("an equation is in the registry twice")
    for e in registry:
        inputs, constants = {i["name"]: F.lit(0.0) for i in e.inputs}, {c["name"]: c["value"] for c in e.definition.get("constants", [])}
        compile_node(e.definition["expression"]["ast"], inputs, constants)
    refused = {e.id: f"no equation {x}" for e in registry for x in e.derived.values() if x not in by_id}
    waits = {e.id: set(e.derived.values()) for e in registry}
    order: list[Equation] = []
    while ready := sorted(k for k, w in waits.items() if not w):
        for k in ready:
            order.append(by_id[k])
            del waits[k]
        for w in waits.values():
            w.difference_update(ready)
    for k in waits:
        refused.setdefault(k, "on a cycle: " + " -> ".join(around) if (around := cycle(k, by_id)) else "")
    for k in sorted(waits):
        refused[k] = refused[k] or next(f"needs {x}, which is unavailable" for x in sorted(by_id[k].derived.values()) if x in waits)
    return Plan(order, refused)


def cycle(start: str, by_id: dict[str, Equation]) -> list[str]:
    """The shortest way from an equation through its inputs back to it; none if there is none."""
    ways = [[start]]
    seen = set()
    while ways:
        way = ways.pop(0)
        for x in sorted(by_id[way[-1]].derived.values() if way[-1] in by_id else []):
            if x == start:
                return [*way, start]
            if x not in seen:
                seen.add(x)
                ways.append([*way, x])
    return []


def least(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else F.least(*values)


def worth(name: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[name], F.lit(0.0))


def with_run(rows: DataFrame, e: Equation, name: str, names: dict[str, str], key: list[str], at_ms: Column) -> tuple[DataFrame, dict[str, Column]]:
    """rows with columns `name`_... for the run of one equation, and its fields made of them.

    Each input is a struct (value, age_ms, quality, evidence_ref), or by names the columns of another run. What
    is used more than once is a column of its own, in a projection of its own, so nothing is worked out twice.
    """
    d = e.definition
    derived = lambda x, part: F.col(f"{names[x]}_{part}")
    given = {i["name"]: {part: derived(e.derived[i["name"]], part) if i["name"] in e.derived else F.col(i["name"])[part] for part in ("value", "age_ms", "quality", "evidence_ref")} for i in e.inputs}
    fresh = {i["name"]: F.coalesce(usable(given[i["name"]]["age_ms"], F.lit(i["maximum_age_ms"]), given[i["name"]]["quality"], F.array(*map(F.lit, i["accepted_quality"]))) & given[i["name"]]["value"].isNotNull(), F.lit(False)) for i in e.inputs}
    rows = rows.withColumns({f"{name}_fresh{k}": c for k, c in enumerate(fresh.values())})
    fresh = {n: F.col(f"{name}_fresh{k}") for k, n in enumerate(fresh)}
    values, constants = {n: g["value"] for n, g in given.items()}, {c["name"]: c["value"] for c in d.get("constants", [])}
    ast = d["expression"]["ast"]
    rows = rows.withColumn(f"{name}_raw", F.nanvl(F.when(reduce(lambda a, b: a & b, fresh.values()), compile_node(ast, values, constants)), F.lit(None).cast("double")))
    value = F.col(f"{name}_raw")
    low, high = d["output"].get("minimum"), d["output"].get("maximum")
    outside = reduce(lambda a, b: a | b, ([value < low] if low is not None else []) + ([value > high] if high is not None else []), F.lit(False))
    rows = rows.withColumn(f"{name}_status", F.when(value.isNull(), UNAVAILABLE).when(outside, OUTSIDE).otherwise(CALCULATED))
    status = F.col(f"{name}_status")
    ranks = F.array(*map(F.lit, QUALITY))
    worst = F.element_at(ranks, F.array_max(F.array(*(F.array_position(ranks, g["quality"]).cast("int") for g in given.values()))))
    seed = F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(e.id), F.lit(d["version"]))
    rows = rows.withColumns(
        {
            f"{name}_value": F.when(status == CALCULATED, value),
            f"{name}_age_ms": F.array_max(F.array(*(g["age_ms"].cast("long") for g in given.values()))),
            f"{name}_quality": worst,
            f"{name}_evidence_ref": ids.deterministic_id("calc", seed, at_ms),
        }
    )
    rest = {i["name"]: F.when(F.lit(i["maximum_age_ms"]) > 0, F.greatest(F.lit(0.0), 1 - given[i["name"]]["age_ms"] / F.lit(i["maximum_age_ms"]))).otherwise(1.0) for i in e.inputs}
    factors = {
        "SOURCE_QUALITY": least([worth(g["quality"], QUALITY_WORTH) for g in given.values()]),
        "FRESHNESS": least([F.coalesce(r, F.lit(0.0)) for r in rest.values()]),
        "COVERAGE": reduce(lambda a, b: a + b, (f.cast("double") for f in fresh.values())) / len(given),
        "MODEL_VALIDATION": F.lit(VALIDATION_WORTH[d["validation_status"]]),
        "CALIBRATION_QUALITY": F.lit(1.0 if d["validation_status"] == "CALIBRATED" else 0.5),
    }
    used = {k: factors[k] for k in d["confidence_model"]["factors"]}
    missing = {n: F.when(g["value"].isNull(), f"{n}: missing").otherwise(f"{n}: too old or of a quality that is not accepted") for n, g in given.items()}
    no_value = F.when(value.isNull() & reduce(lambda a, b: a & b, fresh.values()), "no value")
    why = F.array(*(F.when(~fresh[n], m) for n, m in missing.items()), no_value, F.when(status == OUTSIDE, "outside of the output's bounds"))
    inner = [a for a in ast.get("arguments", []) if a["kind"] == "operation"]
    return rows, {
        "equation_id": F.lit(e.id),
        "version": F.lit(d["version"]),
        "status": status,
        "reasons": F.filter(why, lambda x: x.isNotNull()),
        "value": F.col(f"{name}_value"),
        "confidence": F.when(status == CALCULATED, least(list(used.values()))),
        "factors": F.create_map(*(x for k, v in used.items() for x in (F.lit(k), v))),
        "inputs": F.array(*(F.struct(F.lit(i["name"]).alias("name"), given[i["name"]]["value"].cast("double").alias("value"), F.lit(i["unit"]).alias("unit"), given[i["name"]]["evidence_ref"].cast("string").alias("evidence_ref"), given[i["name"]]["quality"].alias("quality")) for i in e.inputs)),
        "intermediates": F.array(*(F.struct(F.lit(f"argument_{k}").alias("name"), compile_node(a, values, constants).alias("value"), F.lit("-").alias("unit")) for k, a in enumerate(inner, 1))),
        "evidence_ref": F.col(f"{name}_evidence_ref"),
        "age_ms": F.col(f"{name}_age_ms"),
        "quality": F.col(f"{name}_quality"),
        "unit": F.lit(d["output"]["unit"]),
        "truth_boundary": F.lit(d["output"]["truth_boundary"]),
    }


#: Fields of a run.
FIELDS = {
    "equation_id": "string", "version": "string", "status": "string", "reasons": "array<string>", "value": "double", "confidence": "double", "factors": "map<string,double>",
    "inputs": "array<struct<name:string,value:double,unit:string,evidence_ref:string,quality:string>>", "intermediates": "array<struct<name:string,value:double,unit:string>>",
    "evidence_ref": "string", "age_ms": "long", "quality": "string", "unit": "string", "truth_boundary": "string",
}


def runs(rows: DataFrame, registry: list[Equation], key: list[str], at_ms: str, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """A row (key..., at_ms, run) for each row and equation of the registry, in the order of the plan, then those that can't be worked out.

    An input that is an output counts as of its run: its value, the greatest age and the worst quality of
    what it rests on, and the run's id as evidence. A run that isn't calculated is a missing input of others.
    run has the fields asked for; what none of them needs isn't worked out.
    """
    plan = planned(registry)
    work, made, names = rows, [], {}
    for i, e in enumerate(plan.order):
        names[e.id] = f"__run{i}"
        work, found = with_run(work, e, names[e.id], names, key, F.col(at_ms))
        made.append(found)
    for e in sorted((e for e in registry if e.id in plan.refused), key=lambda e: e.id):
        made.append({"equation_id": F.lit(e.id), "version": F.lit(e.definition["version"]), "status": F.lit(UNAVAILABLE), "reasons": F.array(F.lit(plan.refused[e.id]))})
    cells = [x.get(n, F.lit(None)).cast(FIELDS[n]) for x in made for n in fields]
    each = work.select(*key, at_ms, F.stack(F.lit(len(made)), *cells).alias(*(f"__{n}" for n in fields)))
    return each.select(*key, at_ms, F.struct(*(F.col(f"__{n}").alias(n) for n in fields)).alias("run"))


def documents(found: DataFrame, at_ms: str, vehicle_id: Column, versions: dict[str, str]) -> DataFrame:
    """found with `document`: the calculated runs as documents of the contract `calculation.run`."""
    r = F.col("run")
    doc = F.to_json(
        F.struct(
            F.lit("calculation.run").alias("contract"),
            F.lit("1.0.0").alias("contract_version"),
            r["evidence_ref"].alias("calculation_id"),
            vehicle_id.alias("vehicle_id"),
            r["equation_id"].alias("metric_id"),
            F.struct(r["equation_id"].alias("equation_id"), r["version"].alias("version")).alias("equation"),
            F.struct(*(F.lit(v).alias(k) for k, v in versions.items())).alias("versions"),
            r["inputs"].alias("inputs"),
            F.filter(r["intermediates"], lambda x: x["value"].isNotNull()).alias("intermediates"),
            F.struct(r["value"].alias("value"), r["unit"].alias("unit"), r["truth_boundary"].alias("truth_boundary")).alias("output"),
            r["confidence"].alias("confidence"),
            r["factors"].alias("confidence_factors"),
            r["reasons"].alias("quality_notes"),
            F.date_format(F.timestamp_millis(F.col(at_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("executed_at"),
        )
    )
    return found.where(r["status"] == CALCULATED).withColumn("document", doc)
