"""Contracts of JSON documents: typed, closed records, checked on the document itself.

A document is parsed to a variant, so that JSON types are seen as written: a number in a string is no
number, and a key that no contract names is an error. All errors of a document are listed, by path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.schemas import QUALITY, SOURCE_KINDS
from loomtrace.operators import json_schema


@dataclass(frozen=True)
class Text:
    pattern: str | None = None
    least: int | None = None
    most: int | None = None
    among: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    whole: bool = False


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Fixed:
    value: str


@dataclass(frozen=True)
class Items:
    of: object
    least: int = 0
    unique: bool = False


@dataclass(frozen=True)
class Measures:
    """An object of any keys, all values of one kind."""

    of: object
    least: int = 0


@dataclass(frozen=True)
class Tree:
    """An expression: literals, inputs, constants and operations, to any depth."""


@dataclass(frozen=True)
class Record:
    required: dict
    optional: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Implication:
    """Where `parent` has `key` among `values`, or no such key, the object at `at` must hold: names, or a rule of one field."""

    parent: str
    key: str
    values: tuple[str, ...]
    at: str
    names: tuple[str, ...] = ()
    child: str = ""
    rule: str = ""
    limit: object = None


#: The name of the expression language where the caller gives no other.
LANGUAGE = "own-expression-1"
# Fixed values of the contracts: patterns, lists and field names.
ULID = "[0-9A-HJKMNP-TV-Z]{26}"
SEMVER = Text(r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$")
SEMANTIC_ID = Text("^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)+$", 3, 160)
SHA256 = Text("^[0-9a-f]{64}$")
UNIT = Text("^[A-Za-z0-9%/.*_^-]{1,32}$")
NAME = Text("^[a-z][a-z0-9_]*$")
EVIDENCE = Text(f"^(obs|sample|feature|calc|metric|finding|maintenance|inspection)_{ULID}$")
TIME, COUNT, SHARE = Text(), Number(0, whole=True), Number(0, 1)
QUALITY_TEXT = Text(among=tuple(QUALITY))
OPERATORS = ("add", "subtract", "multiply", "divide", "max", "min", "abs", "mean", "geometric_mean", "clamp", "slope", "integral_positive_excess")


def identifier(prefix: str) -> Text:
    return Text(f"^{prefix}_{ULID}$")


def header(contract: str) -> dict:
    return {"contract": Fixed(contract), "contract_version": Fixed("1.0.0")}


CONTRACTS: dict[str, Record] = {
    "ai.claim": Record(
        header("ai.claim")
        | {
            "claim_id": identifier("claim"),
            "text": Text(least=1, most=4000),
            "claim_type": Text(among=("VEHICLE_OBSERVATION_INTERPRETATION", "HYPOTHESIS", "GENERAL_GUIDANCE")),
            "evidence_refs": Items(EVIDENCE, unique=True),
            "confidence": SHARE,
            "hypothesis": Flag(),
            "authority": Fixed("NON_AUTHORITATIVE"),
        }
    ),
    "calculation.run": Record(
        header("calculation.run")
        | {
            "calculation_id": identifier("calc"),
            "vehicle_id": identifier("veh"),
            "metric_id": SEMANTIC_ID,
            "equation": Record({"equation_id": SEMANTIC_ID, "version": SEMVER}),
            "versions": Record({"vehicle_config_pack": SEMVER, "equation_contract": SEMVER, "runtime": SEMVER}, {"signal_pack": SEMVER}),
            "inputs": Items(Record({"name": NAME, "value": Number(), "unit": UNIT, "evidence_ref": EVIDENCE, "quality": QUALITY_TEXT}), least=1),
            "intermediates": Items(Record({"name": NAME, "value": Number(), "unit": UNIT})),
            "output": Record({"value": Number(), "unit": UNIT, "truth_boundary": Text(among=("MEASURED", "ESTIMATED", "SCHEDULED", "INSPECTION", "HYPOTHESIS"))}),
            "confidence": SHARE,
            "confidence_factors": Measures(SHARE, least=1),
            "quality_notes": Items(Text(most=500)),
            "executed_at": TIME,
        },
        {"recalculation_of": identifier("calc")},
    ),
    "capture.bundle.manifest": Record(
        header("capture.bundle.manifest")
        | {
            "capture_id": identifier("capture"),
            "vehicle_id": identifier("veh"),
            "created_at": TIME,
            "capture_window": Record({"start_monotonic_us": COUNT, "end_monotonic_us": COUNT, "start_wall_time": TIME, "end_wall_time": TIME}),
            "profile": Record({"kind": Text(among=("VEHICLE", "SIMULATOR"))}, {"snapshot_ref": Text(least=1, most=256), "snapshot_sha256": SHA256, "scenario_id": SEMANTIC_ID, "scenario_version": SEMVER}),
            "source": Record(
                {"kind": Text(among=("GATEWAY", "SIMULATOR")), "source_id": Text(least=1, most=128), "source_version": SEMVER},
                {"hardware_revision": Text(least=1, most=128), "firmware_build_id": Text(least=1, most=160), "config_id": Text(least=1, most=160), "listen_only": Flag()},
            ),
            "segments": Items(
                Record(
                    {"path": Text("^[A-Za-z0-9][A-Za-z0-9._/-]*$", most=256), "media_type": Text(among=("application/x-ndjson",)), "sha256": SHA256, "byte_count": COUNT, "record_count": COUNT},
                    {"schema": Text(least=1, most=128)},
                ),
                least=1,
            ),
            "statistics": Record({"received_records": COUNT, "dropped_records": COUNT, "sequence_gaps": COUNT, "crc_failures": COUNT, "transport_reconnects": COUNT}),
            "versions": Record({"raw_observation_contract": SEMVER}, {"gateway_protocol": SEMVER, "vehicle_config_pack": SEMVER, "signal_pack": SEMVER}),
            "semantic_digest": SHA256,
        },
        {"labels": Items(Record({"label": Text(least=1, most=160), "at_monotonic_us": COUNT}, {"note": Text(most=1000)}))},
    ),
    "raw.observation": Record(
        header("raw.observation")
        | {
            "observation_id": identifier("obs"),
            "vehicle_id": identifier("veh"),
            "capture_id": identifier("capture"),
            "sequence": COUNT,
            "observed_at_monotonic_us": COUNT,
            "wall_time": TIME,
            "source": Record(
                {"kind": Text(among=tuple(SOURCE_KINDS)), "source_id": Text(least=1, most=128), "channel": Text(least=1, most=128)},
                {"bus_index": Number(0, 255, True), "arbitration_id": Number(0, 536870911, True), "extended_id": Flag()},
            ),
            "payload": Record({"encoding": Text(among=("HEX",)), "data": Text("^(?:[0-9a-f]{2})*$", most=8192), "sha256": SHA256}),
            "quality": QUALITY_TEXT,
            "versions": Record({"source": SEMVER}, {"gateway_firmware": SEMVER, "gateway_config": SEMVER, "transport_protocol": SEMVER}),
        }
    ),
    "signal.definition": Record(
        header("signal.definition")
        | {
            "signal_id": SEMANTIC_ID,
            "registry_version": SEMVER,
            "source": Record(
                {"kind": Text(among=tuple(SOURCE_KINDS)), "source_id": Text(least=1, most=160)},
                {"ecu_id": Text(least=1, most=160), "request_allowlist_entry_id": Text(least=1, most=160), "arbitration_id": Number(0, 536870911, True)},
            ),
            "raw_layout": Record(
                {"encoding": Text(among=("INTEGER", "IEEE754", "BIT_FIELD")), "byte_offset": COUNT, "byte_length": Number(1, 8, True), "endianness": Text(among=("BIG", "LITTLE")), "signed": Flag()},
                {"bit_offset": Number(0, 63, True), "bit_length": Number(1, 64, True)},
            ),
            "transform": Record({"language": Fixed(LANGUAGE), "ast": Tree()}),
            "canonical_unit": UNIT,
            "plausible_range": Record({"minimum": Number(), "maximum": Number()}),
            "cadence": Record({"expected_period_ms": Number(1, whole=True), "stale_after_ms": Number(1, whole=True)}),
            "applicability": Record({"vehicle_config_pack": Text(least=1, most=160), "conditions": Items(Text(least=1, most=300))}),
            "validation_status": Text(among=("EXPERIMENTAL", "BENCH_VALIDATED", "VEHICLE_VALIDATED", "CALIBRATED")),
            "provenance": Items(Record({"kind": Text(among=("STANDARD", "OEM_SERVICE_INFORMATION", "TARGET_CAPTURE", "BENCH_MEASUREMENT", "SIMULATOR_SPEC")), "reference": Text(least=1, most=500)}), least=1),
        }
    ),
    "signal.sample": Record(
        header("signal.sample")
        | {
            "sample_id": identifier("sample"),
            "vehicle_id": identifier("veh"),
            "observation_id": identifier("obs"),
            "signal_id": SEMANTIC_ID,
            "value": Number(),
            "unit": UNIT,
            "observed_at_monotonic_us": COUNT,
            "wall_time": TIME,
            "quality": QUALITY_TEXT,
            "source": Record({"kind": Text(among=("VEHICLE", "ADDED_SENSOR", "SIMULATOR", "MANUAL")), "decoder_id": SEMANTIC_ID}),
            "versions": Record({"decoder": SEMVER}, {"signal_pack": SEMVER}),
        },
        {"session_id": identifier("session")},
    ),
}
IMPLICATIONS: dict[str, list[Implication]] = {
    "ai.claim": [
        Implication("", "claim_type", ("VEHICLE_OBSERVATION_INTERPRETATION", "HYPOTHESIS"), "", child="evidence_refs", rule="minItems", limit=1),
        Implication("", "claim_type", ("HYPOTHESIS",), "", child="hypothesis", rule="const", limit=True),
        Implication("", "claim_type", ("VEHICLE_OBSERVATION_INTERPRETATION",), "", child="hypothesis", rule="const", limit=False),
    ],
    "capture.bundle.manifest": [
        Implication("profile", "kind", ("SIMULATOR",), "profile", names=("scenario_id", "scenario_version")),
        Implication("source", "kind", ("GATEWAY",), "source", names=("hardware_revision", "firmware_build_id", "config_id", "listen_only")),
    ],
    "raw.observation": [
        Implication("source", "kind", ("CAN_FRAME",), "source", names=("bus_index", "arbitration_id", "extended_id")),
        Implication("source", "kind", ("SIMULATOR",), "source", child="source_id", rule="pattern", limit=r"^sim\."),
        Implication("source", "kind", ("SIMULATOR",), "source", child="channel", rule="pattern", limit=r"^sim\."),
    ],
    "signal.sample": [Implication("source", "kind", ("SIMULATOR",), "", child="signal_id", rule="pattern", limit=r"^sim\.")],
}
ROOT = json_schema.ROOT
#: Where the contracts' own schema documents are named from.
BASE = "urn:loomtrace:contracts/"


def schema_of(kind: object) -> dict:
    """A contract, or a part of one, as a JSON Schema."""
    match kind:
        case Fixed(value):
            return {"const": value}
        case Text(pattern, least, most, among):
            rest = {"pattern": pattern, "minLength": least, "maxLength": most, "enum": list(among) if among else None}
            return {"type": "string"} | {k: v for k, v in rest.items() if v is not None}
        case Number(least, most, whole):
            return {"type": "integer" if whole else "number"} | {k: v for k, v in (("minimum", least), ("maximum", most)) if v is not None}
        case Flag():
            return {"type": "boolean"}
        case Tree():
            return {"$ref": "#/$defs/tree"}
        case Items(of, least, unique):
            return {"type": "array", "items": schema_of(of)} | ({"minItems": least} if least else {}) | ({"uniqueItems": True} if unique else {})
        case Measures(of, least):
            return {"type": "object", "additionalProperties": schema_of(of)} | ({"minProperties": least} if least else {})
        case Record(required, optional):
            return {"type": "object", "additionalProperties": False, "required": list(required), "properties": {k: schema_of(v) for k, v in (required | optional).items()}}
    raise TypeError(kind)


def tree_schema() -> dict:
    """An expression: one of four kinds of node, to any depth."""
    node = lambda kind, **members: {"type": "object", "additionalProperties": False, "required": ["kind", *members], "properties": {"kind": {"const": kind}, **members}}
    operation = node("operation", operator={"type": "string", "enum": list(OPERATORS)}, arguments={"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/tree"}})
    return {"oneOf": [node("literal", value={"type": "number"}), node("input", name=schema_of(NAME)), node("constant", name=schema_of(NAME)), operation]}


def condition(rule: Implication) -> dict:
    """An implication as if and then; both look at the document's own members."""
    within = lambda name, schema: {"properties": {name: schema}} if name else schema
    then = {"required": list(rule.names)} if rule.names else {"properties": {rule.child: {rule.rule: rule.limit}}}
    return {"if": within(rule.parent, {"properties": {rule.key: {"enum": list(rule.values)}}}), "then": within(rule.at, then)}


def documents_of(contracts: dict[str, Record] | None = None, language: str = LANGUAGE) -> dict[str, dict]:
    """By id the schema documents of the contracts, as they could be written to files; language names that of expressions."""
    found = {}
    for name, record in (contracts or CONTRACTS).items():
        schema = {"$id": BASE + name, "$defs": {"tree": tree_schema()}} | schema_of(record)
        if rules := IMPLICATIONS.get(name):
            schema["allOf"] = [condition(r) for r in rules]
        if name == "signal.definition":
            schema["properties"]["transform"]["properties"]["language"] = {"const": language}
        found[BASE + name] = schema
    return found


def contract_errors(documents: DataFrame, json_col: str, *keep: str, only: tuple[str, ...] = tuple(CONTRACTS), language: str = LANGUAGE) -> DataFrame:
    """(keep..., contract, path, rule): all errors of each document under the contracts named here; see json_schema."""
    return json_schema.schema_errors(documents, json_col, *keep, catalog=json_schema.Catalog(documents_of(language=language)), only=only)


def error_text(errors: DataFrame, *keys: str) -> DataFrame:
    """One line for each document: its errors by path, joined by semicolons."""
    lines = F.array_sort(F.collect_list(F.struct("path", "rule")))
    return errors.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda e: F.concat_ws(": ", e["path"], e["rule"])), "; ").alias("errors"))
