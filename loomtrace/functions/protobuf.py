"""Protobuf payloads of the gateway: varints and length-delimited fields, read by Arrow batches.

Spark's own reader needs a package that is not part of a plain installation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fields by number, with name and type, of each message.
MESSAGES = {
    "raw_can_frame": {1: ("capture_id", "string"), 2: ("bus_index", "long"), 3: ("arbitration_id", "long"), 4: ("data", "binary"), 5: ("extended_id", "boolean"), 6: ("remote_frame", "boolean"), 7: ("twai_alert_bits", "long")},
    "diagnostic_response": {1: ("capture_id", "string"), 2: ("allowlist_entry_id", "string"), 3: ("ecu_id", "string"), 4: ("response_payload", "binary"), 5: ("request_sequence", "long")},
    "gateway_health": {1: ("gateway_id", "string"), 2: ("uptime_ms", "decimal(20,0)"), 3: ("reset_reason", "string"), 4: ("received_frames", "decimal(20,0)"), 5: ("dropped_frames", "decimal(20,0)"), 6: ("bus_error_count", "decimal(20,0)"), 7: ("bus_off_count", "decimal(20,0)"), 8: ("reconnect_count", "decimal(20,0)"), 9: ("storage_free_bytes", "decimal(20,0)"), 10: ("queue_depth", "long"), 11: ("listen_only", "boolean")},
    "capture_marker": {1: ("capture_id", "string"), 2: ("marker_id", "string"), 3: ("label", "string"), 4: ("operator_note", "string")},
    "allowlisted_diagnostic_request": {1: ("request_id", "string"), 2: ("allowlist_entry_id", "string"), 3: ("experiment_id", "string")},
}
DEFAULTS = {"string": "", "binary": b"", "boolean": False, "long": 0, "decimal(20,0)": 0}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field in order of the wire; fields of fixed width as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        match tag & 7:
            case 0:
                value, at = varint(data, at)
            case 1 | 5 | 2 as wire:
                size, at = varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
                if at + size > len(data):
                    raise ValueError("field beyond the message")
                value, at = data[at : at + size], at + size
            case _:
                raise ValueError("unknown wire type")
        yield tag >> 3, value


def message(data: bytes, kinds: dict[int, tuple[str, str]]) -> dict:
    """The message's fields, defaults where it has none, the last of repeated ones; unknown fields are passed over."""
    from decimal import Decimal

    out = {name: DEFAULTS[kind] for name, kind in kinds.values()}
    for number, value in fields(data):
        name, kind = kinds.get(number, ("", ""))
        if kind:
            if isinstance(value, bytes) != (kind in ("string", "binary")):
                raise ValueError(f"wrong wire type of {name}")
            out[name] = value.decode() if kind == "string" else bool(value) if kind == "boolean" else value & 0xFFFFFFFF if kind == "long" else value
    return {name: Decimal(out[name]) if kind.startswith("decimal") else out[name] for name, kind in kinds.values()}


def decoded(payloads: DataFrame, kind: str, key: str = "id", payload: str = "payload") -> DataFrame:
    """(key, the fields of the message kind, error) for each payload; a payload that is no such message has its error and nulls."""
    kinds = MESSAGES[kind]
    names = [name for name, _ in kinds.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[payload], strict=True):
                try:
                    rows.append({"__key": k, **message(bytes(data), kinds), "error": None})
                except (ValueError, TypeError) as e:
                    rows.append({"__key": k, **dict.fromkeys(names), "error": "no payload" if data is None else str(e) or "no message"})
            yield pd.DataFrame(rows, columns=["__key", *names, "error"])

    key_type = payloads.schema[key].dataType.simpleString()
    schema = f"__key {key_type}, " + ", ".join(f"{n} {t}" for n, t in kinds.values()) + ", error string"
    return payloads.select(key, payload).mapInPandas(run, schema).withColumnRenamed("__key", key)
