"""Record types and value lists of the contracts. Nothing is inferred from data."""

from __future__ import annotations

# Fixed values of the contracts: fields and their types.
RAW_OBSERVATION = (
    "contract string, contract_version string, observation_id string, vehicle_id string, capture_id string, sequence long, "
    "observed_at_monotonic_us long, wall_time string, "
    "source struct<kind: string, source_id: string, channel: string, bus_index: int, arbitration_id: int, extended_id: boolean>, "
    "payload struct<encoding: string, data: string, sha256: string>, quality string, "
    "versions struct<source: string, gateway_firmware: string, gateway_config: string, transport_protocol: string>"
)
MANIFEST = (
    "contract string, contract_version string, capture_id string, vehicle_id string, created_at string, "
    "capture_window struct<start_monotonic_us: long, end_monotonic_us: long, start_wall_time: string, end_wall_time: string>, "
    "profile struct<kind: string, snapshot_ref: string, snapshot_sha256: string, scenario_id: string, scenario_version: string>, "
    "source struct<kind: string, source_id: string, source_version: string, hardware_revision: string, firmware_build_id: string, config_id: string, listen_only: boolean>, "
    "segments array<struct<path: string, media_type: string, schema: string, sha256: string, byte_count: long, record_count: long>>, "
    "statistics struct<received_records: long, dropped_records: long, sequence_gaps: long, crc_failures: long, transport_reconnects: long>, "
    "versions struct<raw_observation_contract: string, gateway_protocol: string, vehicle_config_pack: string, signal_pack: string>, "
    "labels array<struct<label: string, at_monotonic_us: long, note: string>>, semantic_digest string"
)
#: Fixed values of the contracts.
QUALITY = ["GOOD", "STALE", "MISSING", "OUT_OF_RANGE", "DECODER_UNCERTAIN", "TRANSPORT_GAP", "SENSOR_UNVERIFIED", "MANUALLY_ENTERED"]
SOURCE_KINDS = ["CAN_FRAME", "DIAGNOSTIC_RESPONSE", "ADDED_SENSOR", "SIMULATOR"]
