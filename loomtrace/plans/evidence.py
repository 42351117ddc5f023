"""Queries over gateway states, contracts, bundles, frames and packages made from the driver's tables, and what they must give in SQL.

The faults of documents are planted by id, so the SQL lists what each planted fault must be reported as; it
shares no code with the checks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import ids, layouts, protobuf
from loomtrace.functions.binary import be_hex, fixed_point
from loomtrace.operators import contracts, gateway, lineage, ranges, replay
from loomtrace.plans.catalogue import query, read
from loomtrace.sources import bundles, packages, scenario, scratch
from loomtrace.streaming import frames

ID = "01M05MT900DJ4ZA10KD39AHERG"
ALL_CAPABILITIES = gateway.CAPABILITIES


def listed(items, spark: bool) -> str:
    inner = ", ".join(f"'{x}'" for x in items)
    return f"array({inner})" if spark else f"[{inner}]"


def state_columns(spark: bool) -> list[str]:
    """A gateway's latest state for each customer, in SQL that both engines read."""
    every, some, two = (listed(x, spark) for x in (ALL_CAPABILITIES, [c for c in ALL_CAPABILITIES if c != "ota.signed-image"], ALL_CAPABILITIES[:2]))
    none = "cast(array() AS array<string>)" if spark else "CAST([] AS VARCHAR[])"
    text = lambda c: f"CAST({c} AS STRING)"
    return [
        "c_custkey AS k",
        "CASE c_custkey % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CONNECTING' WHEN 2 THEN 'SCANNING' WHEN 3 THEN 'DEGRADED' ELSE 'GATEWAY_CONNECTED' END AS state",
        "c_custkey % 5 <> 0 AS bluetooth_ready",
        "CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'powered off' ELSE 'resetting' END AS bluetooth_state",
        "c_custkey % 6 = 0 AS scan_active",
        "CASE WHEN c_custkey % 3 = 0 THEN 'gw' END AS discovered_name",
        "CASE WHEN c_custkey % 5 <> 1 THEN CAST(-60 - c_custkey % 40 AS INT) END AS rssi",
        "c_custkey % 2 = 0 AS peripheral_connected",
        "c_custkey % 3 = 1 AS reconnecting",
        "c_custkey % 4 = 0 AS gateway_service",
        "c_custkey % 3 = 2 AS factory_service",
        "c_custkey % 5 <> 2 AS command_ready",
        *(f"c_custkey % {n} = 0 AS {c}" for n, c in ((2, "stream_discovered"), (3, "stream_enabled"), (3, "health_discovered"), (4, "health_enabled"), (5, "ota_discovered"), (7, "ota_enabled"), (2, "signing_key"), (3, "release_key"), (17, "update_in_progress"))),
        "CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 3 ELSE 0 END AS decode_errors",
        "c_custkey % 9 AS decoded_frames",
        "c_custkey % 8 % 3 AS discontinuities",
        "c_custkey % 4 % 2 AS chunks_pending",
        "CASE WHEN c_custkey % 4 <> 3 THEN '1.0.0' END AS handshake_version",
        f"CASE WHEN c_custkey % 4 <> 3 THEN 'gw-' || {text('c_custkey')} END AS gateway_id",
        f"'1.' || {text('c_custkey % 3')} || '.0' AS firmware_version",
        "'b7' AS firmware_build_id",
        "'cfg' AS active_config_id",
        "CASE WHEN c_custkey % 5 = 0 THEN 'rev-z' ELSE 'rev-a' END AS hardware_revision",
        "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '0.9' ELSE '1.2' END AS bootloader_version",
        "CASE WHEN c_custkey % 4 <> 3 THEN '2.0' END AS active_config_version",
        "c_custkey % 9 <> 0 AS handshake_listen_only",
        f"CASE c_custkey % 4 WHEN 0 THEN {every} WHEN 1 THEN {some} WHEN 2 THEN {two} END AS capabilities",
        "CASE WHEN c_custkey % 3 = 0 THEN 'http://10.0.0.1/upload/ota.bin' END AS ota_upload_url",
        "CASE c_custkey % 8 WHEN 0 THEN 3000 WHEN 1 THEN NULL ELSE 9000 END AS ota_maximum_image_bytes",
        "CASE WHEN c_custkey % 6 <> 5 THEN '2026-01-01T00:00:00Z' END AS observed_at",
        "CASE WHEN c_custkey % 6 <> 5 THEN '08:00:00' END AS health_arrived_at",
        "CASE c_custkey % 6 WHEN 5 THEN NULL WHEN 1 THEN 'MOVING' WHEN 2 THEN 'UNKNOWN' ELSE 'PARKED' END AS vehicle_motion",
        "CASE WHEN c_custkey % 7 <> 0 THEN 11000 + c_custkey % 300 * 10 END AS supply_millivolts",
        *(f"CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % {n} END AS {c}" for n, c in ((5, "received_frames"), (3, "dropped_frames"), (4, "bus_errors"), (2, "bus_off"))),
        "CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 4 * 512 END AS storage_free_bytes",
        "CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 10 = 3 END AS capture_active",
        "CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 13 <> 0 END AS health_listen_only",
        "CASE WHEN c_custkey % 4 = 1 THEN '09:00:00' END AS ota_status_at",
        "CASE c_custkey % 5 WHEN 4 THEN NULL WHEN 3 THEN '1.0' ELSE '1.2.0' END AS package_version",
        "11500 AS minimum_supply_millivolts",
        f"{listed(('rev-a', 'rev-b'), spark)} AS supported_hardware",
        f"{listed(('ota.signed-image', 'ota.ab'), spark)} AS required_capabilities",
        "1000 + c_custkey % 10 * 500 AS firmware_bytes",
        "CASE WHEN c_custkey % 4 = 0 THEN '1.0' END AS minimum_bootloader",
        "CASE WHEN c_custkey % 5 = 0 THEN 'e' END AS submitted_experiment",
        "c_custkey % 10 = 0 AS submitted_has_result",
        "CASE c_custkey % 8 WHEN 1 THEN 'NO_LOCK' WHEN 2 THEN 'PASSIVE_LOCK' WHEN 3 THEN 'READ_CONFIRMED' WHEN 4 THEN 'REJECTED_ERROR' WHEN 5 THEN 'INCONCLUSIVE' END AS latest_outcome",
        "CASE WHEN c_custkey % 8 IN (2, 3) THEN 'CAN_11_500' END AS network_protocol",
        "CASE WHEN c_custkey % 8 = 3 THEN 'CAN_29_500' END AS obd_protocol",
        "c_custkey % 3 AS result_count",
        f"CASE WHEN c_custkey % 2 = 0 THEN {listed(('a', 'b'), spark)} ELSE {none} END AS evidence_refs",
        "CASE c_custkey % 3 WHEN 0 THEN repeat('aF', 32) WHEN 1 THEN 'bad' END AS manifest_sha256",
        "CASE WHEN c_custkey % 2 = 0 THEN 'PASSIVE_CAN' ELSE 'READ' END AS mode",
        "c_custkey % 3 <> 1 AS approved",
        # Two candidates of a discovery plan.
        "CASE WHEN c_custkey % 7 = 0 THEN 'ISO_9141_2' ELSE 'CAN_11_500' END AS protocol_1",
        "CASE WHEN c_custkey % 11 = 0 THEN 31 ELSE 10 END AS window_1",
        "CASE WHEN c_custkey % 16 = 0 THEN 'x' END AS entry_1",
        "CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 30 END AS window_2",
        "CASE WHEN c_custkey % 3 = 0 THEN 'obd.standard.supported-pids' ELSE 'other' END AS entry_2",
    ]


def states(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*state_columns(True))


STATES_SQL = "WITH s AS (SELECT " + ", ".join(state_columns(False)) + " FROM customer) "
HAS = "coalesce(list_contains(capabilities, '{}'), false)"
LISTEN = "coalesce(handshake_listen_only AND health_listen_only, false)"
PARKED = "coalesce(vehicle_motion = 'PARKED', false)"
IDLE = "coalesce(NOT capture_active, false)"


@query(
    STATES_SQL + f"""
SELECT k, CASE WHEN NOT {PARKED} THEN 'not_parked' WHEN NOT approved THEN 'approval_required' WHEN NOT {IDLE} THEN 'capture_active'
  WHEN NOT {HAS.format("experiment.signed-plan")} THEN 'missing_capability:experiment.signed-plan' WHEN k % 19 = 0 THEN 'empty_plan'
  WHEN window_1 = 31 THEN 'invalid_window:31' WHEN NOT ({HAS.format("capture.passive")} AND {LISTEN}) THEN 'missing_capability:capture.passive'
  WHEN protocol_1 = 'ISO_9141_2' THEN 'passive_requires_can' WHEN entry_1 IS NOT NULL THEN 'passive_has_allowlist'
  WHEN window_2 = 0 THEN 'invalid_window:0' WHEN NOT {HAS.format("diagnostic.allowlisted-read")} THEN 'missing_capability:diagnostic.allowlisted-read'
  WHEN entry_2 = 'other' THEN 'allowlist_invalid' END AS error FROM s"""
)
def plan_safety(spark, sf_dir):
    one = F.struct(F.col("protocol_1").alias("protocol_id"), F.lit("PASSIVE_LISTEN").alias("phase"), F.col("window_1").alias("bounded_window_seconds"), F.col("entry_1").alias("allowlist_entry_id"))
    two = F.struct(F.lit("ISO_9141_2").alias("protocol_id"), F.lit("INTERPRETER_ALLOWLISTED_READ").alias("phase"), F.col("window_2").alias("bounded_window_seconds"), F.col("entry_2").alias("allowlist_entry_id"))
    plans = F.when(F.col("k") % 19 == 0, F.array().cast(gateway.CANDIDATES)).otherwise(F.array(one, two))
    return states(spark, sf_dir).withColumn("candidates", plans).select("k", gateway.plan_error().alias("error"))


PREFLIGHT_SQL = f"""CASE WHEN NOT {PARKED} THEN 'not_parked' WHEN NOT {IDLE} THEN 'capture_active' WHEN NOT {LISTEN} THEN 'not_listen_only'
  WHEN supply_millivolts IS NULL THEN 'supply_unavailable' WHEN supply_millivolts < 11500 THEN 'supply_too_low:11500:' || supply_millivolts
  WHEN hardware_revision = 'rev-z' THEN 'hardware_unsupported:rev-z' WHEN NOT {HAS.format("ota.ab")} THEN 'missing_capability:ota.ab'
  WHEN NOT {HAS.format("ota.signed-image")} THEN 'missing_capability:ota.signed-image'
  WHEN firmware_bytes > ota_maximum_image_bytes THEN 'image_too_large:' || ota_maximum_image_bytes || ':' || firmware_bytes
  WHEN minimum_bootloader IS NOT NULL AND bootloader_version IS NULL THEN 'bootloader_unavailable'
  WHEN minimum_bootloader IS NOT NULL AND bootloader_version = '0.9' THEN 'bootloader_too_old:1.0:0.9'
  WHEN package_version IS NULL THEN 'downgrade:' || firmware_version
  WHEN package_version = '1.0' AND firmware_version <> '1.0.0' THEN 'downgrade:' || firmware_version || ':1.0' END"""


@query(STATES_SQL + f"SELECT k, {PREFLIGHT_SQL} AS error FROM s")
def firmware_preflight(spark, sf_dir):
    return states(spark, sf_dir).select("k", gateway.preflight_error().alias("error"))


@query(
    STATES_SQL + f""", g AS (SELECT *, [state = 'GATEWAY_CONNECTED', command_ready, observed_at IS NOT NULL, {PARKED}, {IDLE}, {LISTEN},
  {HAS.format("experiment.signed-plan")} AND CASE WHEN mode = 'PASSIVE_CAN' THEN {HAS.format("capture.passive")} ELSE {HAS.format("diagnostic.allowlisted-read")} END] AS gates FROM s)
SELECT k, n::INT AS gate_no, ['contract', 'command_channel', 'health', 'parked', 'no_capture', 'listen_only', 'capabilities'][n + 1] AS gate, gates[n + 1] AS passed,
  list_bool_and(gates) AND approved AS can_run FROM g, (SELECT unnest(range(7)) AS n)"""
)
def safety_gates(spark, sf_dir):
    return gateway.safety_gates(states(spark, sf_dir), "k")


PENDING = "(submitted_experiment IS NOT NULL AND NOT submitted_has_result)"
READY = f"(state = 'GATEWAY_CONNECTED' AND command_ready AND {PARKED} AND {IDLE} AND {LISTEN} AND {HAS.format('experiment.signed-plan')})"
OUTCOME = "CASE WHEN latest_outcome IN ('PASSIVE_LOCK', 'READ_CONFIRMED') THEN 'PASS' WHEN latest_outcome IN ('NO_LOCK', 'INCONCLUSIVE') THEN 'CHECK' WHEN latest_outcome = 'REJECTED_ERROR' THEN 'BLOCKED' ELSE 'WAIT' END"
COMPLETE = "coalesce(len(evidence_refs) > 0 AND manifest_sha256 = repeat('aF', 32), false)"
VOLT = "printf('%.2f V', supply_millivolts / 1000.0)"
HANDS, HEALTHY = "handshake_version IS NOT NULL", "observed_at IS NOT NULL"


def two_way(name: str, condition: str, yes: tuple[str, str], no: tuple[str, str]) -> tuple[str, str, str]:
    return name, f"CASE WHEN {condition} THEN '{yes[0]}' ELSE '{no[0]}' END", f"CASE WHEN {condition} THEN '{yes[1]}' ELSE '{no[1]}' END"


def shown(name: str, value: str, missing: str, condition: str, level: str = "WAIT") -> tuple[str, str, str]:
    return name, f"coalesce({value}, '{missing}')", f"CASE WHEN {condition} THEN 'PASS' ELSE '{level}' END"


def count_row(name: str, c: str, zero: str, more: str) -> tuple[str, str, str]:
    return name, f"coalesce(CAST({c} AS VARCHAR), 'UNAVAILABLE')", f"CASE WHEN {c} IS NULL THEN 'WAIT' WHEN {c} = 0 THEN '{zero}' ELSE '{more}' END"


def notified(c: str) -> tuple[str, str, str]:
    return f"transport.{c}", f"CASE WHEN {c}_enabled THEN 'SUBSCRIBED' WHEN {c}_discovered THEN 'ENABLING' ELSE 'UNAVAILABLE' END", f"CASE WHEN {c}_enabled THEN 'PASS' WHEN {c}_discovered THEN 'ACTIVE' ELSE 'WAIT' END"


INDICATOR_SQL = [
    ("summary.gateway", f"CASE WHEN {HANDS} THEN 'ONLINE' WHEN peripheral_connected AND factory_service THEN 'FACTORY MODE' WHEN state IN ('FAILED', 'DEGRADED') THEN 'LINK ERROR' WHEN peripheral_connected OR state = 'CONNECTING' OR scan_active THEN 'CONNECTING' ELSE 'NOT CONNECTED' END",
     f"CASE WHEN {HANDS} THEN 'PASS' WHEN peripheral_connected AND factory_service THEN 'CHECK' WHEN state IN ('FAILED', 'DEGRADED') THEN 'BLOCKED' WHEN peripheral_connected OR state = 'CONNECTING' OR scan_active THEN 'ACTIVE' ELSE 'WAIT' END"),
    ("summary.obd", f"CASE WHEN obd_protocol IS NOT NULL THEN 'CONFIRMED' WHEN network_protocol IS NOT NULL THEN 'NETWORK ONLY' WHEN NOT ({HANDS}) THEN 'UNVERIFIED' ELSE 'NOT TESTED' END", "CASE WHEN obd_protocol IS NOT NULL THEN 'PASS' WHEN network_protocol IS NOT NULL THEN 'CHECK' ELSE 'WAIT' END"),
    ("summary.tests", f"CASE WHEN peripheral_connected AND {PENDING} THEN 'RUNNING' WHEN {PENDING} THEN 'INTERRUPTED' WHEN latest_outcome IS NOT NULL THEN latest_outcome WHEN {READY} THEN 'READY' ELSE 'BLOCKED' END", f"CASE WHEN peripheral_connected AND {PENDING} THEN 'ACTIVE' WHEN {PENDING} THEN 'BLOCKED' WHEN latest_outcome IS NOT NULL THEN {OUTCOME} WHEN {READY} THEN 'PASS' ELSE 'BLOCKED' END"),
    ("transport.bluetooth", "CASE WHEN bluetooth_ready THEN 'READY' ELSE upper(bluetooth_state) END", "CASE WHEN bluetooth_ready THEN 'PASS' WHEN bluetooth_state = 'powered off' THEN 'BLOCKED' ELSE 'WAIT' END"),
    ("transport.scan", "CASE WHEN scan_active THEN 'SCANNING' WHEN discovered_name IS NULL THEN 'IDLE' ELSE 'FOUND' END", "CASE WHEN scan_active THEN 'ACTIVE' WHEN discovered_name IS NULL THEN 'WAIT' ELSE 'PASS' END"),
    ("transport.peripheral", "CASE WHEN peripheral_connected THEN 'CONNECTED' WHEN reconnecting THEN 'RECONNECTING' ELSE 'DISCONNECTED' END", "CASE WHEN peripheral_connected THEN 'PASS' WHEN reconnecting OR state IN ('CONNECTING', 'SCANNING') THEN 'ACTIVE' WHEN state IN ('FAILED', 'DEGRADED') THEN 'BLOCKED' ELSE 'WAIT' END"),
    ("transport.rssi", "coalesce(rssi || ' dBm', 'UNAVAILABLE')", "CASE WHEN rssi IS NULL THEN 'WAIT' WHEN rssi <= -80 THEN 'CHECK' ELSE 'PASS' END"),
    ("transport.service", "CASE WHEN gateway_service THEN 'DISCOVERED' ELSE 'NOT FOUND' END", "CASE WHEN gateway_service THEN 'PASS' WHEN factory_service THEN 'CHECK' ELSE 'WAIT' END"),
    two_way("transport.command", "command_ready", ("READY", "PASS"), ("UNAVAILABLE", "WAIT")),
    notified("stream"), notified("health"), notified("ota"),
    ("transport.frames", "CASE WHEN decode_errors > 0 THEN decode_errors || ' ERRORS' ELSE decoded_frames || ' VALID' END", "CASE WHEN decode_errors > 0 THEN 'BLOCKED' WHEN decoded_frames > 0 THEN 'PASS' ELSE 'WAIT' END"),
    ("transport.sequence", "CASE WHEN discontinuities > 0 THEN discontinuities || ' GAPS' WHEN decoded_frames > 0 THEN 'CONTINUOUS' ELSE 'NO DATA' END", "CASE WHEN discontinuities > 0 THEN 'CHECK' WHEN decoded_frames > 0 THEN 'PASS' ELSE 'WAIT' END"),
    ("gateway.mode", f"CASE WHEN {HANDS} THEN 'GATEWAY' WHEN factory_service THEN 'FACTORY' ELSE 'UNKNOWN' END", f"CASE WHEN {HANDS} THEN 'PASS' WHEN factory_service THEN 'CHECK' ELSE 'WAIT' END"),
    shown("gateway.handshake", "handshake_version", "NOT RECEIVED", HANDS), shown("gateway.identity", "gateway_id", "UNAVAILABLE", HANDS), shown("gateway.firmware", "firmware_version", "UNAVAILABLE", HANDS),
    shown("gateway.bootloader", "bootloader_version", "NOT ADVERTISED", "bootloader_version IS NOT NULL"), shown("gateway.config", "active_config_version", "UNAVAILABLE", HANDS),
    two_way("gateway.health", HEALTHY, ("RECEIVED", "PASS"), ("NOT RECEIVED", "WAIT")), shown("gateway.health-arrival", "health_arrived_at", "UNAVAILABLE", "health_arrived_at IS NOT NULL"),
    shown("gateway.supply", VOLT, "UNAVAILABLE", "supply_millivolts IS NOT NULL"),
    ("gateway.motion", "coalesce(vehicle_motion, 'UNKNOWN')", "CASE vehicle_motion WHEN 'PARKED' THEN 'PASS' WHEN 'MOVING' THEN 'CHECK' ELSE 'WAIT' END"),
    ("gateway.capture", f"CASE WHEN NOT ({HEALTHY}) THEN 'UNKNOWN' WHEN capture_active THEN 'ACTIVE' ELSE 'IDLE' END", f"CASE WHEN NOT ({HEALTHY}) THEN 'WAIT' WHEN capture_active THEN 'ACTIVE' ELSE 'PASS' END"),
    ("gateway.listen-only", f"CASE WHEN {LISTEN} THEN 'ENFORCED' ELSE 'NOT VERIFIED' END", f"CASE WHEN NOT ({HANDS}) OR NOT ({HEALTHY}) THEN 'WAIT' WHEN {LISTEN} THEN 'PASS' ELSE 'BLOCKED' END"),
    ("gateway.storage", "CASE storage_free_bytes WHEN 0 THEN '0 B' WHEN 512 THEN '512 B' WHEN 1024 THEN '1.0 KiB' WHEN 1536 THEN '1.5 KiB' ELSE 'UNAVAILABLE' END", "CASE WHEN storage_free_bytes IS NULL THEN 'WAIT' WHEN storage_free_bytes > 0 THEN 'PASS' ELSE 'CHECK' END"),
    count_row("gateway.received", "received_frames", "WAIT", "PASS"), count_row("gateway.dropped", "dropped_frames", "PASS", "CHECK"), count_row("gateway.errors", "bus_errors", "PASS", "CHECK"), count_row("gateway.bus-off", "bus_off", "PASS", "BLOCKED"),
    shown("obd.power", VOLT, "UNVERIFIED", "supply_millivolts IS NOT NULL"), two_way("obd.traffic", "coalesce(received_frames > 0, false)", ("OBSERVED", "PASS"), ("NOT OBSERVED", "WAIT")),
    shown("obd.network", "network_protocol", "NOT CONFIRMED", "network_protocol IS NOT NULL"),
    ("obd.diagnostic", "coalesce(obd_protocol, 'NOT CONFIRMED')", "CASE WHEN obd_protocol IS NOT NULL THEN 'PASS' WHEN network_protocol IS NULL THEN 'WAIT' ELSE 'CHECK' END"), ("obd.latest", "coalesce(latest_outcome, 'NOT TESTED')", OUTCOME),
    two_way("safety.contract", "state = 'GATEWAY_CONNECTED'", ("CONNECTED", "PASS"), ("REQUIRED", "BLOCKED")), two_way("safety.health", HEALTHY, ("AVAILABLE", "PASS"), ("REQUIRED", "BLOCKED")),
    ("safety.parked", "coalesce(vehicle_motion, 'UNKNOWN')", f"CASE WHEN {PARKED} THEN 'PASS' ELSE 'BLOCKED' END"),
    ("safety.capture", f"CASE WHEN NOT ({HEALTHY}) THEN 'UNKNOWN' WHEN capture_active THEN 'ACTIVE' ELSE 'IDLE' END", f"CASE WHEN {IDLE} THEN 'PASS' ELSE 'BLOCKED' END"),
    two_way("safety.listen-only", LISTEN, ("ENFORCED", "PASS"), ("REQUIRED", "BLOCKED")),
    ("safety.command-queue", "CASE WHEN chunks_pending = 0 THEN 'IDLE' ELSE chunks_pending || ' PENDING' END", "CASE WHEN chunks_pending = 0 THEN 'PASS' ELSE 'ACTIVE' END"),
    two_way("safety.signing", "signing_key", ("READY", "PASS"), ("ON FIRST APPROVAL", "WAIT")), ("safety.approval", "'REQUIRED PER RUN'", "'CHECK'"),
    ("safety.pending", f"CASE WHEN peripheral_connected AND {PENDING} THEN 'AWAITING RESULT' WHEN {PENDING} THEN 'INTERRUPTED' ELSE 'IDLE' END", f"CASE WHEN peripheral_connected AND {PENDING} THEN 'ACTIVE' WHEN {PENDING} THEN 'BLOCKED' ELSE 'PASS' END"),
    two_way("firmware.key", "release_key", ("READY", "PASS"), ("REQUIRED", "WAIT")), shown("firmware.package", "package_version", "NOT SELECTED", "package_version IS NOT NULL"),
    two_way("firmware.endpoint", "ota_upload_url IS NOT NULL", ("ADVERTISED", "PASS"), ("NOT ADVERTISED", "WAIT")),
    ("firmware.preflight", f"CASE WHEN package_version IS NULL THEN 'WAITING' WHEN {HANDS} AND {HEALTHY} AND ({PREFLIGHT_SQL}) IS NULL THEN 'PASS' ELSE 'BLOCKED' END", f"CASE WHEN package_version IS NULL THEN 'WAIT' WHEN {HANDS} AND {HEALTHY} AND ({PREFLIGHT_SQL}) IS NULL THEN 'PASS' ELSE 'BLOCKED' END"),
    two_way("firmware.update", "update_in_progress", ("UPLOADING", "ACTIVE"), ("IDLE", "PASS")), two_way("firmware.post", "ota_status_at IS NOT NULL", ("STATUS RECEIVED", "PASS"), ("NO STATUS", "WAIT")),
    two_way("firmware.context", f"{HANDS} AND {HEALTHY}", ("AVAILABLE", "PASS"), ("INCOMPLETE", "WAIT")),
    ("evidence.results", "CAST(result_count AS VARCHAR)", "CASE WHEN result_count > 0 THEN 'PASS' ELSE 'WAIT' END"),
    ("evidence.references", "CASE WHEN latest_outcome IS NULL THEN 'UNAVAILABLE' ELSE len(evidence_refs) || ' REFERENCES' END", f"CASE WHEN latest_outcome IS NULL THEN 'WAIT' WHEN {COMPLETE} THEN 'PASS' ELSE 'BLOCKED' END"),
    ("evidence.manifest", f"CASE WHEN latest_outcome IS NULL THEN 'UNAVAILABLE' WHEN {COMPLETE} THEN 'CHECKSUM PRESENT' ELSE 'INCOMPLETE' END", f"CASE WHEN latest_outcome IS NULL THEN 'WAIT' WHEN {COMPLETE} THEN 'PASS' ELSE 'BLOCKED' END"),
    two_way("evidence.export", f"{HANDS} AND {HEALTHY}", ("READY", "PASS"), ("BLOCKED", "BLOCKED")), ("evidence.authority", "'ENFORCED'", "'PASS'"),
    *((f"capability.{c}", f"CASE WHEN {HAS.format(c)} THEN 'ADVERTISED' ELSE 'NOT ADVERTISED' END", f"CASE WHEN NOT ({HANDS}) THEN 'WAIT' WHEN {HAS.format(c)} THEN 'PASS' ELSE 'CHECK' END") for c in ALL_CAPABILITIES),
]


@query(STATES_SQL + " UNION ALL ".join(f"SELECT k, '{name}' AS indicator, {value} AS value, {level} AS level FROM s" for name, value, level in INDICATOR_SQL))
def status_indicators(spark, sf_dir):
    return gateway.indicators(states(spark, sf_dir), "k")


# Documents with planted faults: (change of the document, errors it must have). A value of None takes the member out.
U = ID
CLAIM = {"contract": "ai.claim", "contract_version": "1.0.0", "claim_id": f"claim_{U}", "text": "note", "claim_type": "HYPOTHESIS", "evidence_refs": [f"obs_{U}"], "confidence": 0.5, "hypothesis": True, "authority": "NON_AUTHORITATIVE"}
SAMPLE = {"contract": "signal.sample", "contract_version": "1.0.0", "sample_id": f"sample_{U}", "vehicle_id": f"veh_{U}", "observation_id": f"obs_{U}", "signal_id": "sim.engine.rpm", "value": 1.5, "unit": "rpm", "observed_at_monotonic_us": 1, "wall_time": "2026-01-01T00:00:00Z", "quality": "GOOD", "source": {"kind": "SIMULATOR", "decoder_id": "sim.decoder"}, "versions": {"decoder": "1.0.0"}}
SEGMENT = {"path": "a/b.ndjson", "media_type": "application/x-ndjson", "sha256": "a" * 64, "byte_count": 1, "record_count": 1}
COUNTS = {"received_records": 1, "dropped_records": 0, "sequence_gaps": 0, "crc_failures": 0, "transport_reconnects": 0}
SPAN = {"start_monotonic_us": 0, "end_monotonic_us": 1, "start_wall_time": "a", "end_wall_time": "b"}
BUNDLE = {"contract": "capture.bundle.manifest", "contract_version": "1.0.0", "capture_id": f"capture_{U}", "vehicle_id": f"veh_{U}", "created_at": "2026-01-01T00:00:00Z", "capture_window": SPAN, "profile": {"kind": "SIMULATOR", "scenario_id": "sim.cold", "scenario_version": "1.0.0"}, "source": {"kind": "SIMULATOR", "source_id": "s", "source_version": "1.0.0"}, "segments": [SEGMENT], "statistics": COUNTS, "versions": {"raw_observation_contract": "1.0.0"}, "semantic_digest": "b" * 64}
INPUT = {"name": "x", "value": 1, "unit": "V", "evidence_ref": f"sample_{U}", "quality": "GOOD"}
RUN = {"contract": "calculation.run", "contract_version": "1.0.0", "calculation_id": f"calc_{U}", "vehicle_id": f"veh_{U}", "metric_id": "m.x", "equation": {"equation_id": "e.x", "version": "1.0.0"}, "versions": {"vehicle_config_pack": "1.0.0", "equation_contract": "1.0.0", "runtime": "1.0.0"}, "inputs": [INPUT], "intermediates": [], "output": {"value": 1, "unit": "V", "truth_boundary": "MEASURED"}, "confidence": 1, "confidence_factors": {"FRESHNESS": 1}, "quality_notes": [], "executed_at": "t"}
SIGNAL = {"contract": "signal.definition", "contract_version": "1.0.0", "signal_id": "sim.rpm", "registry_version": "1.0.0", "source": {"kind": "SIMULATOR", "source_id": "sim.a"}, "raw_layout": {"encoding": "INTEGER", "byte_offset": 0, "byte_length": 2, "endianness": "BIG", "signed": False}, "transform": {"language": "own-expression-1", "ast": {"kind": "operation", "operator": "divide", "arguments": [{"kind": "input", "name": "raw"}, {"kind": "literal", "value": 4}]}}, "canonical_unit": "rpm", "plausible_range": {"minimum": 0, "maximum": 9000}, "cadence": {"expected_period_ms": 10, "stale_after_ms": 100}, "applicability": {"vehicle_config_pack": "p", "conditions": []}, "validation_status": "EXPERIMENTAL", "provenance": [{"kind": "SIMULATOR_SPEC", "reference": "r"}]}
ROOT = contracts.ROOT
FAULTS = {
    "claim_contracts": (CLAIM, [
        ({}, []), ({"confidence": 1.5}, [("confidence", "maximum")]), ({"confidence": "1"}, [("confidence", "type")]), ({"more": 1}, [(ROOT, "additionalProperties")]), ({"authority": None}, [(ROOT, "required:authority")]),
        ({"evidence_refs": []}, [("evidence_refs", "minItems")]), ({"evidence_refs": [f"obs_{U}", f"obs_{U}"]}, [("evidence_refs", "uniqueItems")]), ({"evidence_refs": ["obs_x", 7]}, [("evidence_refs.0", "pattern"), ("evidence_refs.1", "type")]),
        ({"hypothesis": False}, [("hypothesis", "const")]), ({"claim_type": "VEHICLE_OBSERVATION_INTERPRETATION"}, [("hypothesis", "const")]), ({"claim_type": "GENERAL_GUIDANCE", "evidence_refs": []}, []), ({"text": ""}, [("text", "minLength")]),
        ({"contract": "own.kind"}, [("contract", "unregistered")]), ({"contract": None}, [("contract", "contract")]), ({"contract_version": "1.0.1", "text": 5}, [("contract_version", "const"), ("text", "type")])]),
    "sample_contracts": (SAMPLE, [
        ({}, []), ({"signal_id": "engine.rpm"}, [("signal_id", "pattern")]), ({"signal_id": "engine.rpm", "source": {"kind": "VEHICLE", "decoder_id": "d.x"}}, []), ({"quality": "FINE"}, [("quality", "enum")]), ({"value": True}, [("value", "type")]),
        ({"observed_at_monotonic_us": -1}, [("observed_at_monotonic_us", "minimum")]), ({"observed_at_monotonic_us": 1.5}, [("observed_at_monotonic_us", "type")]), ({"observed_at_monotonic_us": 1.0}, []), ({"versions": {}}, [("versions", "required:decoder")]), ({"unit": "k m"}, [("unit", "pattern")]), ({"source": "x"}, [("source", "type")])]),
    "manifest_contracts": (BUNDLE, [
        ({}, []), ({"segments": []}, [("segments", "minItems")]), ({"segments": [SEGMENT | {"path": "/x"}, SEGMENT | {"byte_count": "1"}]}, [("segments.0.path", "pattern"), ("segments.1.byte_count", "type")]),
        ({"profile": {"kind": "SIMULATOR"}}, [("profile", "required:scenario_id"), ("profile", "required:scenario_version")]), ({"profile": {"kind": "VEHICLE"}}, []), ({"source": BUNDLE["source"] | {"kind": "GATEWAY", "config_id": "c", "listen_only": True}}, [("source", "required:firmware_build_id"), ("source", "required:hardware_revision")]),
        ({"statistics": COUNTS | {"x": 1}}, [("statistics", "additionalProperties")]), ({"labels": [{"label": "a"}]}, [("labels.0", "required:at_monotonic_us")]), ({"capture_window": None}, [(ROOT, "required:capture_window")])]),
    "calculation_contracts": (RUN, [
        ({}, []), ({"confidence_factors": {}}, [("confidence_factors", "minProperties")]), ({"confidence_factors": {"A": 2, "B": "x"}}, [("confidence_factors.A", "maximum"), ("confidence_factors.B", "type")]), ({"inputs": [INPUT | {"evidence_ref": "veh_1", "name": "X"}]}, [("inputs.0.evidence_ref", "pattern"), ("inputs.0.name", "pattern")]),
        ({"recalculation_of": "calc_1"}, [("recalculation_of", "pattern")]), ({"quality_notes": [1]}, [("quality_notes.0", "type")]), ({"output": RUN["output"] | {"truth_boundary": "SURE"}}, [("output.truth_boundary", "enum")])]),
    "definition_contracts": (SIGNAL, [
        ({}, []), ({"raw_layout": SIGNAL["raw_layout"] | {"byte_length": 9, "bit_offset": 64}}, [("raw_layout.bit_offset", "maximum"), ("raw_layout.byte_length", "maximum")]), ({"transform": {"language": "own-expression-1", "ast": {"kind": "operation", "operator": "power", "arguments": [1]}}}, [("transform.ast", "oneOf")]),
        ({"cadence": {"expected_period_ms": 0, "stale_after_ms": 1}}, [("cadence.expected_period_ms", "minimum")]), ({"provenance": [{"kind": "HEARSAY", "reference": ""}]}, [("provenance.0.kind", "enum"), ("provenance.0.reference", "minLength")]), ({"validation_status": None}, [(ROOT, "required:validation_status")])]),
}


def register(name: str, base: dict, faults: list) -> None:
    documents = [json.dumps({k: v for k, v in (base | change).items() if v is not None}) for change, _ in faults]
    expected = [(i, (base | change).get("contract"), p, r) for i, (change, errors) in enumerate(faults) for p, r in errors]
    kind = base["contract"]

    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, documents)), (F.col("event_id") % len(documents) + 1).cast("int")).alias("doc"))
        return contracts.contract_errors(docs, "doc", "event_id", only=(kind,)).select("event_id", F.coalesce("contract", F.lit("none")).alias("contract"), "path", "rule")

    run.__name__ = name
    rows = ", ".join(f"({i}, '{c or 'none'}', '{p}', '{r}')" for i, c, p, r in expected)
    query(f"SELECT event_id, contract, path, rule FROM events JOIN (VALUES {rows}) AS f(fault, contract, path, rule) ON event_id % {len(documents)} = fault")(run)


for _name, (_base, _faults) in FAULTS.items():
    register(_name, _base, _faults)


def observations(spark, sf_dir) -> DataFrame:
    """Events as one capture: event_id is the sequence, value drives the four readings."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), "value")
    ms = F.lit(scenario.BASE_MS) + F.col("sequence")
    data = scenario.encode_state(F.col("value") * 10, F.col("value"), F.col("value") - 40, F.col("value") / 10)
    rows = events.withColumns({"data": data, "vehicle_id": F.lit(f"veh_{ID}"), "capture_id": F.lit(f"capture_{ID}")})
    return rows.select(
        F.lit("raw.observation").alias("contract"), F.lit("1.0.0").alias("contract_version"),
        ids.deterministic_id("obs", F.concat_ws(":", F.col("sequence").cast("string"), "data"), ms).alias("observation_id"), "vehicle_id", "capture_id", "sequence",
        (F.col("sequence") * 1000).alias("observed_at_monotonic_us"), scenario.wall_time(ms).alias("wall_time"),
        F.struct(F.lit("SIMULATOR").alias("kind"), F.lit("sim.events").alias("source_id"), F.lit(scenario.CHANNEL).alias("channel"), F.lit(None).cast("int").alias("bus_index"), F.lit(None).cast("int").alias("arbitration_id"), F.lit(None).cast("boolean").alias("extended_id")).alias("source"),
        F.struct(F.lit("HEX").alias("encoding"), F.col("data"), F.sha2(F.unhex("data"), 256).alias("sha256")).alias("payload"), F.lit("GOOD").alias("quality"), F.struct(F.lit("1.0.0").alias("source")).alias("versions"),
    )


@query("""
WITH v AS (SELECT event_id AS sequence, value FROM events)
SELECT sequence, 'sim.engine.rpm' AS signal_id, round_even(value * 10 * 4, 0) / 4.0 AS value, 'rpm' AS unit FROM v
UNION ALL SELECT sequence, 'sim.vehicle.speed', round_even(value * 10, 0) / 10.0, 'km/h' FROM v
UNION ALL SELECT sequence, 'sim.engine.coolant-temp', round_even((value - 40) * 10, 0) / 10.0, 'Cel' FROM v
UNION ALL SELECT sequence, 'sim.electrical.system-voltage', round_even(value / 10 * 1000, 0) / 1000.0, 'V' FROM v""")
def bundle_replay(spark, sf_dir):
    folder = f"{scratch.shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    bundles.write_bundle(observations(spark, sf_dir), folder)
    _, rows = bundles.load_bundle(spark, folder)
    return replay.decode(rows).select("sequence", "signal_id", "value", "unit")


@query("""
SELECT (event_id - (SELECT min(event_id) FROM events) + 1)::INT AS line_no, code FROM events JOIN (VALUES (1, 'observation'), (1, 'capture_id'), (2, 'payload_hash'), (3, 'vehicle_id'), (4, 'time'), (5, 'sequence'), (6, 'sequence')) AS f(fault, code) ON event_id % 50 = fault
WHERE NOT (event_id % 50 IN (4, 5, 6) AND event_id = (SELECT min(event_id) FROM events))""")
def bundle_faults(spark, sf_dir):
    from loomtrace.functions.canonical import canonical_json

    fault = F.col("sequence") % 50
    rows = observations(spark, sf_dir).withColumn("at", F.col("sequence"))
    rows = rows.withColumns(
        {
            "capture_id": F.when(fault == 1, "capture_x").otherwise(F.col("capture_id")),
            "payload": F.struct(F.col("payload.encoding"), F.col("payload.data"), F.when(fault == 2, F.lit("0" * 64)).otherwise(F.col("payload.sha256")).alias("sha256")),
            "vehicle_id": F.when(fault == 3, f"veh_{ID[::-1][:25]}0").otherwise(F.col("vehicle_id")),
            "observed_at_monotonic_us": F.when(fault == 4, F.col("observed_at_monotonic_us") - 1000).otherwise(F.col("observed_at_monotonic_us")),
            "sequence": F.when(fault == 5, F.col("sequence") + 100).otherwise(F.col("sequence")),
        }
    )
    first = rows.agg(F.min("at").alias("first"))
    lines = rows.join(F.broadcast(first)).select(F.lit(0).alias("segment_no"), F.lit("s").alias("segment"), (F.col("at") - F.col("first") + 1).cast("int").alias("line_no"), (F.col("at") - F.col("first")).alias("position"), canonical_json(rows.drop("at")).alias("line"))
    return bundles.observation_errors(lines, {"capture_id": f"capture_{ID}", "vehicle_id": f"veh_{ID}"}).select("line_no", "code")


@query("SELECT event_id, 'user-' || user_id AS session_id, (1 + event_id % 10)::INT AS message_type, event_id::BIGINT AS sequence, props AS payload FROM events")
def frame_round_trip(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), "event_id", (1 + F.col("event_id") % 10).cast("int").alias("message_type"), F.col("event_id").alias("sequence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("monotonic_us"), F.col("props").cast("binary").alias("payload"))
    chunks = frames.chunked(frames.encoded_frames(rows, "session_id", "event_id"), "frame", 20)
    arrived = chunks.select("session_id", (F.col("event_id") * 1000 + F.col("chunk_no")).alias("arrival_idx"), "chunk")
    out = frames.reassemble_batch(arrived).where("error IS NULL")
    return out.select(F.col("sequence").cast("long").alias("event_id"), "session_id", "message_type", F.col("sequence").cast("long").alias("sequence"), F.col("payload").cast("string").alias("payload"))


@query("""
SELECT 'user-' || user_id AS session_id, arg_max('h' || event_id, event_id) FILTER (WHERE event_id % 10 = 0) AS handshake, arg_max('h' || event_id, event_id) FILTER (WHERE event_id % 10 = 3) AS health,
  count(*) FILTER (WHERE event_id % 10 = 9) AS results FROM events WHERE event_id % 10 IN (0, 3, 7, 9) GROUP BY user_id""")
def latest_messages(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("arrival_idx"), F.lit(0).alias("frame_no"), (1 + F.col("event_id") % 10).cast("int").alias("message_type"), F.concat(F.lit("h"), F.col("event_id").cast("string")).cast("binary").alias("payload"))
    return frames.latest_messages(rows).select("session_id", "handshake", "health", "results")


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'incomplete_header' WHEN 1 THEN 'invalid_magic' WHEN 2 THEN 'unsupported_format:2' WHEN 3 THEN 'invalid_length' WHEN 4 THEN 'manifest_unreadable' WHEN 5 THEN 'invalid_contract' WHEN 6 THEN 'size_mismatch' WHEN 7 THEN 'hash_mismatch' END AS error,
  CASE WHEN p_partkey % 9 > 3 THEN sha256(p_name) END AS firmware_sha256 FROM part""")
def package_checks(spark, sf_dir):
    n = F.col("p_partkey") % 9
    image = F.col("p_name").cast("binary")
    fields = F.struct(
        F.when(n == 5, "other").otherwise("firmware.manifest").alias("contract"), F.lit("1.0.0").alias("contract_version"), F.when(n != 4, "p").alias("package_id"), F.lit("dev").alias("release_channel"), F.lit("t").alias("created_at"), F.lit("1.2.0").alias("firmware_version"), F.lit("b").alias("firmware_build_id"),
        F.when(n == 7, "0" * 64).otherwise(F.upper(F.sha2(image, 256))).alias("firmware_sha256"), (F.octet_length(image) + F.when(n == 6, 1).otherwise(0)).cast("long").alias("firmware_size_bytes"), F.array(F.lit("rev-a")).alias("supported_hardware_revisions"), F.lit(11500).cast("long").alias("minimum_supply_millivolts"), F.array(F.lit("ota.ab")).alias("required_capabilities"),
    )
    whole = packages.encoded(F.to_json(fields), image, F.lit("signature").cast("binary"))
    text = F.hex(whole)
    broken = F.when(n == 0, F.substring(text, 1, 20)).when(n == 1, F.concat(F.lit("00"), F.substring(text, 3, 1 << 20))).when(n == 2, F.concat(F.substring(text, 1, 8), F.lit("0002"), F.substring(text, 13, 1 << 20))).when(n == 3, F.concat(text, F.lit("00"))).otherwise(text)
    rows = packages.decoded(read(spark, sf_dir, "part").select("p_partkey", F.unhex(broken).alias("content")))
    return rows.select("p_partkey", packages.package_error().alias("error"), F.when(n > 3, F.sha2("firmware", 256)).alias("firmware_sha256"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'unsupported_target' WHEN p_partkey % 3 = 0 THEN 'invalid_range:app' WHEN p_partkey % 4096 < 1024 AND p_partkey % 4096 + p_size > 512 THEN 'overlaps:app:identity' END AS error FROM part""")
def release_checks(spark, sf_dir):
    n = F.col("p_partkey")
    part = lambda label, address, count: F.struct(F.lit(label).alias("label"), address.cast("long").alias("address"), count.cast("long").alias("byteCount"))
    rows = read(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(n % 5 == 0, "2.0.0").otherwise("1.1.0").alias("schemaVersion"),
        F.when(n % 7 == 0, "ESP32").otherwise("ESP32-S3").alias("chipFamily"),
        F.array(part("boot", F.lit(1 << 20), F.lit(10)), part("app", n % 4096, F.when(n % 3 == 0, 0).otherwise(F.col("p_size")))).alias("segments"),
        F.array(part("identity", F.lit(512), F.lit(512))).alias("protectedRanges"),
    )
    return rows.select("p_partkey", packages.release_error("ESP32-S3").alias("error"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'length_mismatch' WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN 'hash_mismatch' END END AS error FROM part""")
def artifact_checks(spark, sf_dir):
    n = F.col("p_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), n.cast("string")).alias("path"), F.col("p_name").cast("binary").alias("content"))
    size = F.octet_length("content")
    published = parts.select("p_partkey", "path", (size + F.when(n % 4 == 1, 1).otherwise(0)).cast("long").alias("byte_count"), F.when(n % 8 == 2, "0" * 64).when(n % 8 != 6, F.upper(F.sha2("content", 256))).alias("sha256"))
    return packages.artifact_errors(published, parts.where(n % 4 != 0).select("path", "content")).select("p_partkey", "error")


def definition(signal: str, encoding: str, at: int, size: int, order: str, signed: bool, ast: dict, **bits: int) -> dict:
    return {"signal_id": signal, "canonical_unit": "u", "source": {"kind": "CAN_FRAME", "source_id": "bus"}, "raw_layout": {"encoding": encoding, "byte_offset": at, "byte_length": size, "endianness": order, "signed": signed, **bits}, "transform": {"ast": ast}, "plausible_range": {"minimum": -50, "maximum": 60}, "cadence": {"stale_after_ms": 5}}


RAW = {"kind": "input", "name": "raw"}
DEFINITIONS = [
    definition("a.big", "INTEGER", 0, 2, "BIG", True, {"kind": "operation", "operator": "divide", "arguments": [RAW, {"kind": "literal", "value": 4}]}),
    definition("b.little", "INTEGER", 0, 2, "LITTLE", False, RAW),
    definition("c.bits", "BIT_FIELD", 0, 2, "BIG", False, RAW, bit_offset=3, bit_length=5),
    definition("d.float", "IEEE754", 2, 8, "LITTLE", False, RAW),
    definition("e.beyond", "INTEGER", 9, 4, "BIG", False, RAW),
]


@query("""
WITH x AS (SELECT event_id, value, ((round_even((value - 50) * 4, 0)::BIGINT % 65536) + 65536) % 65536 AS u, event_id % 7 AS age FROM events),
y AS (SELECT event_id, age, 'a.big' AS signal_id, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END / 4.0 AS value FROM x
  UNION ALL SELECT event_id, age, 'b.little', CAST((u % 256) * 256 + u // 256 AS DOUBLE) FROM x UNION ALL SELECT event_id, age, 'c.bits', CAST((u // 8) % 32 AS DOUBLE) FROM x
  UNION ALL SELECT event_id, age, 'd.float', CASE event_id % 4 WHEN 0 THEN 0.15625 WHEN 1 THEN -2.0 WHEN 2 THEN 1e300 ELSE 0.0 END FROM x UNION ALL SELECT event_id, age, 'e.beyond', NULL FROM x)
SELECT event_id, signal_id, value, CASE WHEN value IS NULL THEN 'MISSING' WHEN age > 5 THEN 'STALE' WHEN value NOT BETWEEN -50 AND 60 THEN 'OUT_OF_RANGE' ELSE 'GOOD' END AS quality FROM y""")
def layout_decode(spark, sf_dir):
    import struct

    doubles = F.element_at(F.array(*(F.lit(struct.pack("<d", x).hex()) for x in (0.15625, -2.0, 1e300, 0.0))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(be_hex(fixed_point(F.col("value") - 50, 4), 2), doubles)).alias("payload"), F.lit("CAN_FRAME").alias("kind"), F.lit("bus").alias("source_id"))
    return layouts.decoded_signals(rows, DEFINITIONS, F.col("payload"), F.col("kind"), F.col("source_id"), F.col("event_id") % 7).select("event_id", "signal_id", "value", "quality")


@query("SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL ELSE 'c' || event_id % 5 END AS capture_id, CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 100)::BIGINT END AS bus_index, CASE WHEN event_id % 9 = 8 THEN NULL ELSE event_id % 2 = 1 END AS extended_id, CASE WHEN event_id % 9 = 8 THEN 'field beyond the message' END AS error FROM events")
def protobuf_decode(spark, sf_dir):
    n = F.col("event_id")
    name = F.concat(F.lit("c"), (n % 5).cast("string"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    wire = F.concat(F.lit("0A02"), F.hex(name.cast("binary")), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("10"), byte(n % 100))), F.lit("3A0199"), F.lit("28"), byte(n % 2))
    wire = F.when(n % 9 == 8, F.lit("0A05AB")).otherwise(F.regexp_replace(wire, "3A0199", "7A0199"))  # field 15 is unknown and passed over
    rows = read(spark, sf_dir, "events").select("event_id", F.unhex(wire).alias("payload"))
    return protobuf.decoded(rows, "raw_can_frame", "event_id").select("event_id", "capture_id", "bus_index", "extended_id", "error")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 4 = 3")
def unknown_equations(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("string").alias("equation_id"), (F.col("o_orderkey") % 4).cast("string").alias("version"))
    known = spark.createDataFrame([(str(e), str(v)) for e in (1, 2) for v in (0, 1, 2)], "equation_id string, version string")
    return lineage.unknown_equations(runs, known).select("o_orderkey")


@query("""
WITH m AS (SELECT min(event_id) AS first FROM events)
SELECT event_id, event_id - (event_id - first) % 37 AS root, ((event_id - first) % 37)::BIGINT AS depth FROM events, m""")
def recalculation_roots(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id")
    runs = events.join(F.broadcast(events.agg(F.min("event_id").alias("first")))).select("event_id", F.when((F.col("event_id") - F.col("first")) % 37 != 0, F.col("event_id") - 1).alias("parent"))
    return lineage.recalculation_roots(runs, "event_id", "parent").withColumnRenamed("id", "event_id")


@query("""
WITH b AS (SELECT user_id, event_type, event_id AS version, value, 0 AS c FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_type, event_id, -value, 1 FROM events WHERE event_id % 3 <> 1)
SELECT user_id, event_type, version, value FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC, c DESC) = 1""")
def upsert_rows(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("version"), "value")
    return lineage.upsert(events.where("version % 3 <> 0"), events.where("version % 3 <> 1").withColumn("value", -F.col("value")), ["user_id", "event_type"], "version")


@query(
    STATES_SQL + """
SELECT k, '{"active_config_id":"cfg","active_config_version":"2.0","authority":{"may_activate_vehicle_experiment":false,"may_emit_raw_vehicle_frames":false,"may_interpret_evidence":true,"may_propose_signed_experiment_plans":true,"may_rank_hypotheses":true},"contract":"agent.evidence-handoff","contract_version":"1.0.0","experiment_results":[' ||
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '{"order":1,"outcome":"NO_LOCK"}' ELSE '{"order":1,"outcome":"NO_LOCK"},{"order":2,"outcome":"PASSIVE_LOCK"}' END || '],"firmware_build_id":"b7","gateway_id":"gw-' || k || '","generated_at":"now","hardware_revision":"' || hardware_revision || '"' ||
  ',"vehicle_motion":"' || vehicle_motion || '"}' AS document FROM s WHERE handshake_version IS NOT NULL AND observed_at IS NOT NULL"""
)
def evidence_snapshot(spark, sf_dir):
    s = states(spark, sf_dir)
    results = s.select("k", F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("order"), F.lit(o).alias("outcome")) for i, o in ((2, "PASSIVE_LOCK"), (1, "NO_LOCK")))), lambda r: r["order"] <= F.col("k") % 3)).alias("r")).select("k", "r.*")
    return lineage.snapshot(s, results, "k", F.lit("now"), "order")


@query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN c_custkey % 256 BETWEEN 16 AND 31 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN false ELSE false END AS local FROM customer""")
def upload_addresses(spark, sf_dir):
    n = F.col("c_custkey")
    kinds = [F.lit("http://10.1.2.3/upload/ota.bin"), F.format_string("http://172.%d.0.1/upload/ota.bin", n % 256), F.lit("http://Gate.LOCAL/upload/ota.bin"), F.lit("https://10.1.2.3/upload/ota.bin"), F.lit("http://192.168.30.1/upload/ota.bin"), F.lit("http://192.168.300.1/upload/ota.bin"), F.lit("http://10.1.2.3/other"), F.lit("http://8.8.8.8/upload/ota.bin")]
    return read(spark, sf_dir, "customer").select("c_custkey", gateway.is_local_upload(F.element_at(F.array(*kinds), (n % 8 + 1).cast("int"))).alias("local"))


@query("""
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS observation_no, event_type = 'click' OR event_id % 10 = 0 AS supported FROM events)
SELECT user_id, event_id, observation_no::INT AS observation_no FROM a WHERE supported OR observation_no % 25 = 0""")
def advertisements(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type").alias("services"), F.when(F.col("event_id") % 10 == 0, "My GateWay").alias("name"))
    rows = rows.withColumn("supported", gateway.advertises(F.col("services"), F.col("name"), ["click"], ["gateway"]))
    return gateway.advertisement_log(rows, "user_id", ["event_id"], "supported").select("user_id", "event_id", "observation_no")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_partkey % 3 <> 0 ELSE false END AS matches FROM part")
def chip_targets(spark, sf_dir):
    n = F.col("p_partkey")
    chip = F.element_at(F.array(*map(F.lit, ("esp32-s3 rev 1", "ESP32-S2", "esp32-d0wd", "other"))), (n % 4 + 1).cast("int"))
    family = F.when((n % 4 == 0) | (n % 3 == 0), "ESP32-S3").otherwise("ESP32")
    return read(spark, sf_dir, "part").select("p_partkey", gateway.chip_matches(chip, family).alias("matches"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'timestamp' WHEN event_id % 5 = 0 THEN 'entropy' END AS error FROM events")
def id_parts(spark, sf_dir):
    n = F.col("event_id")
    time = F.when(n % 3 == 0, F.when(n % 2 == 0, F.lit(-1)).otherwise(F.lit(1 << 48))).otherwise(n)
    return read(spark, sf_dir, "events").select("event_id", ids.id_parts_error(time, F.unhex(F.repeat(F.lit("ab"), F.when(n % 5 == 0, 9).otherwise(10)))).alias("error"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 32 END AS key_bytes FROM part")
def public_keys(spark, sf_dir):
    raw = F.sha2("p_name", 256)
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, raw).when(n == 1, F.upper(raw)).when(n == 2, F.concat(F.lit(" "), F.base64(F.unhex(raw)), F.lit(" "))).otherwise(F.base64(F.unhex(F.substring(raw, 1, 40))))
    return read(spark, sf_dir, "part").select("p_partkey", F.octet_length(packages.key_bytes(text)).alias("key_bytes"))


@query("""
WITH r AS (SELECT s_suppkey * 70 AS lo, s_suppkey * 70 + s_suppkey % 9 AS hi FROM supplier UNION ALL SELECT i * 1000, i * 1000 + 3 FROM range(12000) t(i)),
p AS (SELECT p_partkey, p_partkey * 13 AS lo, p_partkey * 13 + p_size % 7 AS hi FROM part)
SELECT p_partkey FROM p WHERE EXISTS (SELECT 1 FROM r WHERE p.lo < r.hi AND p.hi > r.lo)""")
def range_overlap_large(spark, sf_dir):
    held = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 70).alias("start"), (F.col("s_suppkey") * 70 + F.col("s_suppkey") % 9).alias("end"))
    held = held.unionByName(spark.range(12_000).select((F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 3).alias("end")))
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 13).alias("start"), (F.col("p_partkey") * 13 + F.col("p_size") % 7).alias("end"))
    return ranges.overlapping(parts, held).select("p_partkey")
