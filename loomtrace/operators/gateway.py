"""Gates and indicators over the latest state of a gateway: ordered checks, readiness, status tables.

All work on one row a gateway or session, with flat columns; a null is evidence that has not arrived, and
missing evidence never passes a gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.binary import byte_text, compare_versions, millivolt_text
from loomtrace.operators.state import counter_level

# Fixed values of the gateway's contracts.
CAPABILITIES = ("capture.passive", "experiment.signed-plan", "diagnostic.allowlisted-read", "ota.ab", "ota.signed-image", "ota.rollback-self-test", "evidence.export")
PASSIVE_CAN = ("CAN_11_500", "CAN_29_500", "CAN_11_250", "CAN_29_250")
PROTOCOLS = (*PASSIVE_CAN, "ISO_9141_2", "ISO_14230_FAST", "ISO_14230_SLOW", "J1850_PWM", "J1850_VPW")
ALLOWED_READ = "obd.standard.supported-pids"
WINDOW_SECONDS = (1, 30)
CANDIDATES = "array<struct<protocol_id: string, phase: string, bounded_window_seconds: int, allowlist_entry_id: string>>"

#: The state in which a gateway speaks our contract.
CONNECTED = "GATEWAY_CONNECTED"


def yes(condition: Column | str) -> Column:
    return F.coalesce(F.col(condition) if isinstance(condition, str) else condition, F.lit(False))


def all_of(*conditions: Column | str) -> Column:
    return reduce(lambda a, b: a & b, map(yes, conditions))


def first_of(*checks: tuple[Column, Column | str]) -> Column:
    """The code of the first check that fails; null if none does. A check is (what must hold, code)."""
    return F.coalesce(*(F.when(~yes(met), code if isinstance(code, Column) else F.lit(code)) for met, code in checks))


def has_capability(name: Column | str) -> Column:
    return yes(F.array_contains("capabilities", F.lit(name) if isinstance(name, str) else name))


def listen_only() -> Column:
    """Handshake and health must both say so."""
    return all_of("handshake_listen_only", "health_listen_only")


def parked() -> Column:
    return yes(F.col("vehicle_motion") == "PARKED")


def idle() -> Column:
    return yes(~F.col("capture_active"))


def plan_error(candidates: str = "candidates", approved: str = "approved") -> Column:
    """The first reason why a discovery plan is unsafe, as a code; null for a safe plan.

    Motion, approval, an idle capture and the capability for signed plans come first; then each candidate in
    order: its window, and by phase that a passive one only listens on CAN and a reading one stays on the
    allowed entry.
    """

    def candidate(c: Column) -> Column:
        window = c["bounded_window_seconds"]
        passive = first_of(
            (has_capability("capture.passive") & listen_only(), "missing_capability:capture.passive"),
            (c["protocol_id"].isin(*PASSIVE_CAN), "passive_requires_can"),
            (c["allowlist_entry_id"].isNull(), "passive_has_allowlist"),
        )
        reading = first_of((has_capability("diagnostic.allowlisted-read"), "missing_capability:diagnostic.allowlisted-read"), (c["allowlist_entry_id"] == ALLOWED_READ, "allowlist_invalid"))
        by_phase = F.when(c["phase"] == "PASSIVE_LISTEN", passive).when(c["phase"] == "INTERPRETER_ALLOWLISTED_READ", reading).otherwise("unknown_phase")
        return F.coalesce(F.when(~yes(window.between(*WINDOW_SECONDS)), F.concat(F.lit("invalid_window:"), F.coalesce(window.cast("string"), F.lit("none")))), by_phase)

    whole = first_of(
        (parked(), "not_parked"),
        (F.col(approved), "approval_required"),
        (idle(), "capture_active"),
        (has_capability("experiment.signed-plan"), "missing_capability:experiment.signed-plan"),
        (F.size(candidates) > 0, "empty_plan"),
    )
    return F.coalesce(whole, F.get(F.filter(F.transform(candidates, candidate), lambda e: e.isNotNull()), F.lit(0)))


def preflight_error() -> Column:
    """The first reason why a firmware package may not be installed, as a code; null if it may.

    Columns of the package: minimum_supply_millivolts, supported_hardware, required_capabilities,
    firmware_bytes, minimum_bootloader, package_version.
    """
    missing = F.get(F.filter(F.array_sort("required_capabilities"), lambda c: ~has_capability(c)), F.lit(0))
    newer = lambda a, b: compare_versions(F.col(a), F.col(b)) >= 0
    code = lambda text, *columns: F.concat_ws(":", F.lit(text), *(F.col(c).cast("string") for c in columns))
    return first_of(
        (parked(), "not_parked"),
        (idle(), "capture_active"),
        (listen_only(), "not_listen_only"),
        (F.col("supply_millivolts").isNotNull(), "supply_unavailable"),
        (F.col("supply_millivolts") >= F.col("minimum_supply_millivolts"), code("supply_too_low", "minimum_supply_millivolts", "supply_millivolts")),
        (F.array_contains("supported_hardware", F.col("hardware_revision")), code("hardware_unsupported", "hardware_revision")),
        (missing.isNull(), F.concat(F.lit("missing_capability:"), missing)),
        (F.col("ota_maximum_image_bytes").isNull() | (F.col("firmware_bytes") <= F.col("ota_maximum_image_bytes")), code("image_too_large", "ota_maximum_image_bytes", "firmware_bytes")),
        (F.col("minimum_bootloader").isNull() | F.col("bootloader_version").isNotNull(), "bootloader_unavailable"),
        (F.col("minimum_bootloader").isNull() | newer("bootloader_version", "minimum_bootloader"), code("bootloader_too_old", "minimum_bootloader", "bootloader_version")),
        (newer("package_version", "firmware_version"), code("downgrade", "firmware_version", "package_version")),
    )


def capability_ready(mode: str = "mode") -> Column:
    """Signed plans and what the chosen mode needs."""
    return has_capability("experiment.signed-plan") & has_capability(F.when(F.col(mode) == "PASSIVE_CAN", "capture.passive").otherwise("diagnostic.allowlisted-read"))


def core_ready() -> Column:
    return all_of(F.col("state") == CONNECTED, "command_ready", parked(), idle(), listen_only(), has_capability("experiment.signed-plan"))


def safety_gates(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., gate_no, gate, passed): the seven gates of an experiment, a row each, and can_run over all of them with the approval."""
    gates = [
        ("contract", F.col("state") == CONNECTED),
        ("command_channel", F.col("command_ready")),
        ("health", F.col("observed_at").isNotNull()),
        ("parked", parked()),
        ("no_capture", idle()),
        ("listen_only", listen_only()),
        ("capabilities", capability_ready()),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("gate_no"), F.lit(name).alias("gate"), yes(met).alias("passed")) for i, (name, met) in enumerate(gates)))
    return df.select(*keep, all_of(*(m for _, m in gates), "approved").alias("can_run"), F.explode(rows).alias("g")).select(*keep, "g.*", "can_run")


def capability_rows(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., indicator, value, level): all capabilities, each with whether the gateway advertises it."""
    rows = df.select(*keep, "handshake_version", "capabilities", F.explode(F.array(*map(F.lit, CAPABILITIES))).alias("capability"))
    said = has_capability(F.col("capability"))
    level = F.when(F.col("handshake_version").isNull(), "WAIT").when(said, "PASS").otherwise("CHECK")
    return rows.select(*keep, F.concat(F.lit("capability."), "capability").alias("indicator"), F.when(said, "ADVERTISED").otherwise("NOT ADVERTISED").alias("value"), level.alias("level"))


def evidence_complete() -> Column:
    """References, and a manifest hash of 64 hex digits."""
    return all_of(F.size("evidence_refs") > 0, F.col("manifest_sha256").rlike("^[0-9A-Fa-f]{64}$"))


def awaiting_result() -> Column:
    return F.col("submitted_experiment").isNotNull() & ~yes("submitted_has_result")


def outcome_level(outcome: Column) -> Column:
    return F.when(outcome.isin("PASSIVE_LOCK", "READ_CONFIRMED"), "PASS").when(outcome.isin("NO_LOCK", "INCONCLUSIVE"), "CHECK").when(outcome == "REJECTED_ERROR", "BLOCKED").otherwise("WAIT")


def present(c: str, otherwise: str = "WAIT") -> Column:
    return F.when(F.col(c).isNull(), otherwise).otherwise("PASS")


def or_else(c: Column | str, text: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(text))


def case(*parts: tuple[Column | str, Column | str], otherwise: Column | str) -> Column:
    """The first value whose condition is true."""
    out = None
    for condition, value in parts:
        condition, value = yes(condition), F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def counter(name: str, column: str, zero: str, more: str) -> tuple[str, Column, Column]:
    level = F.when(F.col(column).isNull(), "WAIT").when(F.col(column) == 0, zero).otherwise(more)
    return name, or_else(column, "UNAVAILABLE"), level


def notification(name: str) -> tuple[str, Column, Column]:
    on, seen = f"{name}_enabled", f"{name}_discovered"
    return f"transport.{name}", case((on, "SUBSCRIBED"), (seen, "ENABLING"), otherwise="UNAVAILABLE"), case((on, "PASS"), (seen, "ACTIVE"), otherwise="WAIT")


def summary_cards() -> list[tuple[str, Column, Column]]:
    """Three cards, each by the first case that holds."""
    gateway = [
        (F.col("handshake_version").isNotNull(), "ONLINE", "PASS"),
        (all_of("peripheral_connected", "factory_service"), "FACTORY MODE", "CHECK"),
        (F.col("state").isin("FAILED", "DEGRADED"), "LINK ERROR", "BLOCKED"),
        (yes("peripheral_connected") | yes(F.col("state") == "CONNECTING") | yes("scan_active"), "CONNECTING", "ACTIVE"),
        (F.lit(True), "NOT CONNECTED", "WAIT"),
    ]
    obd = [
        (F.col("obd_protocol").isNotNull(), "CONFIRMED", "PASS"),
        (F.col("network_protocol").isNotNull(), "NETWORK ONLY", "CHECK"),
        (F.col("handshake_version").isNull(), "UNVERIFIED", "WAIT"),
        (F.lit(True), "NOT TESTED", "WAIT"),
    ]
    tests = [
        (all_of("peripheral_connected", awaiting_result()), "RUNNING", "ACTIVE"),
        (awaiting_result(), "INTERRUPTED", "BLOCKED"),
        (F.col("latest_outcome").isNotNull(), F.col("latest_outcome"), outcome_level(F.col("latest_outcome"))),
        (core_ready(), "READY", "PASS"),
        (F.lit(True), "BLOCKED", "BLOCKED"),
    ]
    pick = lambda parts, i: case(*((p[0], p[i]) for p in parts[:-1]), otherwise=parts[-1][i])
    return [(name, pick(parts, 1), pick(parts, 2)) for name, parts in (("summary.gateway", gateway), ("summary.obd", obd), ("summary.tests", tests))]


def transport_table() -> list[tuple[str, Column, Column]]:
    link_down = case((F.col("state").isin("FAILED", "DEGRADED"), "BLOCKED"), (F.col("state").isin("CONNECTING", "SCANNING"), "ACTIVE"), otherwise="WAIT")
    radio_down = case((F.col("bluetooth_state").isin("initializing", "unknown", "resetting"), "WAIT"), otherwise="BLOCKED")
    named, some_frames = F.col("discovered_name").isNotNull(), F.col("decoded_frames") > 0
    return [
        ("transport.bluetooth", case(("bluetooth_ready", "READY"), otherwise=F.upper("bluetooth_state")), case(("bluetooth_ready", "PASS"), otherwise=radio_down)),
        ("transport.scan", case(("scan_active", "SCANNING"), (named, "FOUND"), otherwise="IDLE"), case(("scan_active", "ACTIVE"), (named, "PASS"), otherwise="WAIT")),
        ("transport.peripheral", case(("peripheral_connected", "CONNECTED"), ("reconnecting", "RECONNECTING"), otherwise="DISCONNECTED"), case(("peripheral_connected", "PASS"), ("reconnecting", "ACTIVE"), otherwise=link_down)),
        ("transport.rssi", or_else(F.concat(F.col("rssi").cast("string"), F.lit(" dBm")), "UNAVAILABLE"), case((F.col("rssi").isNull(), "WAIT"), (F.col("rssi") <= -80, "CHECK"), otherwise="PASS")),
        ("transport.service", case(("gateway_service", "DISCOVERED"), otherwise="NOT FOUND"), case(("gateway_service", "PASS"), ("factory_service", "CHECK"), otherwise="WAIT")),
        ("transport.command", case(("command_ready", "READY"), otherwise="UNAVAILABLE"), case(("command_ready", "PASS"), otherwise="WAIT")),
        notification("stream"),
        notification("health"),
        notification("ota"),
        (
            "transport.frames",
            case((F.col("decode_errors") > 0, F.concat(F.col("decode_errors").cast("string"), F.lit(" ERRORS"))), otherwise=F.concat(F.col("decoded_frames").cast("string"), F.lit(" VALID"))),
            case((F.col("decode_errors") > 0, "BLOCKED"), (some_frames, "PASS"), otherwise="WAIT"),
        ),
        (
            "transport.sequence",
            case((F.col("discontinuities") > 0, F.concat(F.col("discontinuities").cast("string"), F.lit(" GAPS"))), (some_frames, "CONTINUOUS"), otherwise="NO DATA"),
            case((F.col("discontinuities") > 0, "CHECK"), (some_frames, "PASS"), otherwise="WAIT"),
        ),
    ]


def gateway_table() -> list[tuple[str, Column, Column]]:
    hands, healthy = F.col("handshake_version").isNotNull(), F.col("observed_at").isNotNull()
    motion = case((parked(), "PASS"), (F.col("vehicle_motion") == "MOVING", "CHECK"), otherwise="WAIT")
    by_hands = case((hands, "PASS"), otherwise="WAIT")
    return [
        ("gateway.mode", case((hands, "GATEWAY"), ("factory_service", "FACTORY"), otherwise="UNKNOWN"), case((hands, "PASS"), ("factory_service", "CHECK"), otherwise="WAIT")),
        ("gateway.handshake", or_else("handshake_version", "NOT RECEIVED"), by_hands),
        ("gateway.identity", or_else("gateway_id", "UNAVAILABLE"), by_hands),
        ("gateway.firmware", or_else("firmware_version", "UNAVAILABLE"), by_hands),
        ("gateway.bootloader", or_else("bootloader_version", "NOT ADVERTISED"), present("bootloader_version")),
        ("gateway.config", or_else("active_config_version", "UNAVAILABLE"), by_hands),
        ("gateway.health", case((healthy, "RECEIVED"), otherwise="NOT RECEIVED"), present("observed_at")),
        ("gateway.health-arrival", or_else("health_arrived_at", "UNAVAILABLE"), present("health_arrived_at")),
        ("gateway.supply", or_else(millivolt_text(F.col("supply_millivolts")), "UNAVAILABLE"), present("supply_millivolts")),
        ("gateway.motion", or_else("vehicle_motion", "UNKNOWN"), motion),
        ("gateway.capture", case((~healthy, "UNKNOWN"), ("capture_active", "ACTIVE"), otherwise="IDLE"), case((~healthy, "WAIT"), ("capture_active", "ACTIVE"), otherwise="PASS")),
        ("gateway.listen-only", case((listen_only(), "ENFORCED"), otherwise="NOT VERIFIED"), case((~hands | ~healthy, "WAIT"), (listen_only(), "PASS"), otherwise="BLOCKED")),
        ("gateway.storage", or_else(byte_text(F.col("storage_free_bytes")), "UNAVAILABLE"), case((F.col("storage_free_bytes").isNull(), "WAIT"), (F.col("storage_free_bytes") > 0, "PASS"), otherwise="CHECK")),
        counter("gateway.received", "received_frames", "WAIT", "PASS"),
        ("gateway.dropped", or_else("dropped_frames", "UNAVAILABLE"), counter_level(F.col("dropped_frames"))),
        ("gateway.errors", or_else("bus_errors", "UNAVAILABLE"), counter_level(F.col("bus_errors"))),
        counter("gateway.bus-off", "bus_off", "PASS", "BLOCKED"),
    ]


def obd_table() -> list[tuple[str, Column, Column]]:
    traffic = F.col("received_frames") > 0
    return [
        ("obd.power", or_else(millivolt_text(F.col("supply_millivolts")), "UNVERIFIED"), present("supply_millivolts")),
        ("obd.traffic", case((traffic, "OBSERVED"), otherwise="NOT OBSERVED"), case((traffic, "PASS"), otherwise="WAIT")),
        ("obd.network", or_else("network_protocol", "NOT CONFIRMED"), present("network_protocol")),
        ("obd.diagnostic", or_else("obd_protocol", "NOT CONFIRMED"), case((F.col("obd_protocol").isNotNull(), "PASS"), (F.col("network_protocol").isNull(), "WAIT"), otherwise="CHECK")),
        ("obd.latest", or_else("latest_outcome", "NOT TESTED"), outcome_level(F.col("latest_outcome"))),
    ]


def safety_table() -> list[tuple[str, Column, Column]]:
    healthy, connected, queued = F.col("observed_at").isNotNull(), F.col("state") == CONNECTED, F.col("chunks_pending") > 0
    pending = all_of("peripheral_connected", awaiting_result())
    gate = lambda met: case((met, "PASS"), otherwise="BLOCKED")
    return [
        ("safety.contract", case((connected, "CONNECTED"), otherwise="REQUIRED"), gate(connected)),
        ("safety.health", case((healthy, "AVAILABLE"), otherwise="REQUIRED"), gate(healthy)),
        ("safety.parked", or_else("vehicle_motion", "UNKNOWN"), gate(parked())),
        ("safety.capture", case((~healthy, "UNKNOWN"), ("capture_active", "ACTIVE"), otherwise="IDLE"), gate(healthy & idle())),
        ("safety.listen-only", case((listen_only(), "ENFORCED"), otherwise="REQUIRED"), gate(listen_only())),
        ("safety.command-queue", case((queued, F.concat(F.col("chunks_pending").cast("string"), F.lit(" PENDING"))), otherwise="IDLE"), case((queued, "ACTIVE"), otherwise="PASS")),
        ("safety.signing", case(("signing_key", "READY"), otherwise="ON FIRST APPROVAL"), case(("signing_key", "PASS"), otherwise="WAIT")),
        ("safety.approval", F.lit("REQUIRED PER RUN"), F.lit("CHECK")),
        ("safety.pending", case((pending, "AWAITING RESULT"), (awaiting_result(), "INTERRUPTED"), otherwise="IDLE"), case((pending, "ACTIVE"), (awaiting_result(), "BLOCKED"), otherwise="PASS")),
    ]


def firmware_table() -> list[tuple[str, Column, Column]]:
    both = F.col("handshake_version").isNotNull() & F.col("observed_at").isNotNull()
    chosen, may = F.col("package_version").isNotNull(), preflight_error().isNull()
    return [
        ("firmware.key", case(("release_key", "READY"), otherwise="REQUIRED"), case(("release_key", "PASS"), otherwise="WAIT")),
        ("firmware.package", or_else("package_version", "NOT SELECTED"), present("package_version")),
        ("firmware.endpoint", case((F.col("ota_upload_url").isNotNull(), "ADVERTISED"), otherwise="NOT ADVERTISED"), present("ota_upload_url")),
        ("firmware.preflight", case((~chosen, "WAITING"), (both & may, "PASS"), otherwise="BLOCKED"), case((~chosen, "WAIT"), (both & may, "PASS"), otherwise="BLOCKED")),
        ("firmware.update", case(("update_in_progress", "UPLOADING"), otherwise="IDLE"), case(("update_in_progress", "ACTIVE"), otherwise="PASS")),
        ("firmware.post", case((F.col("ota_status_at").isNotNull(), "STATUS RECEIVED"), otherwise="NO STATUS"), present("ota_status_at")),
        ("firmware.context", case((both, "AVAILABLE"), otherwise="INCOMPLETE"), case((both, "PASS"), otherwise="WAIT")),
    ]


def evidence_table() -> list[tuple[str, Column, Column]]:
    none, both = F.col("latest_outcome").isNull(), F.col("handshake_version").isNotNull() & F.col("observed_at").isNotNull()
    level = case((none, "WAIT"), (evidence_complete(), "PASS"), otherwise="BLOCKED")
    return [
        ("evidence.results", or_else("result_count", "0"), case((F.col("result_count") > 0, "PASS"), otherwise="WAIT")),
        ("evidence.references", case((none, "UNAVAILABLE"), otherwise=F.concat(F.coalesce(F.size("evidence_refs"), F.lit(0)).cast("string"), F.lit(" REFERENCES"))), level),
        ("evidence.manifest", case((none, "UNAVAILABLE"), (evidence_complete(), "CHECKSUM PRESENT"), otherwise="INCOMPLETE"), level),
        ("evidence.export", case((both, "READY"), otherwise="BLOCKED"), case((both, "PASS"), otherwise="BLOCKED")),
        ("evidence.authority", F.lit("ENFORCED"), F.lit("PASS")),
    ]


def indicators(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., indicator, value, level): all status tables, one pass over the state and no join."""
    rows = [*summary_cards(), *transport_table(), *gateway_table(), *obd_table(), *safety_table(), *firmware_table(), *evidence_table()]
    each = F.array(*(F.struct(F.lit(name).alias("indicator"), value.alias("value"), level.alias("level")) for name, value, level in rows))
    return df.select(*keep, F.explode(each).alias("i")).select(*keep, "i.*").unionByName(capability_rows(df, *keep))


def is_local_upload(url: Column) -> Column:
    """Whether an upload address is plain HTTP to the update path of a private IPv4 or a local name."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    right = (F.try_parse_url(url, F.lit("PROTOCOL")) == "http") & (F.try_parse_url(url, F.lit("PATH")) == "/upload/ota.bin") & host.isNotNull()
    parts = F.transform(F.split(host, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")))
    at = lambda i: F.get(parts, F.lit(i))
    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") & F.forall(parts, lambda p: yes(p.between(0, 255)))
    private = (at(0) == 10) | ((at(0) == 172) & at(1).between(16, 31)) | ((at(0) == 192) & (at(1) == 168))
    return yes(right & ((host == "localhost") | host.endswith(".local") | (address & private)))


def advertises(services: Column, name: Column, wanted: list[str], name_parts: list[str]) -> Column:
    """Whether an advertisement lists one of the services, or its name holds one of the parts."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    return yes(F.arrays_overlap(services, F.array(*map(F.lit, wanted)))) | reduce(lambda a, b: a | b, (F.contains(lower, F.lit(p)) for p in name_parts))


def advertisement_log(df: DataFrame, key: str, order: list[str], supported: str, every: int = 25) -> DataFrame:
    """Advertisements with their number in the scan; those that are logged: supported ones and each 25th."""
    from pyspark.sql import Window

    numbered = df.withColumn("observation_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where(F.col(supported) | (F.col("observation_no") % every == 0))


def chip_matches(chip: Column, family: Column) -> Column:
    """The S3 family by its whole name; any other only by chips that are of no S family."""
    upper = F.upper(chip)
    return yes(F.when(family == "ESP32-S3", upper.contains("ESP32-S3")).otherwise(upper.contains("ESP32") & ~upper.contains("ESP32-S")))


def install_ready() -> Column:
    return all_of(F.col("stage") == "ready", "chip_matches", "backup_complete", "hardware_confirmed", "release_verified")
