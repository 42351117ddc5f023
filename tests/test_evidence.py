"""Gates, packages, layouts and lineage where the driver's tables do not reach: odd values, other encodings, cycles."""

import json

from pyspark.sql import functions as F

from loomtrace.functions import ids, layouts, protobuf
from loomtrace.operators import contracts, gateway, lineage
from loomtrace.sources import packages, scenario


def test_lineage_chains_cycles_and_names(spark):
    runs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "calculation_id long, recalculation_of long")
    assert {r.id: (r.root, r.depth) for r in lineage.recalculation_roots(runs).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (None, None), 6: (None, None)}
    assert lineage.with_json_names(spark.range(1).select(F.lit(1).alias("manifestSHA256"), F.lit(2).alias("firmwareBuildId"))).columns == ["manifest_sha256", "firmware_build_id"]
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    assert lineage.look_up(table, "k", "a") == {"k": "a", "v": 1} and lineage.look_up(table, "k", "b") is None


def test_floats_and_bits(spark):
    import struct

    data = struct.pack(">fd", -118.625, 5e-324) + struct.pack("<f", float("inf")) + struct.pack("<q", -3)
    df = spark.createDataFrame([(data,), (data[:5],)], "p binary")
    at = lambda **x: layouts.raw_value(F.col("p"), x)
    got = df.select(
        at(encoding="IEEE754", byte_offset=0, byte_length=4, endianness="BIG", signed=True),
        at(encoding="IEEE754", byte_offset=4, byte_length=8, endianness="BIG", signed=True),
        at(encoding="IEEE754", byte_offset=12, byte_length=4, endianness="LITTLE", signed=True),
        at(encoding="INTEGER", byte_offset=16, byte_length=8, endianness="LITTLE", signed=True),
        at(encoding="BIT_FIELD", byte_offset=16, byte_length=8, endianness="LITTLE", signed=True, bit_offset=60, bit_length=4),
    ).collect()
    assert tuple(got[0]) == (-118.625, 5e-324, None, -3.0, -1.0) and tuple(got[1]) == (-118.625, None, None, None, None)


def test_protobuf_messages(spark):
    rows = [(1, bytes.fromhex("0a02677710ffffffffffffffffff015801")), (2, None), (3, b"\x80"), (4, bytes.fromhex("0801")), (5, b"")]
    out = {r.id: r for r in protobuf.decoded(spark.createDataFrame(rows, "id long, payload binary"), "gateway_health").collect()}
    assert (out[1].gateway_id, int(out[1].uptime_ms), out[1].listen_only, out[1].error) == ("gw", 2**64 - 1, True, None)
    assert (out[5].gateway_id, int(out[5].received_frames), out[5].error) == ("", 0, None)
    assert out[2].error == "no payload" and out[3].error == "bad varint" and "gateway_id" in out[4].error


def test_ids_and_readiness(spark):
    a, b = spark.range(2).select(ids.new_id("obs").alias("i")).collect()
    ok = spark.createDataFrame([a, b]).select(ids.is_domain_id(F.col("i"), "obs").alias("ok")).collect()
    assert a.i != b.i and all(r.ok for r in ok)
    df = spark.createDataFrame([("ready", True, True, True, True), ("ready", True, None, True, True)], "stage string, chip_matches boolean, backup_complete boolean, hardware_confirmed boolean, release_verified boolean")
    assert [r[0] for r in df.select(gateway.install_ready()).collect()] == [True, False]
    sizes = spark.createDataFrame([(4, 4), (4, 5), (None, 4)], "a long, b long")
    assert [r[0] for r in sizes.select(packages.recovery_fits(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_package_round_trip_and_digest(spark, tmp_path):
    import hashlib

    manifest, image = b'{"a":1}', b"image"
    row = spark.createDataFrame([(manifest, image)], "m binary, f binary").select(packages.encoded(F.col("m"), F.col("f"), F.lit(b"sig")).alias("content"), packages.signing_digest(F.col("m"), F.col("f")).alias("d")).first()
    assert bytes(row.content) == b"VHUP\x00\x01\x00\x00\x00\x07\x00\x00\x00\x05\x00\x03" + manifest + image + b"sig"
    assert row.d == hashlib.sha256(manifest + image).hexdigest()
    (tmp_path / "x.bin").write_bytes(bytes(row.content))
    back = packages.decoded(packages.read_files(spark, str(tmp_path))).withColumn("error", packages.package_error()).first()
    assert bytes(back.firmware) == image and back.error == "manifest_unreadable"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "release.json").write_text(json.dumps({"schemaVersion": "1.0.0", "chipFamily": "ESP32", "segments": [{"label": "a", "address": 1, "byteCount": 2}]}))
    assert packages.read_release(spark, str(tmp_path / "r")).select(packages.release_error("ESP32").alias("e")).first().e is None


def test_contract_texts_and_observations(spark):
    docs = spark.createDataFrame([(1, "{bad"), (2, "[1]"), (3, None), (4, '{"contract": 5}')], "id int, j string")
    got = {r.id: r.errors for r in contracts.error_text(contracts.contract_errors(docs, "j", "id"), "id").collect()}
    assert got == {1: "<root>: json", 2: "contract: contract", 3: "<root>: json", 4: "contract: contract"}
    rows = scenario.cold_start(spark)
    frame = rows.withColumn("source", F.col("source").withField("kind", F.lit("CAN_FRAME"))).select("sequence", F.to_json(F.struct(*rows.columns)).alias("j"))
    rules = {r.rule for r in contracts.contract_errors(frame, "j", "sequence", only=("raw.observation",)).collect()}
    assert rules == {"required:arbitration_id", "required:bus_index", "required:extended_id"}
