"""The scenario from end to end: golden values, round trip, and injected faults."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.canonical import canonical_json
from loomtrace.operators import replay
from loomtrace.sources import bundles, scenario

SEGMENT = "04be681019222236d75410d33fcd240d318d862bd3770b6f44f7c5c6781ce887"
SAMPLES = "0262ebc38dcb357ef1305208744a51c5bf1c2dabb2c4a857ce3af96857939c3a"


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("b") / "capture")
    return folder, bundles.write_bundle(scenario.cold_start(spark), folder)


def test_golden_observations(spark):
    rows = scenario.cold_start(spark).orderBy("sequence").collect()
    assert [r.payload.data for r in rows[:6]] == ["0000000000c83138", "0000000000c83138", "0410000000c82a30", "0410000000c82a30", "12c0000000c836b0", "11fa000000d536bc"]
    assert rows[0].observation_id == "obs_01M05MT900DJ4ZA10KD39AHERG"
    assert rows[16].observation_id == "obs_01M05NNQX0R3ZBM10D39XM106V"
    assert rows[0].vehicle_id == "veh_01M05MT900HNK4N8YRQNRD97EC" and rows[0].capture_id == "capture_01M05MT900WJS1SCTXS7YRM9H0"


def test_golden_bytes(bundle):
    folder, manifest = bundle
    data = open(f"{folder}/observations.ndjson", "rb").read()
    assert len(data) == 9610 and hashlib.sha256(data).hexdigest() == SEGMENT == manifest["semantic_digest"]


def test_round_trip_and_replay(spark, bundle):
    manifest, rows = bundles.load_bundle(spark, bundle[0])
    out = replay.replay(rows.drop("segment_no", "segment", "line_no", "position")).first()
    assert (out.observations, out.signal_samples) == (17, 68)
    assert out.signal_ids == ["sim.electrical.system-voltage", "sim.engine.coolant-temp", "sim.engine.rpm", "sim.vehicle.speed"]
    assert out.semantic_digest == SAMPLES
    assert replay.undecodable(rows).count() == 0 and replay.undecodable(rows.withColumn("source", F.struct(F.lit("CAN_FRAME").alias("kind"), F.lit("x").alias("channel")))).count() == 17


def tampered(bundle, tmp_path, change, rehash=True):
    folder = tmp_path / "capture"
    shutil.copytree(bundle[0], folder)
    lines = [json.loads(x) for x in (folder / "observations.ndjson").read_text().splitlines()]
    change(lines)
    data = "".join(json.dumps(x, sort_keys=True, separators=(",", ":")) + "\n" for x in lines).encode()
    (folder / "observations.ndjson").write_bytes(data)
    (folder / ".observations.ndjson.crc").unlink(missing_ok=True)
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    manifest = json.loads((folder / "manifest.json").read_text())
    if rehash:
        manifest["segments"][0] |= {"sha256": hashlib.sha256(data).hexdigest(), "byte_count": len(data)}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    return str(folder)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda x: x[0]["payload"].update(data="00" * 8), "payload_hash"),
        (lambda x: x[5].update(sequence=42), "sequence 42 comes after 4"),
        (lambda x: x[5].update(observed_at_monotonic_us=x[4]["observed_at_monotonic_us"]), "time: "),
        (lambda x: x[3].update(quality="FINE"), "line 4"),
        (lambda x: x[2]["source"].update(channel="powertrain"), "source.channel: pattern"),
    ],
)
def test_faults(spark, bundle, tmp_path, change, message):
    with pytest.raises(bundles.BundleError, match=message):
        bundles.load_bundle(spark, tampered(bundle, tmp_path, change))


def test_extra_byte_missing_and_escape(spark, bundle, tmp_path):
    folder = tampered(bundle, tmp_path, lambda x: x[0].update(quality="STALE"), rehash=False)
    with pytest.raises(bundles.BundleError, match="segment_bytes"):
        bundles.load_bundle(spark, folder)
    manifest = json.loads(open(f"{folder}/manifest.json").read())
    for path, message in (("../x.ndjson", "manifest"), ("none.ndjson", "segment_missing"), ("a/../../x.ndjson", "segment_outside")):
        manifest["segments"][0]["path"] = path
        open(f"{folder}/manifest.json", "w").write(json.dumps(manifest))
        with pytest.raises(bundles.BundleError, match=message):
            bundles.load_bundle(spark, folder)


def test_unsafe_replace(spark, bundle, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "keep.txt").write_text("x")
    with pytest.raises(bundles.BundleError, match="is there already"):
        bundles.write_bundle(scenario.cold_start(spark), str(other))
    with pytest.raises(bundles.BundleError, match="not_replaceable"):
        bundles.write_bundle(scenario.cold_start(spark), str(other), replace=True)
    assert (other / "keep.txt").read_text() == "x"


def test_canonical_order(spark):
    row = spark.sql("SELECT 1 AS b, named_struct('z', 1, 'a', 'x') AS a, CAST(NULL AS INT) AS c")
    assert row.select(canonical_json(row).alias("j")).first().j == '{"a":{"a":"x","z":1},"b":1}'


def test_two_segments_of_one_name_and_odd_line_ends(spark, bundle, tmp_path):
    folder = tmp_path / "two"
    lines = open(f"{bundle[0]}/observations.ndjson").read().splitlines()
    manifest, first = bundle[1] | {"segments": []}, bundle[1]["segments"][0]
    for name, some, end in (("a", lines[:9], "\r\n"), ("b", lines[9:], "\n")):
        (folder / name).mkdir(parents=True)
        data = end.join(some).encode()  # no end after the last line
        (folder / name / "observations.ndjson").write_bytes(data)
        manifest["segments"].append(first | {"path": f"{name}/observations.ndjson", "sha256": hashlib.sha256(data).hexdigest(), "byte_count": len(data), "record_count": len(some)})
    (folder / "manifest.json").write_text(json.dumps(manifest))
    assert bundles.load_bundle(spark, str(folder))[1].count() == 17
    data += b"\n\n"
    (folder / "b" / "observations.ndjson").write_bytes(data)
    manifest["segments"][1] |= {"sha256": hashlib.sha256(data).hexdigest(), "byte_count": len(data)}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(bundles.BundleError, match="segment_lines"):
        bundles.load_bundle(spark, str(folder))
    for text, n in ((b"", 0), (b"\n", 1), (b"a\rb\r\n\n", 3), (b"a", 1)):
        assert spark.createDataFrame([(text,)], "c binary").select(F.size(bundles.lines_of(F.col("c")))).first()[0] == n


def test_manifest_contract_and_segments(spark, bundle, tmp_path):
    folder = str(tmp_path / "parts")
    about = {"profile": {"kind": "VEHICLE"}, "source": {"kind": "GATEWAY", "source_id": "gw", "source_version": "1.0.0", "hardware_revision": "a", "firmware_build_id": "b", "config_id": "c", "listen_only": True}}
    manifest = bundles.write_bundle(scenario.cold_start(spark), folder, about=about, segment_rows=6)
    assert len(manifest["segments"]) == 3 and sum(s["record_count"] for s in manifest["segments"]) == 17
    assert bundles.bundle_summary(spark, folder).first().observations == 17
    del manifest["source"]["config_id"]
    manifest["extra"] = 1
    open(f"{folder}/manifest.json", "w").write(json.dumps(manifest))
    import os

    if os.path.exists(f"{folder}/.manifest.json.crc"):
        os.remove(f"{folder}/.manifest.json.crc")
    with pytest.raises(bundles.BundleError, match="<root>: additionalProperties; source: required:config_id"):
        bundles.load_bundle(spark, folder)


def test_replay_file(spark, tmp_path):
    samples = replay.decode(scenario.cold_start(spark))
    bundles.write_replay(samples, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 68
    with pytest.raises(bundles.BundleError, match="exists"):
        bundles.write_replay(samples, str(tmp_path / "out"))


def test_one_digest_however_many_segments(spark, tmp_path):
    """The capture's digest is that of its lines, whether they are in one segment or in several."""
    rows = scenario.cold_start(spark)
    one = bundles.write_bundle(rows, f"{tmp_path}/one")
    several = bundles.write_bundle(rows, f"{tmp_path}/several", segment_rows=6)
    assert len(one["segments"]) == 1 and len(several["segments"]) > 2
    assert one["semantic_digest"] == several["semantic_digest"] == SEGMENT
    back = [bundles.load_bundle(spark, f"{tmp_path}/{n}")[1].drop("segment_no", "segment", "line_no") for n in ("one", "several")]
    assert back[0].exceptAll(back[1]).isEmpty() and back[1].exceptAll(back[0]).isEmpty()


def test_digest_streams(spark):
    """Keys over many batches, a null key, null lines and letters beyond ASCII; the plan gathers nothing."""
    lines = [(k, i, None if i % 7 == 3 else f"línea {k} {i}") for k in ("a", "b", None) for i in range(3000 if k == "a" else 5)]
    df = spark.createDataFrame(lines, "k string, i long, line string").repartition(5)
    out = replay.ordered_digest(df, "k", ["i"], F.col("line"))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.digest, r.records) for r in out.collect()}
    for k in ("a", "b", None):
        own = [x for x in lines if x[0] == k]
        assert got[k] == (hashlib.sha256("".join(f"{x[2]}\n" for x in own if x[2] is not None).encode()).hexdigest(), len(own))
    assert replay.ordered_digest(df.limit(0), "k", ["i"], F.col("line")).collect() == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("closed", [True, False])
def test_segments_read_in_splits(spark, tmp_path, end, closed):
    """A segment cut into many splits at any byte, with every line end, in a folder with a space: numbers, lines, bytes and hash are those of the whole."""
    folder = tmp_path / "a b"
    manifest = bundles.write_bundle(scenario.cold_start(spark), f"{folder}")
    file = folder / "observations.ndjson"
    plain = file.read_text().splitlines()
    lines = [x for i in range(8) for x in (*plain, "", f"é {i}")]
    data = (end.join(lines) + (end if closed else "")).encode()
    file.write_bytes(data)
    (folder / ".observations.ndjson.crc").unlink(missing_ok=True)
    manifest["segments"][0] |= {"sha256": hashlib.sha256(data).hexdigest(), "byte_count": len(data), "record_count": len(lines)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        segments = bundles.segment_table(spark, f"{folder}", manifest)
        got = bundles.observation_lines(spark, segments)
        assert spark.read.text(f"{folder}/observations.ndjson").rdd.getNumPartitions() > 8
        assert [(r.line_no, r.position, r.line) for r in got.orderBy("position").collect()] == [(i + 1, i, x) for i, x in enumerate(lines)]
        assert bundles.segment_errors(spark, segments, got).collect() == []
        manifest["segments"][0] |= {"sha256": "0" * 64, "byte_count": 1, "record_count": 2}
        wrong = bundles.segment_errors(spark, bundles.segment_table(spark, f"{folder}", manifest), got).collect()
        assert {r.code for r in wrong} == {"segment_bytes", "segment_hash", "segment_lines"} and hashlib.sha256(data).hexdigest() in next(r.message for r in wrong if r.code == "segment_hash")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_digest_above_a_join(spark):
    """A join on the key below, of which one side turns out small, doesn't spread a key over tasks."""
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), "id", F.concat(F.lit("line "), "id").alias("line")).repartition(6)
    few = rows.groupBy("k").agg(F.max("id").alias("last"))
    out = replay.ordered_digest(rows.join(few, "k").where("id <= last"), "k", ["id"], F.col("line")).collect()
    for r in out:
        assert r.digest == hashlib.sha256("".join(f"line {i}\n" for i in range(r.k, 60_000, 2)).encode()).hexdigest()
    assert {(r.k, r.records) for r in out} == {(0, 30_000), (1, 30_000)} and len(out) == 2
