"""Captures through the data source: round trips, splits, pruning, and writes that fail."""

import io
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.sources import bundles, capture_format, scenario


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("c") / "capture")
    capture_format.save_capture(scenario.cold_start(spark), folder, segment_rows=6)
    return folder


def test_round_trip(spark, capture):
    manifest, rows = bundles.load_bundle(spark, capture)  # every check of the other reader
    assert len(manifest["segments"]) > 1 and manifest["semantic_digest"] == "04be681019222236d75410d33fcd240d318d862bd3770b6f44f7c5c6781ce887"
    want = sorted(map(str, rows.drop("segment_no", "segment", "line_no", "position").collect()))
    for split in (100, 1000, 1 << 20):
        got = spark.read.format("capture").option("split_bytes", split).load(capture)
        assert sorted(map(str, got.drop("segment_no", "segment", "at").collect())) == want


def test_columns_and_filters(spark, capture):
    rows = spark.read.format("capture").schema("segment_no int, at long, sequence long, payload struct<data: string>").load(capture)
    got = rows.where("segment_no = 1").orderBy("at").collect()
    first = json.loads(open(f"{capture}/observations-00001.ndjson").readline())
    assert got[0].at == 0 and (got[0].sequence, got[0].payload.data) == (first["sequence"], first["payload"]["data"])
    assert len(got) < rows.count() == 17  # a filter holds for its own query only
    one = spark.read.format("capture").option("segments", "1").schema(rows.schema).load(capture)
    assert one.rdd.getNumPartitions() == 1 < rows.rdd.getNumPartitions() and sorted(one.collect()) == sorted(got)
    assert spark.read.format("capture").option("segments", "90").load(capture).count() == 0
    assert spark.read.format("capture").schema("at long").load(capture).count() == 17


@pytest.mark.parametrize("split", [1, 2, 3, 5, 7, 100])
@pytest.mark.parametrize("data", [b"", b"a", b"a\n", b"\n", b"\n\n", b"ab\n\ncde\nf", b"abcdefgh\ni\n", b"a\nb\nc\n"])
def test_splits(data, split, monkeypatch):
    for piece in (1, 2, 64):
        monkeypatch.setattr(capture_format, "PIECE", piece)
        found = []
        for start in range(0, len(data), split):
            for at, lines in capture_format.lines_from(pa.PythonFile(io.BytesIO(data), "r"), start, min(start + split, len(data)), len(data)):
                assert data[at : at + len(lines)] == lines
                found += [(at + s) for s in capture_format.starts_of(lines)]
        want, at = [], 0
        for line in data.splitlines(keepends=True):
            want.append(at)
            at += len(line)
        assert found == want


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = capture_format.captured(scenario.cold_start(spark)).repartitionByRange(3, "sequence").sortWithinPartitions("sequence")
    capture_format.register(spark)
    for bad in (rows.withColumn("line", F.when(F.col("sequence") == 12, F.raise_error(F.lit("lost"))).otherwise(F.col("line"))), rows.repartition(3), rows.where("false"), rows.withColumn("capture_id", F.concat("capture_id", F.col("sequence") % 2))):
        with pytest.raises(Exception, match="lost|in order|overlap|no observation|one capture"):
            bad.write.format("capture").mode("append").option("semantic_digest", "").save(str(tmp_path / "new"))
        assert os.listdir(tmp_path) == []


def test_existing(spark, capture, tmp_path):
    with pytest.raises(Exception, match="there already"):
        capture_format.save_capture(scenario.cold_start(spark), capture)
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "note").write_text("x")
    with pytest.raises(Exception, match="no bundle of the simulator"):
        capture_format.save_capture(scenario.cold_start(spark), str(tmp_path / "mine"), replace=True)
    assert os.listdir(tmp_path / "mine") == ["note"]
    for _ in range(2):
        capture_format.save_capture(scenario.cold_start(spark), str(tmp_path / "own"), replace=True)
    assert spark.read.format("capture").load(str(tmp_path / "own")).count() == 17


def test_damage(spark, tmp_path):
    folder = tmp_path / "c"
    capture_format.save_capture(scenario.cold_start(spark), str(folder))
    data = (folder / "observations.ndjson").read_bytes()
    read = lambda: spark.read.format("capture").load(str(folder)).count()
    (folder / "observations.ndjson").write_bytes(data.replace(b"GOOD", b"BAD_"))
    with pytest.raises(Exception, match="has the hash"):
        read()
    (folder / "observations.ndjson").write_bytes(data.replace(b"\n{", b"\n ", 1))
    with pytest.raises(Exception, match="lines from byte 0 on"):
        read()
    (folder / "observations.ndjson").write_bytes(data[:-1])
    with pytest.raises(Exception, match="bytes, the manifest says"):
        read()
    (folder / "manifest.json").unlink()
    with pytest.raises(Exception, match="has no manifest.json"):
        read()
