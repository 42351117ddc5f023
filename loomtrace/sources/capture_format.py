"""Captures as a data source: `spark.read.format("capture")` and `df.write.format("capture")`.

The manifest lists the segments. Reading has a task for each `split_bytes` of a segment, whatever its size;
the option `segments` ("0,3") leaves out all others, and of a line only the columns of the schema are parsed, so a
reader names the ones it needs: `.schema("sequence long, quality string")`. Filters are not pushed into the source:
Spark 4.1 keeps a pushed filter with the relation, and another query over the same DataFrame would lose rows. Writing has a segment for each task;
the manifest is made, and the capture moved to its place, when all tasks are done, and not at all if one fails.

Files are reached through Arrow's file systems, by path or URI. The source reads what the manifest lists and compares sizes,
lines and, of a segment read by one task, the hash; `bundles.load_bundle` is the way to have every check done.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.json
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtrace.functions.canonical import canonical_json
from loomtrace.functions.schemas import RAW_OBSERVATION
from loomtrace.operators.replay import ordered_digest
from loomtrace.operators.rules import raw_observation_rules, violations
from loomtrace.sources.bundles import SEGMENT_ROWS, SIMULATOR, BundleError
from loomtrace.sources.scratch import dropped, saved

#: Where a row comes from: its segment's number and name, and the byte its line begins at, which orders a segment's rows.
PLACE = "segment_no int, segment string, at long"
#: What a writing task takes of each row, in order of sequence.
WRITTEN = ("sequence", "observed_at_monotonic_us", "wall_time", "capture_id", "vehicle_id", "line")
#: Bytes read at once, and bytes of a reading task unless the reader says otherwise.
PIECE, SPLIT = 4 << 20, 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    segment_no: int
    segment: str
    start: int
    end: int
    size: int
    sha256: str


def lines_from(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(at, whole lines) of the lines that begin in [start, end), some PIECE bytes at a time; a last line needs no end."""
    at, rest = start, b""
    if start:
        # A line that began before belongs to the split before.
        file.seek(at := start - 1)
        while (got := file.read(PIECE)) and b"\n" not in got:
            at += len(got)
        skipped = got.find(b"\n") + 1
        at, rest = at + skipped, got[skipped:]
        if not got or at >= end:
            return
    while True:
        limit = end - at  # lines that begin at this byte of rest, or later, are another split's
        last = rest.rfind(b"\n", 0, len(rest)) + 1
        if last >= limit:
            last = rest.find(b"\n", limit - 1) + 1
            yield at, rest[:last]
            return
        if last:
            yield at, rest[:last]
            at, rest = at + last, rest[last:]
        got = file.read(PIECE)
        if not got:
            if rest:
                yield at, rest
            return
        rest += got


def starts_of(data: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)]]).astype(np.int64)


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, split_bytes: int, chosen: set[int] | None):
        self.folder, self.schema, self.split_bytes, self.chosen = folder, schema, split_bytes, chosen

    def partitions(self) -> list[Split]:
        files, root = opened(self.folder)
        try:
            with files.open_input_stream(f"{root}/manifest.json") as f:
                manifest = json.loads(f.read())
        except FileNotFoundError as e:
            raise BundleError("no_manifest", f"{self.folder} has no manifest.json") from e
        splits = []
        for i, s in enumerate(manifest["segments"]):
            name = posixpath.normpath(s["path"])
            if name.startswith(("..", "/")):
                raise BundleError("segment_outside", f"{s['path']} lies outside the bundle")
            info = files.get_file_info(f"{root}/{name}")
            if info.type != fs.FileType.File:
                raise BundleError("segment_missing", f"{s['path']} is not in the bundle")
            if info.size != s["byte_count"]:
                raise BundleError("segment_bytes", f"{s['path']} has {info.size} bytes, the manifest says {s['byte_count']}")
            if self.chosen is None or i in self.chosen:
                splits += [Split(i, s["path"], a, min(a + self.split_bytes, info.size), info.size, s["sha256"]) for a in range(0, info.size, self.split_bytes)]
        return splits or [Split(-1, "", 0, 0, 0, "")]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.segment_no < 0:
            return
        files, root = opened(self.folder)
        wanted = to_arrow_schema(self.schema)
        parsed = pa.schema([f for f in wanted if f.name not in ("segment_no", "segment", "at")])
        how = pa.json.ParseOptions(explicit_schema=parsed, unexpected_field_behavior="ignore")
        whole = hashlib.sha256() if split.start == 0 and split.end == split.size else None
        with files.open_input_file(f"{root}/{posixpath.normpath(split.segment)}") as file:
            for at, data in lines_from(file, split.start, split.end, split.size):
                if whole:
                    whole.update(data)
                starts = starts_of(data)
                place = {"segment_no": lambda n: pa.array(np.full(n, split.segment_no, np.int32)), "segment": lambda n: pa.array([split.segment] * n, pa.string()), "at": lambda _, at=at, starts=starts: pa.array(starts + at)}
                rows = None
                if len(parsed):
                    try:
                        rows = pa.json.read_json(pa.BufferReader(data), read_options=pa.json.ReadOptions(use_threads=False, block_size=len(data) + 1), parse_options=how).combine_chunks()
                    except pa.ArrowInvalid as e:
                        raise BundleError("observation", f"{split.segment}, lines from byte {at} on: {e}") from e
                    if rows.num_rows != len(starts):
                        raise BundleError("observation", f"{split.segment}, lines from byte {at} on: {len(starts)} lines hold {rows.num_rows} documents")
                columns = [place[f.name](len(starts)) if f.name in place else rows[f.name] for f in wanted]
                yield from pa.table(columns, schema=wanted).to_batches(max_chunksize=10_000)
        if whole and whole.hexdigest() != split.sha256:
            raise BundleError("segment_hash", f"{split.segment} has the hash {whole.hexdigest()}, the manifest says {split.sha256}")


@dataclass
class Segment(WriterCommitMessage):
    """What a task wrote: file, hash, bytes, rows, and its first and last row."""

    name: str
    sha256: str
    byte_count: int
    record_count: int
    first: dict
    last: dict


class CaptureWriter(DataSourceArrowWriter):
    """Tasks write into a folder beside the capture's; commit names the files that count and moves them into place."""

    def __init__(self, folder: str, about: dict, digest: str, overwrite: bool):
        self.folder, self.about, self.digest = folder, about, digest
        files, root = opened(folder)
        self.part = f"{root}.writing-{uuid.uuid4().hex}"
        if files.get_file_info(root).type != fs.FileType.NotFound:
            if not overwrite:
                raise BundleError("exists", f"{folder} is there already")
            try:
                with files.open_input_stream(f"{root}/manifest.json") as f:
                    simulated = json.loads(f.read())["source"]["kind"] == "SIMULATOR"
            except (OSError, ValueError, KeyError, TypeError):
                simulated = False
            if not simulated:
                raise BundleError("not_replaceable", f"{folder} holds no bundle of the simulator")
        # Made here and by no task, so that a task which outlives a failed job can't bring it back.
        files.create_dir(f"{self.part}/bundle", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Segment:
        files, _ = opened(self.folder)
        name = f"task-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        hashed, size, rows, first, last = hashlib.sha256(), 0, 0, None, None
        with files.open_output_stream(f"{self.part}/{name}") as out:
            for b in batches:
                if not b.num_rows:
                    continue
                sequence = b.column("sequence").to_numpy()
                if (np.diff(sequence) <= 0).any() or last is not None and sequence[0] <= last["sequence"]:
                    raise BundleError("sequence", "rows of a segment are not in order of sequence")
                if len(b.column("capture_id").unique()) > 1 or len(b.column("vehicle_id").unique()) > 1:
                    raise BundleError("several_captures", "a bundle holds one capture of one vehicle")
                data = "".join(f"{x}\n" for x in b.column("line").to_pylist()).encode()
                out.write(data)
                hashed.update(data)
                ends = b.select([c for c in WRITTEN if c != "line"])
                first, last = first or ends.slice(0, 1).to_pylist()[0], ends.slice(b.num_rows - 1, 1).to_pylist()[0]
                size, rows = size + len(data), rows + b.num_rows
        return Segment(name, hashed.hexdigest(), size, rows, first, last)

    def commit(self, messages: list[Segment | None]) -> None:
        try:
            self.publish(messages)
        except BaseException:
            self.abort(messages)
            raise

    def publish(self, messages: list[Segment | None]) -> None:
        files, root = opened(self.folder)
        done = sorted((m for m in messages if m and m.record_count), key=lambda m: m.first["sequence"])
        if not done:
            raise BundleError("empty", "there is no observation to write")
        if len({(e["capture_id"], e["vehicle_id"]) for m in done for e in (m.first, m.last)}) > 1:
            raise BundleError("several_captures", "a bundle holds one capture of one vehicle")
        if any(a.last["sequence"] >= b.first["sequence"] for a, b in zip(done, done[1:], strict=False)):
            raise BundleError("sequence", "segments overlap: rows must be partitioned by ranges of their sequence")
        segments = []
        for i, m in enumerate(done):
            name = "observations.ndjson" if len(done) == 1 else f"observations-{i:05d}.ndjson"
            files.move(f"{self.part}/{m.name}", f"{self.part}/bundle/{name}")
            segments.append({"path": name, "media_type": "application/x-ndjson", "schema": "raw.observation@1.0.0", "sha256": m.sha256, "byte_count": m.byte_count, "record_count": m.record_count})
        a, z = done[0].first, done[-1].last
        manifest = {
            "contract": "capture.bundle.manifest", "contract_version": "1.0.0", "capture_id": a["capture_id"], "vehicle_id": a["vehicle_id"], "created_at": a["wall_time"],
            "capture_window": {"start_monotonic_us": a["observed_at_monotonic_us"], "end_monotonic_us": z["observed_at_monotonic_us"], "start_wall_time": a["wall_time"], "end_wall_time": z["wall_time"]},
            **self.about, "segments": segments, "semantic_digest": self.digest,
            "statistics": {"received_records": sum(m.record_count for m in done), "dropped_records": 0, "sequence_gaps": 0, "crc_failures": 0, "transport_reconnects": 0},
            "versions": {"raw_observation_contract": "1.0.0"},
        }
        with files.open_output_stream(f"{self.part}/bundle/manifest.json") as out:
            out.write((json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode())
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)
        files.move(f"{self.part}/bundle", root)
        files.delete_dir(self.part)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.folder)
        if files.get_file_info(self.part).type != fs.FileType.NotFound:
            files.delete_dir(self.part)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return f"{PLACE}, {RAW_OBSERVATION}"

    def reader(self, schema: StructType) -> CaptureReader:
        chosen = self.options.get("segments")
        return CaptureReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT)), None if chosen is None else {int(n) for n in chosen.split(",") if n.strip()})

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        if missing := [c for c in (*WRITTEN,) if c not in schema.fieldNames()]:
            raise BundleError("columns", f"rows to write lack {', '.join(missing)}; see captured()")
        about = json.loads(self.options["about"]) if "about" in self.options else SIMULATOR
        return CaptureWriter(self.options["path"], {k: v for k, v in about.items() if k in ("profile", "source", "labels")}, self.options["semantic_digest"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CaptureSource)


def captured(observations: DataFrame) -> DataFrame:
    """Observations as the rows that are written: their canonical line and what the manifest says of them."""
    return observations.select(*WRITTEN[:-1], canonical_json(observations).alias("line"))


def save_capture(observations: DataFrame, folder: str, replace: bool = False, about: dict | None = None, segment_rows: int = SEGMENT_ROWS) -> None:
    """Write one capture through the format: checked, its digest worked out over a sorted stream, a segment for some `segment_rows` rows."""
    spark = observations.sparkSession
    register(spark)
    if (bad := violations(observations, raw_observation_rules(), "sequence").orderBy("sequence", "check_order").select("message").take(1)):
        raise BundleError("observation", bad[0]["message"])
    rows = saved(captured(observations), "capture")
    digest = ordered_digest(rows.select(F.lit(0).alias("capture"), "sequence", "line"), "capture", ["sequence"], F.col("line")).first()
    parts = max(1, -(-(digest["records"] if digest else 0) // segment_rows))
    dealt = rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, "sequence")
    out = dealt.sortWithinPartitions("sequence").write.format("capture").mode("overwrite" if replace else "append").option("semantic_digest", digest["digest"] if digest else "")
    (out.option("about", json.dumps(about)) if about else out).save(folder)
    dropped(rows)
