"""Decoding of raw observations to signal samples, and digests over ordered rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.binary import be_unsigned, signed
from loomtrace.functions.canonical import canonical_json
from loomtrace.functions.ids import deterministic_id, id_timestamp_ms


def powertrain_signals(payload: Column) -> list[tuple[str, Column, str]]:
    """(signal, value, unit) of the eight-byte state, in order of output. Fixed values of the decoder: names, units and factors."""
    return [
        ("sim.engine.rpm", be_unsigned(payload, 0, 2) / 4.0, "rpm"),
        ("sim.vehicle.speed", be_unsigned(payload, 2, 2) / 10.0, "km/h"),
        ("sim.engine.coolant-temp", signed(be_unsigned(payload, 4, 2), 16) / 10.0, "Cel"),
        ("sim.electrical.system-voltage", be_unsigned(payload, 6, 2) / 1000.0, "V"),
    ]


#: Decoders by source kind and channel: (payload column to signals, bytes of a payload, decoder id).
DECODERS: dict[tuple[str, str], tuple[Callable, int, str]] = {("SIMULATOR", "sim.powertrain.v1"): (powertrain_signals, 8, "sim.powertrain-state-v1")}


def undecodable(observations: DataFrame) -> DataFrame:
    """Observations without a decoder, or with a payload of another length than it needs."""
    known = F.lit(False)
    for (kind, channel), (_, size, _) in DECODERS.items():
        known |= (F.col("source.kind") == kind) & (F.col("source.channel") == channel) & (F.octet_length(F.unhex("payload.data")) == size)
    return observations.where(~F.coalesce(known, F.lit(False)))


def decode(observations: DataFrame) -> DataFrame:
    """Signal samples, four for each powertrain observation, with `signal_ordinal` for their order."""
    out = None
    for (kind, channel), (signals, size, decoder) in DECODERS.items():
        rows = observations.where((F.col("source.kind") == kind) & (F.col("source.channel") == channel) & (F.octet_length(F.unhex("payload.data")) == size))
        each = F.array(*(F.struct(F.lit(i).alias("signal_ordinal"), F.lit(s).alias("signal_id"), v.cast("double").alias("value"), F.lit(u).alias("unit")) for i, (s, v, u) in enumerate(signals(F.unhex("payload.data")))))
        samples = rows.withColumn("signal", F.explode(each)).select(
            F.lit("signal.sample").alias("contract"),
            F.lit("1.0.0").alias("contract_version"),
            deterministic_id("sample", F.concat_ws(":", "observation_id", "signal.signal_id"), id_timestamp_ms(F.col("observation_id"))).alias("sample_id"),
            "vehicle_id",
            "observation_id",
            "signal.signal_id",
            "signal.value",
            "signal.unit",
            "observed_at_monotonic_us",
            "wall_time",
            "quality",
            F.struct(F.lit(kind).alias("kind"), F.lit(decoder).alias("decoder_id")).alias("source"),
            F.struct(F.lit("1.0.0").alias("decoder")).alias("versions"),
            "capture_id",
            "sequence",
            "signal.signal_ordinal",
        )
        out = samples if out is None else out.unionByName(samples)
    return out


def ordered_digest(df: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """By key the SHA-256 of its lines in order, each ended by a line feed, and their number; null lines are counted only."""
    return running_digest(df, key, order, F.concat(line.cast("string").cast("binary"), F.lit(b"\n")))


def running_digest(df: DataFrame, key: str, order: list[str], data: Column) -> DataFrame:
    """By key the SHA-256 of its bytes in order, and the number of rows; null ones are counted only.

    Rows stream through the tasks sorted by key and order, into a running hash: none are gathered. A hash
    can't be worked out in parts, so a key is one task's work, but no task's memory.
    """
    rows = df.select(F.col(key).alias("key"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), data.alias("line"))
    columns = ["key", *(f"o{i}" for i in range(len(order))), "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, hashed, records, last = [], None, 0, None
        for b in batches:
            keys, lines = b.column("key").to_pylist(), b.column("line").to_pylist()
            for k, own in groupby(range(len(keys)), keys.__getitem__):
                if hashed is None or k != last:
                    if hashed is not None:
                        done.append((last, hashed.hexdigest(), records))
                    hashed, records, last = hashlib.sha256(), 0, k
                for i in own:
                    records += 1
                    if lines[i] is not None:
                        hashed.update(lines[i])
            kind = b.schema.field("key").type
            if done:
                yield digests(done, kind)
                done = []
        if hashed is not None:
            yield digests([(last, hashed.hexdigest(), records)], kind)

    # By a hash of the key: a shuffle by the key itself is left out above a join on it, which may then be planned anew without one.
    spread = rows.repartition(F.xxhash64("key")).sortWithinPartitions(*columns).select("key", "line")
    return spread.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest string, records long").select(F.col("key").alias(key), "digest", "records")


def digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "digest", "records"])


def replay(observations: DataFrame) -> DataFrame:
    """By capture: observations, samples, their distinct signals in order, and the digest of the canonical samples."""
    samples = decode(observations)
    plain = samples.drop("capture_id", "sequence", "signal_ordinal")
    digest = ordered_digest(samples, "capture_id", ["sequence", "signal_ordinal"], canonical_json(plain))
    signals = samples.groupBy("capture_id").agg(F.countDistinct("observation_id").alias("observations"), F.sort_array(F.collect_set("signal_id")).alias("signal_ids"))
    return digest.join(signals, "capture_id").select("capture_id", "observations", F.col("records").alias("signal_samples"), "signal_ids", F.col("digest").alias("semantic_digest"))
