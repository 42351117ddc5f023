"""Gateway frames: encoding, decoding, and reassembly from a stream of chunks.

A frame is a 36-byte little-endian header and a payload. The four bytes that begin each header name the
gateway's protocol and are the caller's to give. A session whose bytes are wrong stays poisoned: later chunks
fail with the same error, until a new session starts. The error is kept, not the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtrace.functions.binary import crc32c, crc32c_all

#: What begins a frame where the caller names nothing else.
MAGIC = b"LOOM"
#: Fixed values of the wire format.
HEADER, MOST_PAYLOAD, TYPES = 36, 1 << 20, range(1, 11)
HANDSHAKE, HEALTH, OTA_STATUS, EXPERIMENT_RESULT = 1, 4, 8, 10
#: Characteristics of the gateway by what they carry; only these two bring frames.
FRAME_CHANNELS = ("stream", "health")
FRAME = "session_id string, arrival_idx long, frame_no int, message_type int, flags int, sequence decimal(20,0), monotonic_us decimal(20,0), payload binary, error string"


def encode_frame(message_type: int, sequence: int, monotonic_us: int, payload: bytes, flags: int = 0, magic: bytes = MAGIC) -> bytes:
    head = struct.pack("<4sBBBBIQQI", magic, 1, 0, message_type, flags, len(payload), sequence, monotonic_us, crc32c(payload))
    return head + struct.pack("<I", crc32c(head)) + payload


def encoded_frames(rows: DataFrame, *keep: str, magic: bytes = MAGIC) -> DataFrame:
    """Rows of (message_type, sequence, monotonic_us, payload) with `frame`, the bytes on the wire; checksums are worked out a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payloads = [bytes(x) for x in b["payload"]]
            crcs = crc32c_all(payloads).tolist()
            heads = [struct.pack("<4sBBBBIQQI", magic, 1, 0, k, 0, len(p), int(s), int(u), c) for k, s, u, p, c in zip(b["message_type"], b["sequence"], b["monotonic_us"], payloads, crcs, strict=True)]
            ends = [struct.pack("<I", c) for c in crc32c_all(heads).tolist()]
            yield b[list(keep)].assign(frame=[h + e + p for h, e, p in zip(heads, ends, payloads, strict=True)])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    columns = list(dict.fromkeys([*keep, "message_type", "sequence", "monotonic_us", "payload"]))
    return rows.select(*columns).mapInPandas(run, f"{kinds}frame binary")


@dataclass
class Session:
    """What is left of a session's bytes, or the error that poisoned it, and the chunks that came since."""

    buffer: bytes = b""
    failed: str | None = None
    arrivals: list[int] = field(default_factory=list)
    chunks: list[bytes] = field(default_factory=list)


def parsed(data: bytes, magic: bytes) -> tuple[list[tuple], int, tuple[int, str] | None]:
    """(whole frames: start, end and header; bytes they take; where and how the bytes after them are wrong). Checksums are left out."""
    frames, at = [], 0
    while len(data) - at >= HEADER:
        head = struct.unpack_from("<4sBBBBIQQII", data, at)
        if head[0] != magic:
            return frames, at, (at + HEADER, "invalid magic")
        if head[5] > MOST_PAYLOAD:
            return frames, at, (at + HEADER, "payload too large")
        end = at + HEADER + head[5]
        if len(data) < end:
            break
        frames.append((at, end, head))
        at = end
    return frames, at, None


def decoded(sessions: dict[str, Session], magic: bytes) -> pd.DataFrame:
    """The frames and errors of the chunks that came for each session, which are then used up; checksums of all are worked out at once.

    A chunk is one call of a decoder: an error loses the frames that the same chunk completed before it.
    """
    whole = {n: (data := s.buffer + b"".join(s.chunks), *parsed(data, magic)) for n, s in sessions.items() if not s.failed}
    spans = [(data, at, end) for data, frames, _, _ in whole.values() for at, end, _ in frames]
    heads, payloads = crc32c_all([d[at : at + 32] for d, at, _ in spans]).tolist(), crc32c_all([d[at + HEADER : end] for d, at, end in spans]).tolist()
    rows, n = [], 0
    for name, s in sessions.items():
        bad = len(s.chunks) if not s.failed else 0  # number of the first chunk that fails
        if not s.failed:
            data, frames, used, wrong = whole[name]
            ends = np.cumsum([len(s.buffer) + len(s.chunks[0]) if s.chunks else 0, *map(len, s.chunks[1:])])
            number = np.searchsorted(ends, [end for _, end, _ in frames]).tolist()
            good, counts = [], {}
            for (at, end, (_, major, _, kind, flags, _, sequence, us, payload_crc, header_crc)), k, head, payload in zip(frames, number, heads[n:], payloads[n:], strict=False):
                for broken, error in ((major != 1, "unsupported protocol major"), (kind not in TYPES, "unsupported message type"), (head != header_crc, "header CRC mismatch"), (payload != payload_crc, "payload CRC mismatch")):
                    if broken:
                        wrong = (end, error)
                        break
                else:
                    good.append((k, counts.setdefault(k, 0), kind, flags, sequence, us, data[at + HEADER : end]))
                    counts[k] += 1
                    continue
                break
            n += len(frames)
            if wrong:
                bad, s.failed = int(np.searchsorted(ends, wrong[0])), wrong[1]
            s.buffer = b"" if s.failed else data[used:]
            rows += [(name, s.arrivals[k], no, kind, flags, Decimal(sequence), Decimal(us), payload, None) for k, no, kind, flags, sequence, us, payload in good if k < bad]
        rows += [(name, arrival, 0, None, None, None, None, None, s.failed) for arrival in s.arrivals[bad:]]
        s.arrivals, s.chunks = [], []
    return pd.DataFrame(rows, columns=["session_id", "arrival_idx", "frame_no", "message_type", "flags", "sequence", "monotonic_us", "payload", "error"], dtype=object)


def reassemble(chunks: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """Frames of a stream of (session_id, arrival_idx, chunk), and a row with `error` for each chunk that fails.

    State is what is left of a session's bytes, less than one frame, or the error of a poisoned one. A
    trigger's chunks of one session are gathered to be put in order; the trigger's size bounds them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, failed = state.get if state.exists else (b"", None)
        rows = pd.concat(list(batches)).sort_values("arrival_idx")
        session = Session(bytes(buffer), failed, rows["arrival_idx"].tolist(), list(map(bytes, rows["chunk"])))
        yield decoded({key[0]: session}, magic)
        state.update((session.buffer, session.failed))

    return chunks.groupBy("session_id").applyInPandasWithState(run, FRAME, "buffer binary, failed string", "append", GroupStateTimeout.NoTimeout)


def reassemble_batch(chunks: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """The same for a table: chunks sorted by session and arrival stream through the tasks, a session in one of them, never gathered.

    A batch of chunks, of however many sessions, is decoded at once; of the last session what is left goes on to the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, Session()
        for b in batches:
            sessions = {last: left} if last is not None else {}
            names = b["session_id"].to_numpy()
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            arrivals, data = b["arrival_idx"].tolist(), list(map(bytes, b["chunk"]))
            for i, j in zip(starts, starts[1:], strict=False):
                if j > i:
                    s = sessions.setdefault(last := names[i], Session())
                    s.arrivals, s.chunks = arrivals[i:j], data[i:j]
            left = sessions.get(last, left)
            yield decoded(sessions, magic)

    spread = chunks.select("session_id", "arrival_idx", "chunk").where("session_id IS NOT NULL")
    # By a hash of the name: a shuffle by the name itself is left out above a join on it, which may then be planned anew without one.
    return spread.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "arrival_idx").mapInPandas(run, FRAME)


def of_channels(notifications: DataFrame, channels: tuple[str, ...] = FRAME_CHANNELS) -> DataFrame:
    """Notifications of the channels that carry frames."""
    return notifications.where(F.col("channel").isin(*channels))


def since_start(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows that arrived since their session began; sessions has session_id and start_idx."""
    return rows.join(sessions, "session_id").where(F.col("arrival_idx") >= F.col("start_idx")).drop("start_idx")


def latest_messages(frames: DataFrame) -> DataFrame:
    """Per session the last handshake and health payload, the number of experiment results, and when the last update status came; other message types are passed over.

    A plain aggregation, so on a stream it runs in update mode with one row of state a session.
    """
    at = F.struct("arrival_idx", "frame_no")
    last = lambda kind, name: F.max_by(F.when(F.col("message_type") == kind, F.col("payload").cast("string")), F.when(F.col("message_type") == kind, at)).alias(name)
    known = frames.where(F.col("message_type").isin(HANDSHAKE, HEALTH, OTA_STATUS, EXPERIMENT_RESULT))
    return known.groupBy("session_id").agg(
        last(HANDSHAKE, "handshake"),
        last(HEALTH, "health"),
        F.count(F.when(F.col("message_type") == EXPERIMENT_RESULT, 1)).alias("results"),
        F.max(F.when(F.col("message_type") == OTA_STATUS, F.col("arrival_idx"))).alias("ota_status_idx"),
    )


def experiment_results(frames: DataFrame) -> DataFrame:
    """Experiment results as they arrive, for append mode."""
    return frames.where(F.col("message_type") == EXPERIMENT_RESULT).select("session_id", "arrival_idx", "frame_no", F.col("payload").cast("string").alias("result"))


ACCOUNT = "session_id string, frames long, errors long, discontinuities long, missing decimal(20,0), last_sequence decimal(20,0)"


def _account(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frames, errors, gaps, missing, last = state.get if state.exists else (0, 0, 0, Decimal(0), None)
    rows = pd.concat(list(batches)).sort_values(["arrival_idx", "frame_no"])
    for sequence, error in zip(rows["sequence"], rows["error"], strict=True):
        if error is not None:
            errors += 1
            continue
        frames += 1
        if last is not None and sequence != last + 1:
            gaps += 1
            missing += max(Decimal(0), sequence - last - 1)
        last = sequence
    state.update((frames, errors, gaps, missing, last))
    yield pd.DataFrame([(key[0], frames, errors, gaps, missing, last)], columns=["session_id", "frames", "errors", "discontinuities", "missing", "last_sequence"])


def gap_account(frames: DataFrame) -> DataFrame:
    """Per session of a stream of frames: how many, errors, discontinuities and missing sequence numbers, in update mode; never reordered."""
    return frames.groupBy("session_id").applyInPandasWithState(_account, ACCOUNT, "frames long, errors long, discontinuities long, missing decimal(20,0), last decimal(20,0)", "update", GroupStateTimeout.NoTimeout)


def chunked(frames: DataFrame, data: str, mtu: int) -> DataFrame:
    """Frames as chunks of at most mtu bytes, with chunk_no from 0."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(mtu))
    return frames.select("*", F.posexplode(starts).alias("chunk_no", "__at")).withColumn("chunk", F.substring(F.col(data), F.col("__at") + 1, F.lit(mtu))).drop("__at", data)


def session_counters(frames: DataFrame) -> DataFrame:
    """Per session the errors and frames of a stream, for update mode."""
    return frames.groupBy("session_id").agg(F.count("message_type").alias("frames"), F.count("error").alias("errors"), F.max("sequence").alias("last_sequence"))
