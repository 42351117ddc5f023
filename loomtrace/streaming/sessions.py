"""Sessions of gateways as a stream with state that ends: frames across chunks, gaps, latest messages, expiry.

A gateway has one session at a time. A chunk of another session closes the one before, and a session from which
nothing came for `idle_ms` of event time expires; both clear all that is held, so state grows with the gateways that
are active and not with those that ever were.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtrace.streaming.frames import HANDSHAKE, HEALTH, MAGIC, Session, decoded

#: event is frame, error, latest (a session's last handshake or health as it ends), closed or expired.
EVENT = "gateway_id string, session_id string, event string, arrival_idx long, frame_no int, message_type int, sequence decimal(20,0), monotonic_us decimal(20,0), payload binary, missing decimal(20,0), frames long, error string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
HELD = "session_id string, buffer binary, failed string, arrival_idx long, last decimal(20,0), frames long, at_ms long"


class GatewaySessions(StatefulProcessor):
    """Value state: the session, the bytes of its unfinished frame and its counters; map state: its last message of two types."""

    def __init__(self, idle_ms: int, magic: bytes):
        self.idle_ms, self.magic = idle_ms, magic

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", HELD)
        self.latest = handle.getMapState("latest", "message_type int", "arrival_idx long, payload binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("arrival_idx").drop_duplicates("arrival_idx")
        state = tuple(self.held.get()) if self.held.exists() else None
        fresh, out, latest = state is None, [], {}
        if state:
            chunks = chunks[chunks["arrival_idx"] > state[3]]
        arrivals = list(zip(chunks["session_id"], chunks["arrival_idx"], chunks["chunk"], chunks["at_ms"], strict=True))
        for name, run in groupby(arrivals, lambda r: r[0]):
            run = list(run)
            if state and state[0] != name:
                out += self.ended(key[0], state, latest, "closed")
                state, latest = None, {}
            _, buffer, failed, _, last, frames, at_ms = state or (name, b"", None, 0, None, 0, 0)
            session = Session(bytes(buffer), failed, [int(r[1]) for r in run], [bytes(r[2]) for r in run])
            for f in decoded({name: session}, self.magic).itertuples(index=False):
                if f.error is not None:
                    out.append((key[0], name, "error", f.arrival_idx, None, None, None, None, None, None, frames, f.error))
                    continue
                frames += 1
                missing = None if last is None else max(Decimal(0), f.sequence - last - 1)
                last = f.sequence
                if f.message_type in (HANDSHAKE, HEALTH):
                    latest[f.message_type] = (f.arrival_idx, f.payload)
                out.append((key[0], name, "frame", f.arrival_idx, f.frame_no, f.message_type, f.sequence, f.monotonic_us, f.payload, missing, frames, None))
            state = (name, session.buffer, session.failed, int(run[-1][1]), last, frames, max(at_ms, *(int(r[3]) for r in run)))
        if arrivals:
            self.held.update(state)
            for kind, message in latest.items():
                self.latest.updateValue((kind,), message)
            if fresh:
                self.handle.registerTimer(state[6] + self.idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        # A gateway has one timer; chunks that came since it was set move it on only now.
        state, out = tuple(self.held.get()), []
        if state[6] + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(state[6] + self.idle_ms)
        else:
            out = self.ended(key[0], state, {}, "expired")
            self.held.clear()
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def ended(self, gateway: str, state: tuple, latest: dict, event: str) -> list[tuple]:
        """Rows of a session that ends: its last handshake and health, and what it came to; the map is cleared."""
        name, buffer, failed, arrival, _, frames, _ = state
        known = {k[0]: tuple(v) for k, v in self.latest.iterator()} if self.latest.exists() else {}
        known |= latest
        self.latest.clear()
        rows = [(gateway, name, "latest", at, None, kind, None, None, bytes(payload), None, frames, None) for kind, (at, payload) in sorted(known.items())]
        return [*rows, (gateway, name, event, arrival, None, None, None, None, None, None, frames, failed or ("incomplete frame" if len(buffer) else None))]


def use_state_store(spark: SparkSession) -> None:
    """State of many keys, with timers, is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_events(chunks: DataFrame, idle_ms: int, delay: str = "1 minute", magic: bytes = MAGIC) -> DataFrame:
    """Events of a stream of (gateway_id, session_id, arrival_idx, at, chunk), in append mode.

    Chunks of a gateway are put in order within a trigger, whose size bounds them. One that was delivered
    before, by its arrival_idx, is passed over while its gateway's state lasts; one that comes later than the watermark's `delay` is
    dropped by Spark, which counts it. Rows without gateway, session, chunk or time are passed over. A session with wrong bytes gives an
    error for each chunk until it ends. Call `use_state_store` before the stream starts.
    """
    known = chunks.where("gateway_id IS NOT NULL AND session_id IS NOT NULL AND chunk IS NOT NULL AND at IS NOT NULL AND arrival_idx IS NOT NULL")
    rows = known.withWatermark("at", delay).select("gateway_id", "session_id", "arrival_idx", "chunk", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("gateway_id").transformWithStateInPandas(GatewaySessions(idle_ms, magic), EVENT, "Append", "EventTime")
