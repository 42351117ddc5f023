"""Sessions with state that ends: frames over restarts, new sessions, gaps, expiry, redelivery."""

import datetime

import pytest

from loomtrace.streaming import frames, sessions

SCHEMA = "gateway_id string, session_id string, arrival_idx long, at timestamp, chunk binary"
START = datetime.datetime(2026, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds chunks, each call a run of its own from the same checkpoint; gives all events so far and the rows of state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sessions.use_state_store(spark)

    def run(*rows):
        data = [(g, s, i, START + datetime.timedelta(seconds=t), c) for g, s, i, t, c in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = sessions.session_events(source, idle_ms=60_000, delay="10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.read.schema(sessions.EVENT).parquet(str(tmp_path / "out")).collect()
        return got, q.lastProgress["stateOperators"][0]["numRowsTotal"]

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def of(rows, gateway, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows if r.gateway_id == gateway)


def test_sessions(stream):
    hello, two, five = (frames.encode_frame(k, n, 1000 + n, p) for k, n, p in ((frames.HANDSHAKE, 1, b"hi"), (2, 2, b"x"), (2, 5, b"y")))
    wrong = bytearray(two)
    wrong[36] ^= 1
    stream(("a", "s1", 0, 0, hello + two[:20]), ("b", "t1", 0, 0, bytes(wrong)), ("c", "u1", 0, 1, hello[:30]), (None, "z", 0, 1, b"?"), ("d", None, 0, 1, b"?"))
    got, _ = stream(("a", "s1", 0, 0, hello + two[:20]), ("a", "s1", 1, 5, two[20:] + five[:9]), ("b", "t1", 1, 5, two), ("b", "t2", 2, 6, two))
    # The second run went on in mid-frame from the checkpoint, passed over the chunk delivered again, and began a new session.
    assert [(int(r.sequence), r.missing if r.missing is None else int(r.missing), r.frames) for r in sorted((r for r in got if r.gateway_id == "a"), key=lambda r: r.sequence)] == [(1, None, 1), (2, 0, 2)]
    assert of(got, "b", "arrival_idx", "session_id", "event", "error") == [(0, "t1", "error", "payload CRC mismatch"), (1, "t1", "closed", "payload CRC mismatch"), (1, "t1", "error", "payload CRC mismatch"), (2, "t2", "frame", None)]
    stream(("a", "s1", 2, 8, five[9:]), ("a", "s2", 3, 50, hello))
    got, _ = stream(("e", "v1", 0, 100, two))
    a = [r for r in got if r.gateway_id == "a"]
    assert [int(r.missing) for r in a if r.sequence == 5] == [2]
    assert [(r.session_id, r.arrival_idx, r.frames, r.error) for r in a if r.event == "closed"] == [("s1", 2, 3, None)]
    assert [(r.session_id, r.message_type, bytes(r.payload)) for r in a if r.event == "latest"] == [("s1", frames.HANDSHAKE, b"hi")]
    assert of(got, "c", "event", "error") == [("expired", "incomplete frame")]
    # 100 s less the delay is past what b was idle for, not what a was since its second session began.
    assert [r.event for r in got if r.gateway_id == "b" and r.session_id == "t2"] == ["frame", "expired"] and not [r for r in a if r.event == "expired"]
    assert {r.gateway_id for r in got} == {"a", "b", "c", "e"}
    stream(("f", "w", 0, 1000, two))
    got, rows = stream(("f", "w", 1, 2000, b""))
    assert [r.session_id for r in got if r.gateway_id == "a" and r.event == "expired"] == ["s2"]
    assert [r.event for r in got if r.gateway_id == "e"].count("expired") == 1 and rows <= 4  # only f is left, with its timer
