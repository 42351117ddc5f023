"""Frames over chunks, in a table and in a stream; checksums, versions, equations, ranges."""

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import binary
from loomtrace.operators import ranges, state
from loomtrace.plans import equations
from loomtrace.streaming import frames

TWO = frames.encode_frame(2, 7, 1000, b"first") + frames.encode_frame(3, 8, 2**63 + 5, b"second")


def test_crc32c(spark):
    assert binary.crc32c(b"123456789") == 0xE3069283
    assert spark.sql("SELECT CAST('123456789' AS BINARY) AS b").select(binary.crc32c_of("b").alias("c")).first().c == 0xE3069283


def chunks(spark):
    bad = bytearray(TWO)
    bad[36] ^= 1
    rows = [("a", 0, TWO[:11]), ("a", 1, TWO[11:50]), ("a", 2, TWO[50:]), ("b", 0, bytes(bad)), ("b", 1, TWO), ("c", 0, b"nonsense" * 8)]
    return spark.createDataFrame(rows, "session_id string, arrival_idx long, chunk binary")


def check(rows):
    a = sorted((int(r.sequence), int(r.monotonic_us), bytes(r.payload)) for r in rows if r.session_id == "a")
    assert a == [(7, 1000, b"first"), (8, 2**63 + 5, b"second")]
    assert [r.error for r in rows if r.session_id == "b"] == ["payload CRC mismatch"] * 2  # poisoned from the first on
    assert [r.error for r in rows if r.session_id == "c"] == ["invalid magic"]


def test_batch(spark):
    check(frames.reassemble_batch(chunks(spark)).collect())


def test_stream(spark, tmp_path):
    for i in range(3):
        chunks(spark).where(F.col("arrival_idx") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, arrival_idx long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frames.reassemble(stream).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    check(spark.table("frames").collect())


def test_chunked_round_trip(spark):
    df = spark.createDataFrame([("a", TWO)], "session_id string, data binary")
    parts = frames.chunked(df, "data", 20).withColumnRenamed("chunk_no", "arrival_idx")
    assert parts.count() == -(-len(TWO) // 20)
    assert frames.reassemble_batch(parts).where("error IS NULL").count() == 2
    assert frames.session_counters(frames.reassemble_batch(parts)).first().frames == 2


def test_integers(spark):
    row = spark.createDataFrame([(bytes([0x01, 0xCF, 0xFF, 0xFE, 255, 255, 255, 255, 255, 255]),)], "b binary")
    got = row.select(binary.le_unsigned(F.col("b"), 0, 2), binary.be_unsigned(F.col("b"), 0, 2), binary.signed(binary.be_unsigned(F.col("b"), 2, 2), 16), binary.le_unsigned(F.col("b"), 2, 8)).first()
    assert (got[0], got[1], got[2], int(got[3])) == (0xCF01, 0x01CF, -2, 0xFFFFFFFFFFFFFEFF)


@pytest.mark.parametrize(("a", "b", "order"), [("1.0.0-dev.5", "1.0.0", 1), ("1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("0.9", "1", -1), ("1.0.0-1", "1.0.0", 0), ("1.0.0-dev.5", "1.0.0.3", 1), ("1..2", "1.2", 0), ("99999999999", "2", 1), ("1." + "9" * 60, "1.5", 1), ("x.1", "0.1", 0)])
def test_versions(spark, a, b, order):
    assert spark.range(1).select(binary.compare_versions(F.lit(a), F.lit(b))).first()[0] == order


def test_equations(spark):
    node = lambda op, *args: {"kind": "operation", "operator": op, "arguments": [{"kind": "literal", "value": x} if not isinstance(x, dict) else x for x in args]}
    one = spark.range(1)
    value = lambda n, **inputs: one.select(equations.compile_node(n, inputs, {"k": 4.0})).first()[0]
    assert value(node("divide", 1, 0)) is None and value(node("clamp", 7, 0, 5)) == 5 and value(node("geometric_mean", 4, 9)) == pytest.approx(6)
    assert value(node("geometric_mean", -1, 4)) is None and value(node("mean", 1, 2, 6)) == 3 and value(node("abs", -3)) == 3
    assert value(node("max", 1, {"kind": "input", "name": "x"}), x=F.lit(None)) is None
    assert value(node("subtract", 9, {"kind": "constant", "name": "k"}, 1)) == 4
    for bad in ({"kind": "input", "name": "y"}, node("power", 2, 3), node("abs", 1, 2), {"kind": "other"}):
        with pytest.raises(equations.EquationError):
            value(bad)


def test_ranges(spark):
    segments = spark.createDataFrame([("boot", 4096, 30336), ("table", 32768, 35840), ("ota", 53248, 61440), ("app", 65536, 567888)], "label string, start long, end long")
    held = spark.createDataFrame([(36864, 53248)], "start long, end long")
    assert ranges.overlapping(segments, held).count() == 0  # half-open: one starts where the protected range ends
    assert [r.label for r in ranges.overlapping(segments, spark.createDataFrame([(35839, 53249)], "start long, end long")).orderBy("start").collect()] == ["table", "ota"]
    many = spark.range(20_000).select((F.col("id") * 100).alias("start"), (F.col("id") * 100 + 1).alias("end"))
    assert ranges.overlapping(segments, many).count() == 4


def test_state(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), ("PASSIVE_LOCK",), ("READ_CONFIRMED",), ("NO_LOCK",)], "o string").select(state.outcome_state(F.col("o"))).collect()] == ["NOT_TESTED", "NETWORK_DETECTED", "OBD_CONFIRMED", "NO_LOCK"]
    assert [r[0] for r in spark.createDataFrame([(None,), (-95,), (-85,), (-50,)], "r int").select(state.signal_bucket(F.col("r"))).collect()] == ["WAIT", "BLOCKED", "CHECK", "PASS"]


def test_stream_accounts_and_latest_messages(spark, tmp_path):
    gap = b"".join(frames.encode_frame(k, n, n, p) for k, n, p in ((1, 5, b"hello"), (4, 6, b"h1"), (2, 9, b"can"), (4, 8, b"h2"), (10, 9, b"r"), (8, 10, b"boot")))
    rows = [("g", 0, gap[:70]), ("g", 1, gap[70:]), ("p", 0, b"nonsense" * 8), ("p", 1, gap)]
    for i in range(2):
        spark.createDataFrame([r for r in rows if r[1] == i], "session_id string, arrival_idx long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = frames.reassemble_batch(spark.read.parquet(str(tmp_path / "in")))
    batch.coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "frames"))
    for name, df in (("account", frames.gap_account(stream())), ("latest", frames.latest_messages(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.session_id: (r.frames, r.errors, r.discontinuities, int(r.missing)) for r in spark.table("account").collect()}
    assert got == {"g": (6, 0, 2, 2), "p": (0, 2, 0, 0)}
    assert [(r.handshake, r.health, r.results, r.ota_status_idx) for r in spark.table("latest").collect()] == [("hello", "h2", 1, 1)]
    assert [r.result for r in frames.experiment_results(batch).collect()] == ["r"]
    started = spark.createDataFrame([("g", 1)], "session_id string, start_idx long")
    assert frames.since_start(batch, started).where("arrival_idx = 0").count() == 0


def test_ranges_large_side_keeps_empty_ranges(spark, monkeypatch):
    left = spark.createDataFrame([(5, 5), (3, 3), (8, 8), (70_000, 70_000), (1, 200_000)], "start long, end long")
    right = spark.createDataFrame([(3, 8), (65_536, 80_000), (4, 4)], "start long, end long")
    small = sorted(map(tuple, ranges.overlapping(left, right).collect()))
    monkeypatch.setattr(ranges, "SMALL", 0)
    assert sorted(map(tuple, ranges.overlapping(left, right).collect())) == small == [(1, 200_000), (5, 5), (70_000, 70_000)]


def test_crc32c_of_many():
    import random

    rng = random.Random(1)
    data = [rng.randbytes(rng.randrange(60)) for _ in range(200)] + [b"", b"123456789"]
    assert binary.crc32c_all(data).tolist() == [binary.crc32c(x) for x in data]
    assert binary.crc32c_all([]).tolist() == []


def one_by_one(pieces, magic=frames.MAGIC):
    """A session's chunks through the decoder one call after another."""
    out, session = [], frames.Session()
    for arrival, piece in pieces:
        session.arrivals, session.chunks = [arrival], [piece]
        out += frames.decoded({"s": session}, magic).values.tolist()
    return out


def test_decoding_at_once_is_decoding_by_chunk():
    """Broken and whole frames cut anywhere: all chunks at once, in batches, and one by one give the same rows."""
    import random

    rng = random.Random(6)
    for _ in range(120):
        data = b""
        for i in range(rng.randrange(1, 12)):
            frame = bytearray(frames.encode_frame(rng.randrange(1, 11), i, i * 10, bytes(rng.randrange(256) for _ in range(rng.randrange(40)))))
            if rng.random() < 0.12:
                frame[rng.choice([0, 4, 6, 11, 33, len(frame) - 1])] ^= rng.choice([1, 255])
            data += bytes(frame)
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randrange(12)))})
        pieces = [(k, data[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        expected = one_by_one(pieces)
        for size in (1000, 3):
            session, got = frames.Session(), []
            for k in range(0, len(pieces), size):
                session.arrivals, session.chunks = [p[0] for p in pieces[k : k + size]], [p[1] for p in pieces[k : k + size]]
                got += frames.decoded({"s": session}, frames.MAGIC).values.tolist()
            assert repr(got) == repr(expected)
    other = frames.encode_frame(2, 1, 1, b"x", magic=b"ABCD")
    assert one_by_one([(0, other)])[0][-1] == "invalid magic" and one_by_one([(0, other)], b"ABCD")[0][-1] is None


def test_canonical_json(spark):
    import json

    from loomtrace.functions.canonical import canonical_json

    values = [(1.0e-5, "é", 1), (123456789.25, "日本 🙂", 2), (0.5, 'a"\\\n\u0001\x7f', 3), (1e22, "plain", 4), (None, None, 5), (-0.0, "/", 6)]
    df = spark.createDataFrame(values, "b double, a string, c long")
    got = {r.c: r.j for r in df.select("c", canonical_json(df).alias("j")).collect()}
    for b, a, c in values:
        assert got[c] == json.dumps({k: v for k, v in (("a", a), ("b", b), ("c", c)) if v is not None}, separators=(",", ":"))


def test_ids_end_where_they_end(spark):
    from loomtrace.functions import ids

    good = "obs_" + "0" * 26
    rows = spark.createDataFrame([(good, True), (good + "\n", False), (good + "\r", False), ("x" + good[3:], False)], "i string, ok boolean")
    assert rows.where(ids.is_domain_id(F.col("i"), "obs") != F.col("ok")).count() == 0
    assert rows.where("i LIKE 'obs%'").where(ids.id_timestamp_ms(F.col("i")).isNotNull() != F.col("ok")).count() == 0
