"""Queries that run as streams over the driver's tables, from a checkpoint in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.plans.catalogue import query, read
from loomtrace.sources import scratch
from loomtrace.streaming import frames, sessions

STORE = "spark.sql.streaming.stateStore.providerClass"
#: Files that one write makes, which one trigger reads.
FILES = 4


def streamed(parts: list[DataFrame], transform, schema: str) -> DataFrame:
    """What a stream gives that finds the parts one after the other, a trigger for each; all it holds between them is its state."""
    spark = parts[0].sparkSession
    folder = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for p in parts:
        p.repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(STORE)
    sessions.use_state_store(spark)
    try:
        source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")
        writer = transform(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("""
WITH e AS (SELECT *, 'user-' || user_id AS gateway_id, 'user-' || user_id || '-' || (epoch_us(ts) // 604800000000) AS session_id FROM events),
f AS (SELECT gateway_id, session_id, event_id, ts, props, (1 + event_id % 10)::INT AS message_type, row_number() OVER w AS frames, CASE WHEN lag(event_id) OVER w IS NOT NULL THEN greatest(0, event_id - lag(event_id) OVER w - 1) END AS missing FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
s AS (SELECT gateway_id, session_id, count(*) AS frames, max(ts) AS z, max(max(ts)) OVER (PARTITION BY gateway_id) AS last_z FROM e GROUP BY gateway_id, session_id)
SELECT session_id, 'frame' AS event, event_id::BIGINT AS sequence, message_type, missing::BIGINT AS missing, frames, props AS payload FROM f
UNION ALL SELECT session_id, 'closed', NULL, NULL, NULL, frames, NULL FROM s WHERE z < last_z
UNION ALL SELECT f.session_id, 'latest', NULL, f.message_type, NULL, any_value(s.frames), arg_max(props, f.frames) FROM f JOIN s USING (session_id) WHERE f.message_type IN (1, 4) AND z < last_z GROUP BY f.session_id, f.message_type""")
def session_frames(spark, sf_dir):
    """A user's events of a week as a session of frames in chunks, streamed in three triggers that cut sessions anywhere."""
    events = read(spark, sf_dir, "events")
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(
        user.alias("gateway_id"), F.concat(user, F.lit("-"), F.floor(us / 604_800_000_000).cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("at"), "event_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), (1 + F.col("event_id") % 10).cast("int").alias("message_type"), F.col("event_id").alias("sequence"), us.alias("monotonic_us"), F.col("props").cast("binary").alias("payload"),
    )
    chunks = frames.chunked(frames.encoded_frames(rows, "gateway_id", "session_id", "at", "n"), "frame", 32)
    chunks = scratch.saved(chunks.select("gateway_id", "session_id", (F.col("n") * 1000 + F.col("chunk_no")).cast("long").alias("arrival_idx"), "at", "chunk"), "chunks")
    ends = chunks.agg(F.min("at").alias("a"), F.max("at").alias("z")).first()
    cuts = [ends["a"] + (ends["z"] - ends["a"]) * i / 3 for i in range(1, 3)] if ends["a"] else []
    parts = [chunks.where(F.col("at") < F.lit(cuts[0])), chunks.where((F.col("at") >= F.lit(cuts[0])) & (F.col("at") < F.lit(cuts[1]))), chunks.where(F.col("at") >= F.lit(cuts[1]))] if cuts else [chunks]
    found = streamed(parts, lambda s: sessions.session_events(s, idle_ms=4_000 * 86_400_000, delay="1 hour"), sessions.EVENT)
    scratch.dropped(chunks)
    return found.select("session_id", "event", F.col("sequence").cast("long").alias("sequence"), "message_type", F.col("missing").cast("long").alias("missing"), "frames", F.col("payload").cast("string").alias("payload"))
