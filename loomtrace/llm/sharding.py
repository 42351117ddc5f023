"""Shards of equal row counts by a two-pass external shuffle.

The first pass scatters rows uniformly into buckets that fit a task's memory, by a seeded hash of the row. The
second puts each bucket in an order that doesn't depend on how it arrived, shuffles it (Fisher-Yates, seeded
by the bucket) and writes it. Buckets one after the other are a random order of all rows, which is cut into
shards of as many rows as each other; each shard is a run of buckets, so nothing moves a third time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh, named, saved, table, text_of

SHARDS, SEED = 8, 42
#: Bytes of text of a bucket, on average, and what a row counts beside its text.
BUCKET_BYTES, ROW_BYTES = 32 << 20, 64
#: Rows that a shuffled bucket hands on at a time.
BATCH = 2000


def shuffled(rows: DataFrame, seed: int, bucket_col: str, place_col: str) -> DataFrame:
    """Each partition is a bucket: its rows in random order, with the number of the bucket and the place in it."""
    columns = [f"c{i}" for i in range(len(rows.columns))]  # names with dots can't go to mapInArrow
    inner = rows.toDF(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket, got = TaskContext.get().partitionId(), list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        order = np.random.default_rng((seed, bucket)).permutation(len(whole))  # Fisher-Yates
        for i in range(0, len(whole), BATCH):
            some = whole.take(pa.array(order[i : i + BATCH])).combine_chunks().to_batches()[0]
            n = len(some)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(n, bucket, dtype=np.int32)), pa.array(np.arange(i, i + n))], names=[*columns, "bucket", "place"])

    schema = StructType([*inner.schema, StructField("bucket", IntegerType()), StructField("place", LongType())])
    return inner.mapInArrow(run, schema).toDF(*rows.columns, bucket_col, place_col)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows and columns of docs, with the shard (0 to shards - 1) and the slot in it (from 0, without gaps).

    Shards differ by one row at most. Which row goes where follows from its id, its text, the seed and the
    rows beside it, not from files or partitions; repeated rows, so many that they would fill a bucket, are
    dealt by their places in the files, and are all alike. Null ids and texts are values like any other, a
    null text has no bytes. An empty table gives an empty result; shard_col and slot_col must be new names,
    other columns may have any.
    """
    key, bucket, place = (fresh(c, docs) for c in ("row_key", "row_bucket", "row_place"))
    size = F.octet_length(text_of(text_col)) + ROW_BYTES
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), named(id_col), named(text_col)))
    total = docs.agg(F.sum(size)).collect()[0][0] or 0
    many = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    many = saved(many.where((F.col("n") > 1) & (F.col("size") > bucket_bytes // 8)).select(F.col(key).alias("many")), "repeated-rows")
    buckets = max(1, -(-total // bucket_bytes))
    if not many.isEmpty():
        salt = F.when(F.col("many").isNotNull(), F.xxhash64(F.col(key), F.monotonically_increasing_id())).otherwise(F.col(key))
        keyed = keyed.join(many, F.col(key) == F.col("many"), "left").select(*map(named, docs.columns), salt.alias(key))
    plain = [named(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    dealt = keyed.repartition(buckets, key).sortWithinPartitions(key, F.xxhash64(*plain)).drop(key)
    written = saved(shuffled(dealt, seed, bucket, place), "shuffled-buckets")
    # A row for each bucket, of some 32 MB each: few enough for one task to add up.
    counts = written.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(bucket)
    starts = counts.select(F.col(bucket).alias("of_bucket"), (F.sum("n").over(w) - F.col("n")).alias("first"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    starts = saved(starts, "bucket-starts").select(F.struct("*").alias(start := fresh("row_start", docs)))
    placed = written.join(starts, F.col(bucket) == F.col(f"{start}.of_bucket"))
    at = f"({start}.first + {place})"
    number = F.expr(f"{at} * {shards} div {start}.total")
    slot = F.expr(f"{at} - ({at} * {shards} div {start}.total * {start}.total + {shards - 1}) div {shards}")
    return placed.select(*map(named, docs.columns), number.cast("int").alias(shard_col), slot.alias(slot_col))


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard") -> None:
    """A folder for each shard; a file is a run of neighbouring slots in order."""
    placed.write.partitionBy(shard_col).parquet(path)


def op12_external_shuffle(spark, sf_dir):
    text = text_of("text")
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
