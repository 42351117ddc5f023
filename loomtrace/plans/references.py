"""Queries over references between documents and over captures as a data source.

Customers are findings, orders runs, lines samples, parts and suppliers what was observed; events are a capture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators import closure
from loomtrace.plans import evidence
from loomtrace.plans.catalogue import query, read
from loomtrace.sources import capture_format, scratch


def named(kind: str, *columns: str):
    return F.concat_ws("_", F.lit(kind), *(F.col(c).cast("string") for c in columns))


def documents(spark, sf_dir) -> list[DataFrame]:
    """Four tables of documents with their references.

    A finding rests on its customer's last run, a run on one half as far back and on its samples, the first run on
    the last, which is a cycle, and samples on parts and suppliers, by several ways where these are shared.
    """
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ranked = orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), F.max("o_orderkey").over(Window.partitionBy("o_custkey")).alias("last"))
    before = ranked.select("o_custkey", F.col("r").alias("half"), F.col("o_orderkey").alias("base"))
    built = ranked.withColumn("half", F.floor(F.col("r") / 2)).join(before, ["o_custkey", "half"], "left").select(named("calc", "o_orderkey").alias("id"), F.array(F.concat(F.lit("calc_"), F.coalesce("base", "last").cast("string"))).alias("evidence_refs"))
    sampled = lines.select(named("calc", "l_orderkey").alias("id"), F.array(named("sample", "l_orderkey", "l_linenumber")).alias("evidence_refs"))
    samples = lines.select(named("sample", "l_orderkey", "l_linenumber").alias("id"), F.array(named("obs", "l_partkey"), named("inspection", "l_suppkey")).alias("evidence_refs"))
    findings = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last")).select(named("finding", "o_custkey").alias("id"), F.array(named("calc", "last")).alias("evidence_refs"))
    return [findings, built, sampled, samples]


EDGES_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
e AS (SELECT DISTINCT * FROM (SELECT 'finding_' || o_custkey AS src, 'calc_' || max(o_orderkey) AS dst FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'calc_' || a.o_orderkey, 'calc_' || coalesce(b.o_orderkey, a.last) FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.r = a.r // 2
  UNION ALL SELECT 'calc_' || l_orderkey, 'sample_' || l_orderkey || '_' || l_linenumber FROM lineitem
  UNION ALL SELECT 'sample_' || l_orderkey || '_' || l_linenumber, unnest(['obs_' || l_partkey, 'inspection_' || l_suppkey]) FROM lineitem)),
"""


@query(EDGES_SQL + """
p AS (SELECT 'finding_' || o_custkey AS finding, 'finding_' || o_custkey AS id, 0 AS depth FROM orders GROUP BY o_custkey UNION SELECT finding, dst, depth + 1 FROM p JOIN e ON id = src WHERE depth < 16)
SELECT finding, id, min(depth)::INT AS depth FROM p GROUP BY ALL""")
def reachable_evidence(spark, sf_dir):
    """All that each finding rests on."""
    tables = documents(spark, sf_dir)
    starts = tables[0].select("id", F.col("id").alias("finding"))
    return closure.reachable(closure.reference_edges(*tables, repeats=True), starts, ("finding",))


@query(EDGES_SQL + """
p AS (SELECT 'obs_' || p_partkey AS id, 0 AS depth FROM part WHERE p_brand = 'Brand#13' UNION SELECT src, depth + 1 FROM p JOIN e ON id = dst WHERE depth < 32)
SELECT id, split_part(id, '_', 1) AS kind, min(depth)::INT AS depth FROM p GROUP BY ALL""")
def withdrawn_evidence(spark, sf_dir):
    """All that rests on an observation of one brand, should these be withdrawn."""
    withdrawn = read(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(named("obs", "p_partkey").alias("id"))
    found = closure.reachable(closure.reference_edges(*documents(spark, sf_dir), repeats=True), withdrawn, forward=True)
    return found.select("id", closure.kind_of(F.col("id")).alias("kind"), "depth")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderstatus, CASE WHEN o_orderkey IS NOT NULL THEN date_diff('day', o_orderdate, l_shipdate) END AS age_days, o_orderkey IS NULL AS orphan
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""")
def sample_observations(spark, sf_dir):
    """Lines as samples of orders, where pending orders have not been observed yet."""
    samples = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    held = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    rows = closure.with_observations(samples, held, "o_orderkey", "o_orderstatus", "o_orderdate")
    return rows.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "o_orderstatus", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("age_days"), "orphan")


@query("""
WITH v AS (SELECT event_id AS sequence, unnest([1, 2, 3, 4]) AS k, (unnest([round_even(value * 10 * 4, 0), round_even(value * 10, 0), round_even((value - 40) * 10, 0), round_even(value / 10 * 1000, 0)])::BIGINT % 65536 + 65536) % 65536 AS u FROM events)
SELECT sequence, sequence * 1000 AS observed_at_monotonic_us, string_agg(lpad(lower(printf('%x', u)), 4, '0'), '' ORDER BY k) AS data FROM v GROUP BY sequence""")
def capture_round_trip(spark, sf_dir):
    """Events as a capture, written and read through the data source, three columns of each line."""
    folder = f"{scratch.shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    capture_format.save_capture(evidence.observations(spark, sf_dir), folder)
    rows = spark.read.format("capture").schema("sequence long, observed_at_monotonic_us long, payload struct<data: string>").load(folder)
    return rows.select("sequence", "observed_at_monotonic_us", F.col("payload.data").alias("data"))
