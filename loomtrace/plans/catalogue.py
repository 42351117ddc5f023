"""Queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no captures, so each operator works by analogy: in `events` a user is a session, event_id
a sequence, ts a clock and value a reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.functions import binary, ids
from loomtrace.operators import ranges, replay, rules, sequence, state
from loomtrace.plans import equations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("""
WITH e AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) AS frames, coalesce(sum(CASE WHEN event_id <> p + 1 THEN 1 END), 0)::BIGINT AS discontinuities,
  coalesce(sum(CASE WHEN event_id > p + 1 THEN event_id - p - 1 END), 0)::BIGINT AS missing FROM e GROUP BY user_id""")
def sequence_gaps(spark, sf_dir):
    return sequence.gap_account(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS previous_l_linenumber FROM lineitem)
SELECT * FROM e WHERE previous_l_linenumber IS NOT NULL AND l_linenumber <> previous_l_linenumber + 1""")
def contiguity_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return sequence.contiguity_violations(rows, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_linenumber").drop("l_shipdate")


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_t FROM orders)
SELECT * FROM e WHERE t <= previous_t""")
def time_order_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("t"))
    return sequence.time_violations(rows, "o_custkey", ["o_orderkey"], "t")


@query("""
SELECT user_id, count(*) AS records, sum(strlen(props))::BIGINT AS bytes, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type,
  epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM events GROUP BY user_id""")
def session_window(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.octet_length("props")).alias("bytes"),
        F.min_by("event_type", "event_id").alias("first_type"),
        F.max_by("event_type", "event_id").alias("last_type"),
        F.unix_micros(F.min("ts").cast("timestamp")).alias("start_us"),
        F.unix_micros(F.max("ts").cast("timestamp")).alias("end_us"),
    )


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def distinct_types(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events),
l AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT u.user_id, t.event_type, coalesce(CAST(l.event_id AS VARCHAR), 'NOT_TESTED') AS state FROM u CROSS JOIN t LEFT JOIN l ON l.user_id = u.user_id AND l.event_type = t.event_type""")
def latest_state(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    grid = events.select("user_id").distinct().join(events.select("event_type").distinct(), how="cross")  # a row for each session and kind, which is the result's size
    latest = state.latest_by(events, ["user_id", "event_type"], ["event_id"], ["event_id"])
    return state.with_default(grid, latest.select("user_id", "event_type", F.col("event_id").cast("string").alias("state")), ["user_id", "event_type"], "state", "NOT_TESTED")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE value > 50 GROUP BY user_id")
def latest_where(spark, sf_dir):
    return state.latest_by(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_id", "value"], F.col("value") > 50)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_result(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_result(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("SELECT event_id, sha256(props) AS digest, base64(encode(props)) AS encoded FROM events")
def payload_digest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("digest"), F.base64(F.col("props").cast("binary")).alias("encoded"))


@query("SELECT user_id, sha256(string_agg(event_id || ':' || props, chr(10) ORDER BY event_id) || chr(10)) AS digest, count(*) AS records FROM events GROUP BY user_id")
def capture_digest(spark, sf_dir):
    return replay.ordered_digest(read(spark, sf_dir, "events"), "user_id", ["event_id"], F.concat_ws(":", F.col("event_id").cast("string"), "props"))


@query("""
WITH x AS (SELECT event_id, (round_even(value * 4, 0)::BIGINT % 65536 + 65536) % 65536 AS u FROM events)
SELECT event_id, lpad(lower(printf('%x', u)), 4, '0') AS data, u / 4.0 AS decoded, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS as_signed, (u % 256) * 256 + u // 256 AS little FROM x""")
def encode_decode(spark, sf_dir):
    data = read(spark, sf_dir, "events").select("event_id", binary.be_hex(binary.fixed_point(F.col("value"), 4), 2).alias("data"))
    raw = F.unhex("data")
    u = binary.be_unsigned(raw, 0, 2)
    return data.select("event_id", "data", (u / 4.0).alias("decoded"), binary.signed(u, 16).alias("as_signed"), binary.le_unsigned(raw, 0, 2).alias("little"))


@query("""
SELECT l_orderkey, l_linenumber, m.signal_id, m.value FROM lineitem,
LATERAL (VALUES ('quantity', l_quantity), ('price', l_extendedprice), ('discount', l_discount), ('tax', l_tax)) AS m(signal_id, value)""")
def unpivot_measures(spark, sf_dir):
    named = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return named.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "price", "discount", "tax"], "signal_id", "value")


BASE32_SQL = "array_to_string(list_transform(range({n} - 1, -1, -1), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + CAST(({v} >> CAST(5 * i AS INT)) & 31 AS INT), 1)), '')"
ID_SQL = (
    "WITH h AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, sha256('obs'::BLOB || '\\x00'::BLOB || (user_id || ':' || event_id)::BLOB) AS h FROM events), "
    "n AS (SELECT event_id, ms, CAST('0x' || substr(h, 1, 10) AS BIGINT) AS a, CAST('0x' || substr(h, 11, 10) AS BIGINT) AS b FROM h) "
    "SELECT event_id, 'obs_' || " + BASE32_SQL.format(n=10, v="ms") + " || " + BASE32_SQL.format(n=8, v="a") + " || " + BASE32_SQL.format(n=8, v="b") + " AS domain_id"
)


def event_ids(spark, sf_dir):
    seed = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", ids.deterministic_id("obs", seed, F.unix_millis(F.col("ts").cast("timestamp"))).alias("domain_id"))


@query(ID_SQL + " FROM n")
def deterministic_ids(spark, sf_dir):
    return event_ids(spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS well_formed FROM events")
def id_timestamp(spark, sf_dir):
    return event_ids(spark, sf_dir).select("event_id", ids.id_timestamp_ms(F.col("domain_id")).alias("ms"), ids.is_domain_id(F.col("domain_id"), "obs").alias("well_formed"))


@query("""
SELECT event_id, 0 AS check_order, 'type_enum' AS rule, 'bad type ' || event_type AS message FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id, 1, 'value_range', 'value_range' FROM events WHERE NOT value BETWEEN 1 AND 90
UNION ALL SELECT event_id, 2, 'props_length', 'props_length' FROM events WHERE NOT length(props) BETWEEN 1 AND 8
UNION ALL SELECT event_id, 3, 'props_pattern', 'props_pattern' FROM events WHERE NOT regexp_matches(props, '^[{]"k": [0-4][0-9]*[}]$')""")
def rule_violations(spark, sf_dir):
    found = [
        rules.Rule("type_enum", F.col("event_type").isin("click", "view", "purchase"), F.concat(F.lit("bad type "), "event_type")),
        rules.Rule("value_range", F.col("value").between(1, 90)),
        rules.Rule("props_length", F.length("props").between(1, 8)),
        rules.Rule("props_pattern", F.col("props").rlike('^[{]"k": [0-4][0-9]*[}]$')),
    ]
    return rules.violations(read(spark, sf_dir, "events"), found, "event_id")


@query("""
WITH v AS (SELECT user_id, event_id, 0 AS check_order, 'type_enum' AS rule FROM events WHERE event_type <> 'click' UNION ALL SELECT user_id, event_id, 1, 'value_range' FROM events WHERE NOT value BETWEEN 1 AND 90)
SELECT user_id, event_id, check_order, rule FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id, check_order) = 1""")
def first_violation(spark, sf_dir):
    found = rules.violations(read(spark, sf_dir, "events"), [rules.Rule("type_enum", F.col("event_type") == "click"), rules.Rule("value_range", F.col("value").between(1, 90))], "user_id", "event_id")
    return rules.first_violation(found.drop("message"), ["user_id"], ["event_id", "check_order"])


@query("SELECT o_orderkey FROM orders WHERE NOT (NOT (o_orderstatus = 'F') OR (o_totalprice > 1000 AND o_orderpriority LIKE '1%'))")
def implication_rules(spark, sf_dir):
    ok = rules.implies(F.col("o_orderstatus") == "F", (F.col("o_totalprice") > 1000) & F.col("o_orderpriority").startswith("1"))
    return read(spark, sf_dir, "orders").where(~ok).select("o_orderkey")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal / 100 - 90 <= -90 THEN 'BLOCKED' WHEN c_acctbal / 100 - 90 <= -80 THEN 'CHECK' ELSE 'PASS' END AS signal,
  CASE WHEN c_nationkey = 0 THEN 'PASS' ELSE 'CHECK' END AS counter, [1, 2, 4, 8, 15, 30][least(greatest(c_nationkey, 1), 6)] AS backoff FROM customer""")
def level_buckets(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", state.signal_bucket(F.col("c_acctbal") / 100 - 90).alias("signal"), state.counter_level(F.col("c_nationkey")).alias("counter"), state.backoff_seconds(F.col("c_nationkey")).alias("backoff"))


@query("""
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (VALUES (5, 8), (20, 21), (40, 45)) AS r(lo, hi) WHERE p_partkey % 50 < r.hi AND p_partkey % 50 + p_size % 7 > r.lo)""")
def range_overlap(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("start"), (F.col("p_partkey") % 50 + F.col("p_size") % 7).alias("end"))
    protected = spark.createDataFrame([(5, 8), (20, 21), (40, 45)], "start long, end long")
    return ranges.overlapping(parts, protected).select("p_partkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem""")
def prefix_offsets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return sequence.prefix_offsets(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "size"], "size").drop("size", "l_suppkey")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS from_end FROM events QUALIFY from_end <= 40")
def tail_k(spark, sf_dir):
    return sequence.tail(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", [F.col("event_id").desc()], 40)


@query("""
WITH v AS (SELECT p_partkey, [1, (p_size // 10)::INT, (p_size % 10)::INT] AS a, [1, 2] AS b FROM part)
SELECT p_partkey, CASE WHEN a > [1, 2, 0] THEN 1 WHEN a < [1, 2, 0] THEN -1 ELSE 0 END AS order_to_1_2 FROM v""")
def version_compare(spark, sf_dir):
    version = F.concat(F.lit("1."), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", binary.compare_versions(version, F.lit("1.2")).alias("order_to_1_2"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_projection(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY event_id) AS bad FROM events WHERE value > 95 GROUP BY event_type")
def error_summary(spark, sf_dir):
    bad = read(spark, sf_dir, "events").where("value > 95")
    return bad.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ";").alias("bad"))


@query("""
WITH l AS (SELECT user_id, ts, event_id AS label FROM events WHERE event_type = 'purchase')
SELECT e.event_id, l.label FROM events e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts >= l.ts""")
def asof_label(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    labels = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("label"))
    return state.as_of(events.select("user_id", "ts", "event_id"), labels, "user_id", "ts", "label").select("event_id", "label")


EQUATION = {
    "kind": "operation", "operator": "clamp", "arguments": [
        {"kind": "operation", "operator": "divide", "arguments": [
            {"kind": "operation", "operator": "multiply", "arguments": [{"kind": "input", "name": "price"}, {"kind": "operation", "operator": "subtract", "arguments": [{"kind": "literal", "value": 1}, {"kind": "input", "name": "discount"}]}]},
            {"kind": "operation", "operator": "max", "arguments": [{"kind": "input", "name": "quantity"}, {"kind": "constant", "name": "floor"}]}]},
        {"kind": "literal", "value": 100}, {"kind": "literal", "value": 2000}]}


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(100.0, least(2000.0, l_extendedprice * (1 - l_discount) / greatest(l_quantity, 2.0))) AS result, round(exp((ln(l_quantity) + ln(l_extendedprice)) / 2), 6) AS geometric, (l_quantity + l_extendedprice + l_tax) / 3 AS mean FROM lineitem")
def equation_eval(spark, sf_dir):
    inputs = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "quantity": F.col("l_quantity"), "tax": F.col("l_tax")}
    value = lambda operator, *names: equations.compile_node({"kind": "operation", "operator": operator, "arguments": [{"kind": "input", "name": n} for n in names]}, inputs, {})
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", equations.compile_node(EQUATION, inputs, {"floor": 2.0}).alias("result"), F.round(value("geometric_mean", "quantity", "price"), 6).alias("geometric"), value("mean", "quantity", "price", "tax").alias("mean"))


@query("SELECT user_id, round(regr_slope(value, (epoch_us(ts) - 1700000000000000) / 3600e6), 6) AS slope FROM events GROUP BY user_id")
def series_slope(spark, sf_dir):
    hours = (micros("ts") - 1700000000000000) / 3600e6
    return equations.slope(read(spark, sf_dir, "events"), "user_id", "value", hours).select("user_id", F.round("slope", 6).alias("slope"))


@query("""
WITH p AS (SELECT user_id, greatest(value - 50, 0) AS e, epoch_us(ts) / 3600e6 AS t, lag(greatest(value - 50, 0)) OVER w AS pe, lag(epoch_us(ts) / 3600e6) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(coalesce(sum((e + pe) / 2 * (t - pt)), 0), 4) AS integral FROM p GROUP BY user_id""")
def series_integral(spark, sf_dir):
    out = equations.integral_positive_excess(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", micros("ts") / 3600e6, 50.0)
    return out.select("user_id", F.round("integral", 4).alias("integral"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (user_id, event_type)")
def status_rollup(spark, sf_dir):
    return read(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH r AS (SELECT 'obs_' || event_id AS ref FROM events UNION ALL SELECT 'calc_' || o_orderkey FROM orders)
SELECT ref FROM r WHERE NOT (ref LIKE 'obs\\_%' ESCAPE '\\' AND TRY_CAST(substr(ref, 5) AS BIGINT) IN (SELECT event_id FROM events WHERE value < 60))""")
def orphan_references(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    obs = events.select(F.concat(F.lit("obs_"), F.col("event_id").cast("string")).alias("ref"), "value")
    refs = obs.select("ref").unionByName(read(spark, sf_dir, "orders").select(F.concat(F.lit("calc_"), F.col("o_orderkey").cast("string")).alias("ref")))
    return state.orphans(refs, "ref", {"obs": obs.where("value < 60").select("ref")})


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_orderstatus = 'F') AS any_final FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'WAIT' WHEN all_large AND any_final THEN 'PASS' WHEN any_final THEN 'CHECK' ELSE 'BLOCKED' END AS level FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def readiness(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    level = F.when(F.col("n").isNull(), "WAIT").when(F.col("all_large") & F.col("any_final"), "PASS").when(F.col("any_final"), "CHECK").otherwise("BLOCKED")
    return c.join(orders, c.c_custkey == orders.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), level.alias("level"))
