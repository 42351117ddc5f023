"""Queries over aligned inputs, staged equations, calculation runs and overlapping ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import ids
from loomtrace.operators import alignment, json_schema, ranges, series
from loomtrace.plans import runs, stages
from loomtrace.plans.catalogue import micros, query, read


def call(operator: str, *arguments: dict) -> dict:
    return {"kind": "operation", "operator": operator, "arguments": list(arguments)}


def given(name: str) -> dict:
    return {"kind": "input", "name": name}


def literal(value: float) -> dict:
    return {"kind": "literal", "value": value}


#: Of each purchase: the last click, view and error of the user that are fresh and good enough.
INPUTS = [alignment.Input("clicked", "click", 2 * 86_400_000, ("GOOD",)), alignment.Input("viewed", "view", 8 * 3_600_000, ("GOOD", "SUSPECT")), alignment.Input("failed", "error", 5 * 86_400_000, ("SUSPECT", "GOOD", "INVALID"))]


def event_samples(events):
    """Events as samples: the type is the signal, and the value decides the quality."""
    quality = F.when(F.col("value") < 150, "GOOD").when(F.col("value") < 350, "SUSPECT").otherwise("INVALID")
    return events.select("user_id", micros("ts").alias("at"), F.col("event_type").alias("signal_id"), "value", quality.alias("quality"), F.col("event_id").alias("evidence_ref"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type, value, event_id, CASE WHEN value < 150 THEN 'GOOD' WHEN value < 350 THEN 'SUSPECT' ELSE 'INVALID' END AS quality FROM events),
p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click' AND quality = 'GOOD'), v AS (SELECT * FROM e WHERE event_type = 'view' AND quality IN ('GOOD', 'SUSPECT')), f AS (SELECT * FROM e WHERE event_type = 'error'),
a AS (SELECT p.event_id, p.us, c.value AS c_value, c.us AS c_us, c.event_id AS c_ref, v.value AS v_value, v.us AS v_us, v.event_id AS v_ref, f.value AS f_value, f.us AS f_us, f.event_id AS f_ref, f.quality AS f_quality
  FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.us ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.us >= f.us)
SELECT event_id, CASE WHEN us - c_us <= 172800000000 THEN c_value END AS clicked, CASE WHEN us - c_us <= 172800000000 THEN (us - c_us) // 1000 END AS clicked_age_ms, CASE WHEN us - c_us <= 172800000000 THEN c_ref END AS clicked_ref,
  CASE WHEN us - v_us <= 28800000000 THEN v_value END AS viewed, CASE WHEN us - v_us <= 28800000000 THEN (us - v_us) // 1000 END AS viewed_age_ms, CASE WHEN us - v_us <= 28800000000 THEN v_ref END AS viewed_ref,
  CASE WHEN us - f_us <= 432000000000 THEN f_value END AS failed, CASE WHEN us - f_us <= 432000000000 THEN f_quality END AS failed_quality FROM a""")
def aligned_inputs(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    asked = events.where("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("at"))
    rows = alignment.aligned(asked, event_samples(events), "user_id", "at", INPUTS, "evidence_ref")
    return rows.select("event_id", F.col("clicked.value").alias("clicked"), F.col("clicked.age_ms").alias("clicked_age_ms"), F.col("clicked.evidence_ref").alias("clicked_ref"), F.col("viewed.value").alias("viewed"), F.col("viewed.age_ms").alias("viewed_age_ms"), F.col("viewed.evidence_ref").alias("viewed_ref"), F.col("failed.value").alias("failed"), F.col("failed.quality").alias("failed_quality"))


#: What a user's values rise by in a day, and how far a value lies above that line, as an area over 60.
RISE = call("slope", given("value"))
LEVELLED = call("subtract", given("value"), call("multiply", RISE, given("days")))
EXCESS = call("integral_positive_excess", LEVELLED, literal(60))
SCORE = call("divide", EXCESS, call("max", literal(1), call("abs", RISE)))
NESTED_SQL = """
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 86400e6 - 19700 AS t FROM events),
s AS (SELECT *, regr_slope(value, t) OVER (PARTITION BY user_id) AS rise FROM e),
l AS (SELECT *, greatest(value - rise * t - 60, 0) AS above FROM s),
p AS (SELECT *, (above + lag(above) OVER w) / 2 * (t - lag(t) OVER w) AS area FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
"""


def event_series(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value", (micros("ts") / 86400e6 - 19700).alias("t"))
    return rows, {"value": F.col("value"), "days": F.col("t")}


@query(NESTED_SQL + "SELECT user_id, round(any_value(rise), 6) AS rise, round(coalesce(sum(area), 0), 4) AS excess, round(coalesce(sum(area), 0) / greatest(1, abs(any_value(rise))), 4) AS score FROM p GROUP BY user_id")
def nested_series(spark, sf_dir):
    rows, inputs = event_series(spark, sf_dir)
    out = stages.evaluated(rows, {"rise": RISE, "excess": EXCESS, "score": SCORE}, inputs, {}, ["user_id"], ["t", "event_id"], F.col("t"), per_key=True)
    return out.select("user_id", F.round("rise", 6).alias("rise"), F.round("excess", 4).alias("excess"), F.round("score", 4).alias("score"))


@query(NESTED_SQL + """, x AS (SELECT *, coalesce(sum(area) OVER (PARTITION BY user_id), 0) / greatest(1, abs(rise)) AS score FROM p)
SELECT event_id, round(value - rise * t, 6) AS levelled, round((value - rise * t) / greatest(1, score), 6) AS relative FROM x""")
def series_by_row(spark, sf_dir):
    rows, inputs = event_series(spark, sf_dir)
    trees = {"levelled": LEVELLED, "relative": call("divide", LEVELLED, call("max", literal(1), SCORE))}
    out = stages.evaluated(rows, trees, inputs, {}, ["user_id"], ["t", "event_id"], F.col("t"))
    return out.select("event_id", F.round("levelled", 6).alias("levelled"), F.round("relative", 6).alias("relative"))


@query("""
WITH r AS (SELECT s_suppkey, s_suppkey * 70 AS lo, s_suppkey * 70 + CASE WHEN s_suppkey % 50 = 0 THEN 1000000 ELSE s_suppkey % 9 END AS hi FROM supplier),
p AS (SELECT p_partkey, p_partkey * 13 AS lo, p_partkey * 13 + p_size % 7 AS hi FROM part)
SELECT p_partkey, s_suppkey FROM p JOIN r ON p.lo < r.hi AND p.hi > r.lo""")
def range_pairs(spark, sf_dir):
    start = F.col("s_suppkey") * 70
    held = read(spark, sf_dir, "supplier").select("s_suppkey", start.alias("start"), (start + F.when(F.col("s_suppkey") % 50 == 0, 1_000_000).otherwise(F.col("s_suppkey") % 9)).alias("end"))
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 13).alias("start"), (F.col("p_partkey") * 13 + F.col("p_size") % 7).alias("end"))
    return ranges.overlap_pairs(parts, held).select("left.p_partkey", "right.s_suppkey")


#: A record that no contract of the library names: references, alternatives, conditions and closed objects.
ORDER_SCHEMA = {
    "$id": "urn:orders/record",
    "$defs": {"key": {"type": "integer", "minimum": 0}, "money": {"type": "number", "minimum": 900, "maximum": 450000}, "day": {"type": "string", "pattern": "^199[3-9]-[0-9]{2}-[0-9]{2}$"}},
    "type": "object",
    "additionalProperties": False,
    "required": ["contract", "order", "customer", "status", "total"],
    "properties": {
        "contract": {"const": "order.record"},
        "order": {"$ref": "#/$defs/key"},
        "customer": {"oneOf": [{"$ref": "#/$defs/key"}, {"type": "string", "pattern": "^c[0-9]+$"}]},
        "status": {"enum": ["O", "F", "P"]},
        "total": {"$ref": "#/$defs/money"},
        "urgency": {"type": "string", "pattern": "^[1-3]-"},
        "days": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/day"}},
        "notes": {"type": "object", "additionalProperties": {"type": "string", "maxLength": 4}},
    },
    "allOf": [{"if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["days"], "properties": {"total": {"maximum": 400000}}}, "else": {"properties": {"urgency": {"not": {"const": "2-HIGH"}}}}}],
}


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS u, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate) AS y FROM orders)
SELECT k, 'total' AS path, 'maximum' AS rule FROM o WHERE t > 450000 OR s = 'F' AND t > 400000
UNION ALL SELECT k, 'total', 'minimum' FROM o WHERE t < 900
UNION ALL SELECT k, 'urgency', 'pattern' FROM o WHERE u[1] NOT IN ('1', '2', '3')
UNION ALL SELECT k, 'urgency', 'not' FROM o WHERE s <> 'F' AND u = '2-HIGH'
UNION ALL SELECT k, '<root>', 'required:days' FROM o WHERE s = 'F' AND c % 5 = 0
UNION ALL SELECT k, 'customer', 'oneOf' FROM o WHERE c % 4 = 3
UNION ALL SELECT k, 'days.0', 'pattern' FROM o WHERE c % 5 <> 0 AND y NOT BETWEEN 1993 AND 1999
UNION ALL SELECT k, 'days', 'uniqueItems' FROM o WHERE c % 5 = 1
UNION ALL SELECT k, 'days.1', 'pattern' FROM o WHERE c % 5 = 1 AND y NOT BETWEEN 1993 AND 1999
UNION ALL SELECT k, 'notes.priority', 'maxLength' FROM o WHERE length(u) > 6
UNION ALL SELECT k, '<root>', 'additionalProperties' FROM o WHERE k % 10 = 0""")
def order_documents(spark, sf_dir):
    """An order as a JSON document, its faults decided by its values, under a schema document."""
    c, day = F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    customer = F.when(c % 4 == 3, F.concat(F.lit('"x'), c, F.lit('"'))).when(c % 4 == 2, F.concat(F.lit('"c'), c, F.lit('"'))).otherwise(c.cast("string"))
    rest = F.to_json(
        F.struct(
            F.lit("order.record").alias("contract"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("urgency"),
            F.when(c % 5 == 1, F.array(day, day)).when(c % 5 != 0, F.array(day)).alias("days"),
            F.create_map(F.lit("priority"), F.when(F.length("o_orderpriority") > 6, F.col("o_orderpriority")).otherwise("low")).alias("notes"), F.when(F.col("o_orderkey") % 10 == 0, 1).alias("other"),
        )
    )
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit('{"customer":'), customer, F.lit(","), F.substr(rest, F.lit(2))).alias("doc"))
    return json_schema.schema_errors(docs, "doc", "k", catalog=json_schema.Catalog({ORDER_SCHEMA["$id"]: ORDER_SCHEMA})).select("k", "path", "rule")


def definition(equation_id: str, ast: dict, inputs: dict[str, tuple[str, int, list[str]]], unit: str, validation: str = "VEHICLE_VALIDATED", constants: dict[str, float] | None = None, **bounds: float) -> dict:
    """A definition document; inputs are (unit, maximum age, accepted qualities) by name."""
    return {
        "equation_id": equation_id, "version": "1.0.0", "expression": {"ast": ast}, "inputs": [{"name": n, "unit": u, "maximum_age_ms": a, "accepted_quality": q} for n, (u, a, q) in inputs.items()],
        "constants": [{"name": n, "value": v} for n, v in (constants or {}).items()], "output": {"unit": unit, "truth_boundary": "ESTIMATED"} | bounds,
        "confidence_model": {"factors": ["SOURCE_QUALITY", "FRESHNESS", "COVERAGE", "MODEL_VALIDATION"]}, "validation_status": validation,
    }


ALL = ["GOOD", "SENSOR_UNVERIFIED", "STALE"]
#: Three equations that feed each other, handed in out of order, and one that feeds itself.
REGISTRY = [
    runs.Equation(definition("order.per_unit", call("divide", given("taxed"), given("quantity")), {"taxed": ("usd", 900, ["GOOD", "SENSOR_UNVERIFIED"]), "quantity": ("1", 700, ALL)}, "usd", maximum=2500.0), {"taxed": "order.taxed"}),
    runs.Equation(definition("order.loop", call("add", given("loop"), literal(1)), {"loop": ("1", 1, ["GOOD"])}, "1"), {"loop": "order.loop"}),
    runs.Equation(definition("order.taxed", call("multiply", given("net"), call("add", {"kind": "constant", "name": "one"}, given("tax"))), {"net": ("usd", 800, ALL), "tax": ("1", 1000, ALL)}, "usd", "CALIBRATED", {"one": 1.0}), {"net": "order.net"}),
    runs.Equation(definition("order.net", call("multiply", given("price"), call("subtract", literal(1), given("discount"))), {"price": ("usd", 950, ALL), "discount": ("1", 1000, ["GOOD", "STALE"])}, "usd")),
]


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity AS quantity, l_partkey % 1000 AS price_age, l_suppkey % 1000 AS discount_age, l_orderkey % 1000 AS tax_age, (l_partkey + l_suppkey) % 1000 AS quantity_age,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS price_rank, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS discount_rank FROM lineitem),
n AS (SELECT *, CASE WHEN price_age <= 950 AND discount_age <= 1000 AND discount_rank = 1 THEN price * (1 - discount) END AS net, greatest(price_age, discount_age) AS net_age, greatest(price_rank, discount_rank) AS net_rank FROM l),
t AS (SELECT *, CASE WHEN net IS NOT NULL AND net_age <= 800 AND tax_age <= 1000 THEN net * (1 + tax) END AS taxed, greatest(net_age, tax_age) AS taxed_age FROM n),
u AS (SELECT *, CASE WHEN taxed IS NOT NULL AND taxed_age <= 900 AND net_rank < 3 AND quantity_age <= 700 THEN taxed / quantity END AS per_unit FROM t),
w AS (SELECT *, [1.0, 0.6, 0.3][net_rank] AS net_worth FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, 'order.net' AS equation_id, CASE WHEN net IS NULL THEN 'UNAVAILABLE' ELSE 'CALCULATED' END AS status, net AS value, CASE WHEN net IS NOT NULL THEN least(net_worth, 1 - price_age / 950, 1 - discount_age / 1000, 0.75) END AS confidence, (CASE WHEN price_age <= 950 THEN 0 ELSE 1 END + CASE WHEN discount_age <= 1000 AND discount_rank = 1 THEN 0 ELSE 1 END)::INT AS reasons FROM w
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'order.taxed', CASE WHEN taxed IS NULL THEN 'UNAVAILABLE' ELSE 'CALCULATED' END, taxed, CASE WHEN taxed IS NOT NULL THEN least(net_worth, 1 - net_age / 800, 1 - tax_age / 1000) END, CASE WHEN taxed IS NULL THEN 1 ELSE 0 END FROM w
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'order.per_unit', CASE WHEN per_unit IS NULL THEN 'UNAVAILABLE' WHEN per_unit > 2500 THEN 'OUT_OF_RANGE' ELSE 'CALCULATED' END, CASE WHEN per_unit <= 2500 THEN per_unit END, CASE WHEN per_unit <= 2500 THEN least(net_worth, 1 - taxed_age / 900, 1 - quantity_age / 700, 0.75) END,
  (CASE WHEN taxed IS NOT NULL AND taxed_age <= 900 AND net_rank < 3 THEN 0 ELSE 1 END + CASE WHEN quantity_age <= 700 THEN 0 ELSE 1 END + CASE WHEN per_unit > 2500 THEN 1 ELSE 0 END)::INT FROM w
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'order.loop', 'UNAVAILABLE', NULL, NULL, 1 FROM l""")
def calculation_runs(spark, sf_dir):
    """Columns of lineitem as inputs: keys decide their ages, flags their qualities."""
    found = runs.runs(line_inputs(read(spark, sf_dir, "lineitem"), evidence=False), REGISTRY, ["l_orderkey", "l_linenumber", "l_partkey"], "at_ms", ("equation_id", "status", "reasons", "value", "confidence"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "run.equation_id", "run.status", "run.value", "run.confidence", F.size("run.reasons").alias("reasons"))


def line_inputs(lines, evidence: bool = True):
    quality = F.when(F.col("l_returnflag") == "A", "GOOD").when(F.col("l_returnflag") == "R", "SENSOR_UNVERIFIED").otherwise("STALE")
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    ref = lambda value: ids.deterministic_id("sample", F.concat_ws("|", F.lit(value), "l_orderkey", "l_linenumber", "l_partkey"), at) if evidence else F.lit(None).cast("string")
    one = lambda value, age, q: F.struct(F.col(value).alias("value"), (age % 1000).alias("age_ms"), q.alias("quality"), ref(value).alias("evidence_ref"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", at.alias("at_ms"),
        one("l_extendedprice", F.col("l_partkey"), quality).alias("price"), one("l_discount", F.col("l_suppkey"), F.when(F.col("l_linestatus") == "O", "GOOD").otherwise("SENSOR_UNVERIFIED")).alias("discount"),
        one("l_tax", F.col("l_orderkey"), F.lit("GOOD")).alias("tax"), one("l_quantity", F.col("l_partkey") + F.col("l_suppkey"), F.lit("GOOD")).alias("quantity"),
    )


DAY = 86_400_000_000


@query(f"""
SELECT user_id, (epoch_us(ts) // {DAY})::BIGINT AS bucket, count(*) AS n, min(value) AS least, max(value) AS most, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
GROUP BY ALL""".replace("arg_min(value, event_id)", "arg_min(value, k)").replace("arg_max(value, event_id)", "arg_max(value, k)"))
def series_buckets(spark, sf_dir):
    return series.buckets(event_points(spark, sf_dir), "user_id", "at", "event_id", "value", DAY).drop("mean", "mean_at")


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value AS v, epoch_us(ts) // {DAY} AS b FROM events),
m AS (SELECT user_id, b, avg(v) AS v, avg(t) AS t FROM e GROUP BY ALL),
w AS (SELECT user_id, b, coalesce(lag(v) OVER w, v) AS pv, coalesce(lag(t) OVER w, t) AS pt, coalesce(lead(v) OVER w, v) AS nv, coalesce(lead(t) OVER w, t) AS nt FROM m WINDOW w AS (PARTITION BY user_id ORDER BY b))
SELECT user_id, b::BIGINT AS bucket, arg_max(event_id, {{a: round(abs((pt - nt) * (v - pv) - (pt - t) * (nv - pv)) / 1e6, 1), t: t, i: event_id}}) AS event_id FROM e JOIN w USING (user_id, b) GROUP BY ALL""")
def series_points(spark, sf_dir):
    return series.telling_points(event_points(spark, sf_dir), "user_id", "at", "event_id", "value", DAY).select("user_id", "bucket", "event_id")


def event_points(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("at"), "value")


@query("""
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN pv IS NULL OR abs(value - pv) > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM p)
SELECT user_id, run::BIGINT AS run, count(*) AS n, min(t) AS start, max(t) AS "end", min(value) AS least, max(value) AS most FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
def stuck_runs(spark, sf_dir):
    return series.stuck_runs(event_points(spark, sf_dir), "user_id", "at", "event_id", "value", tolerance=40, least_rows=3)
