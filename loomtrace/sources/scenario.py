"""The simulated cold start: raw observations of an engine at rest, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.binary import be_hex, fixed_point
from loomtrace.functions.ids import deterministic_id

#: Fixed values of the scenario.
BASE_MS = 1_786_896_000_000
SECONDS = [0, 1, 2, 3, 5, 10, 30, 60, 120, 180, 240, 300, 420, 540, 660, 780, 900]
LABELS = [("key_on", 0, "Simulator state transition"), ("cranking", 2_000_000, "Simulator state transition"), ("engine_start", 5_000_000, "Simulator state transition"), ("warm_idle_end", 900_000_000, "Scenario boundary")]
SCENARIO, CHANNEL, VERSION = "sim.cold-start-idle", "sim.powertrain.v1", "1.0.0"


def state_at(second: Column) -> dict[str, Column]:
    """Engine speed, road speed, coolant and voltage at a second: off, cranking, then warming up towards idle."""
    running = F.greatest(second - 5, F.lit(0)).cast("double")
    phase = lambda off, crank, run: F.when(second < 2, F.lit(off)).when(second < 5, F.lit(crank)).otherwise(run)
    return {
        "rpm": phase(0.0, 260.0, 760.0 + 440.0 * F.exp(-running / 42.0)),
        "speed": F.lit(0.0),
        "coolant": 20.0 + 70.0 * (1.0 - F.exp(-running / 260.0)),
        "voltage": phase(12.6, 10.8, 14.15 - 0.15 * F.exp(-running / 60.0)),
    }


def encode_state(rpm: Column, speed: Column, coolant: Column, voltage: Column) -> Column:
    """Eight bytes as hex: big-endian 16-bit fixed-point values, the third signed."""
    return F.concat(be_hex(fixed_point(rpm, 4), 2), be_hex(fixed_point(speed, 10), 2), be_hex(fixed_point(coolant, 10), 2), be_hex(fixed_point(voltage, 1000), 2))


def wall_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def cold_start(spark: SparkSession) -> DataFrame:
    """The observations of the scenario, one row each. Session time zone must be UTC."""
    times = spark.createDataFrame(list(enumerate(SECONDS)), "sequence long, second int")
    ms = F.lit(BASE_MS) + F.col("second") * F.lit(1000).cast("long")
    vehicle = deterministic_id("veh", F.lit("simulator.vehicle.v1"), F.lit(BASE_MS))
    capture = deterministic_id("capture", F.lit(f"{SCENARIO}@{VERSION}"), F.lit(BASE_MS))
    rows = times.withColumns({"data": encode_state(**state_at(F.col("second"))), "vehicle_id": vehicle, "capture_id": capture})
    seed = F.concat_ws(":", "capture_id", F.col("sequence").cast("string"), "data")
    return rows.select(
        F.lit("raw.observation").alias("contract"),
        F.lit("1.0.0").alias("contract_version"),
        deterministic_id("obs", seed, ms).alias("observation_id"),
        "vehicle_id",
        "capture_id",
        "sequence",
        (F.col("second") * F.lit(1_000_000).cast("long")).alias("observed_at_monotonic_us"),
        wall_time(ms).alias("wall_time"),
        F.struct(F.lit("SIMULATOR").alias("kind"), F.lit("sim.powertrain-state").alias("source_id"), F.lit(CHANNEL).alias("channel"), F.lit(None).cast("int").alias("bus_index"), F.lit(None).cast("int").alias("arbitration_id"), F.lit(None).cast("boolean").alias("extended_id")).alias("source"),
        F.struct(F.lit("HEX").alias("encoding"), F.col("data"), F.sha2(F.unhex("data"), 256).alias("sha256")).alias("payload"),
        F.lit("GOOD").alias("quality"),
        F.struct(F.lit(VERSION).alias("source")).alias("versions"),
    )
