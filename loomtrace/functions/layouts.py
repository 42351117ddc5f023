"""Signals in raw payloads by declared layouts: integers, IEEE 754 numbers and bit fields.

The contract leaves bit numbers open. Ours: bits are counted from the lowest bit of the integer that the
layout's bytes make in their byte order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.binary import be_unsigned, le_unsigned


def exactly(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def quotient(a: Column, n: int) -> Column:
    """a over n without the rest; a plain division would round to a few decimals first."""
    return ((a - a % exactly(n)) / exactly(n)).cast("decimal(38,0)")


def float_of(bits: Column, size: int) -> Column:
    """The IEEE 754 number of 4 or 8 bytes given as an unsigned integer; null for infinities and no-numbers.

    Worked out from sign, exponent and fraction, so that it stays a column expression. The sign of zero is lost.
    """
    exponent_bits, fraction_bits = (8, 23) if size == 4 else (11, 52)
    bits = bits.cast("decimal(38,0)")
    top = quotient(bits, 1 << fraction_bits).cast("long")
    fraction = (bits - top.cast("decimal(38,0)") * exactly(1 << fraction_bits)).cast("double") / float(1 << fraction_bits)
    exponent = top.bitwiseAND(F.lit((1 << exponent_bits) - 1))
    bias = (1 << (exponent_bits - 1)) - 1
    size_of = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(float(1 - bias)))).otherwise((1 + fraction) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    return F.when(exponent < (1 << exponent_bits) - 1, F.when(top >= 1 << exponent_bits, -size_of).otherwise(size_of))


def raw_value(payload: Column, layout: dict) -> Column:
    """The number that a layout finds in a payload, as a double; null where the payload is too short.

    layout: encoding INTEGER, IEEE754 or BIT_FIELD, byte_offset, byte_length 1 to 8, endianness, signed, and
    for bit fields bit_offset and bit_length.
    """
    at, size = layout["byte_offset"], layout["byte_length"]
    whole = (be_unsigned if layout["endianness"] == "BIG" else le_unsigned)(payload, at, size).cast("decimal(38,0)")
    match layout["encoding"]:
        case "IEEE754":
            if size not in (4, 8):
                raise ValueError("IEEE 754 numbers have 4 or 8 bytes")
            value, bits = float_of(whole, size), 0
        case "BIT_FIELD":
            first, bits = layout["bit_offset"], layout["bit_length"]
            if first + bits > 8 * size:
                raise ValueError("bit field beyond its bytes")
            value = quotient(whole, 1 << first) % exactly(1 << bits)
        case "INTEGER":
            value, bits = whole, 8 * size
        case other:
            raise ValueError(f"unknown encoding: {other}")
    if bits and layout["signed"]:
        value = F.when(value >= exactly(1 << (bits - 1)), value - exactly(1 << bits)).otherwise(value)
    return F.when(F.octet_length(payload) >= at + size, value.cast("double"))


def quality_of(value: Column, age_ms: Column, plausible: tuple[float, float], stale_after_ms: int) -> Column:
    """MISSING, STALE, OUT_OF_RANGE or GOOD: what a sample's value and age allow."""
    return F.when(value.isNull(), "MISSING").when(age_ms > stale_after_ms, "STALE").when(~value.between(*plausible), "OUT_OF_RANGE").otherwise("GOOD")


def decoded_signals(observations: DataFrame, definitions: list[dict], payload: Column, kind: Column, source_id: Column, age_ms: Column) -> DataFrame:
    """Observations with a row for each definition of their source: signal_id, unit, value (transformed) and quality.

    Definitions are a registry of bounded size; each becomes a column expression, so nothing is joined or
    shuffled, and an observation costs only what its own source's definitions need.
    """
    from loomtrace.plans.equations import compile_node

    rows = []
    for d in definitions:
        raw = raw_value(payload, d["raw_layout"])
        value = compile_node(d["transform"]["ast"], {"raw": raw}, {})
        bounds = d["plausible_range"]
        quality = quality_of(value, age_ms, (bounds["minimum"], bounds["maximum"]), d["cadence"]["stale_after_ms"])
        row = F.struct(F.lit(d["signal_id"]).alias("signal_id"), F.lit(d["canonical_unit"]).alias("unit"), value.alias("value"), quality.alias("quality"))
        rows.append(F.when((kind == d["source"]["kind"]) & (source_id == d["source"]["source_id"]), row))
    found = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return observations.withColumn("signal", F.explode(found)).select(*observations.columns, "signal.*")
