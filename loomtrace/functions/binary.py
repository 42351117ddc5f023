"""Integers in bytes, checksums, and text forms of numbers, as Column expressions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def be_unsigned(data: Column, at: int, size: int) -> Column:
    """Big-endian unsigned integer at a byte offset, exact up to 64 bits as decimal(20,0), else long."""
    value = F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10)
    return value.cast("decimal(20,0)" if size > 7 else "long")


def le_unsigned(data: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset."""
    value = F.conv(F.concat(*(F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(size)))), 16, 10)
    return value.cast("decimal(20,0)" if size > 7 else "long")


def signed(value: Column, bits: int) -> Column:
    """Two's complement of an unsigned value."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def be_hex(value: Column, size: int) -> Column:
    """An integer as lower-case hex of `size` bytes, negative ones in two's complement."""
    return F.lower(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0"))


def fixed_point(value: Column, factor: int) -> Column:
    """value times factor, halves to even."""
    return F.bround(value * factor, 0).cast("long")


@lru_cache(maxsize=1)
def crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


def crc32c(data: bytes) -> int:
    """CRC-32C; Spark's crc32 is the other polynomial."""
    table, crc = crc32c_table(), 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def crc32c_all(data: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings: a step of the table for all of them at once, the longest first."""
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    order = np.argsort(-sizes, kind="stable")
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    table, crc = np.array(crc32c_table(), dtype=np.uint32), np.full(len(data), 0xFFFFFFFF, dtype=np.uint32)
    left = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(data) else 0) + 1), side="right")
    for at, n in enumerate(left.tolist()):
        crc[:n] = crc[:n] >> np.uint32(8) ^ table[(crc[:n] ^ joined[starts[:n] + at]) & np.uint32(0xFF)]
    out = np.empty(len(data), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_of(data: Column | str) -> Column:
    """CRC-32C of a binary column."""

    def run(data: pd.Series) -> pd.Series:
        known = data.notna()
        out = pd.Series(pd.NA, index=data.index, dtype="Int64")
        out[known] = crc32c_all([bytes(x) for x in data[known]])
        return out

    return F.pandas_udf(run, T.LongType())(data)


def version_parts(version: Column) -> Column:
    """The digits that begin each part between dots, as whole numbers; empty parts are passed over, parts without a digit count 0."""
    parts = F.filter(F.split(version, r"\."), lambda p: p != "")
    digits = lambda p: F.regexp_extract(p, "^([0-9]+)", 1)
    most = F.lit("9" * 38).cast("decimal(38,0)")
    return F.transform(parts, lambda p: F.when(digits(p) == "", F.lit(0).cast("decimal(38,0)")).otherwise(F.coalesce(digits(p).try_cast("decimal(38,0)"), most)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing parts count 0; null if one of them is null."""
    pa, pb = version_parts(a), version_parts(b)
    signs = F.zip_with(pa, pb, lambda x, y: F.when(F.coalesce(x, F.lit(0)) > F.coalesce(y, F.lit(0)), 1).when(F.coalesce(x, F.lit(0)) < F.coalesce(y, F.lit(0)), -1).otherwise(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0)))


def byte_text(n: Column) -> Column:
    """A number of bytes for people: B, KiB or MiB with one decimal."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024)).when(n.isNotNull(), F.format_string("%.1f MiB", n / (1 << 20)))


def millivolt_text(mv: Column) -> Column:
    return F.when(mv.isNotNull(), F.format_string("%.2f V", mv / 1000.0))
