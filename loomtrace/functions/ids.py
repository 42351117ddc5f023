"""Typed, time-sortable identifiers as Column expressions: `<prefix>_` and 26 base-32 letters, a 48-bit millisecond time before 80 bits of a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the base-32 letters, in order of value.
LETTERS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def base32(value: Column, letters: int) -> Column:
    """The lowest 5 bits times `letters` of a long, as plain concatenated letters that code generation handles."""
    letter = lambda i: F.substring(F.lit(LETTERS), (F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*(letter(i) for i in reversed(range(letters))))


def deterministic_id(prefix: str, seed: Column, timestamp_ms: Column) -> Column:
    """The id of a seed: its 80 bits are the first ten bytes of SHA-256 over prefix, a zero byte and the seed."""
    digest = F.sha2(F.concat(F.lit(prefix).cast("binary"), F.lit(b"\x00"), seed.cast("string").cast("binary")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("long")
    return F.concat(F.lit(f"{prefix}_"), base32(timestamp_ms.cast("long"), 10), base32(half(1), 8), base32(half(11), 8))


def id_timestamp_ms(domain_id: Column) -> Column:
    """The time in an id; null for what isn't one."""
    body = F.regexp_extract(domain_id, r"^[a-z][a-z0-9]*_([0-9A-HJKMNP-TV-Z]{26})\z", 1)
    value = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("long"), lambda acc, i: acc * 32 + _letter_value(body, i))
    return F.when(F.length(body) == 26, value)


def _letter_value(body: Column, i: Column) -> Column:
    return (F.call_function("instr", F.lit(LETTERS), F.substring(body, i, F.lit(1))) - 1).cast("long")


def is_domain_id(value: Column, prefix: str | None = None) -> Column:
    return value.rlike(rf"^{prefix or '[a-z][a-z0-9]*'}_[0-9A-HJKMNP-TV-Z]{{26}}\z")


def new_id(prefix: str) -> Column:
    """A new id for the present time; another one for each row and each run."""
    half = lambda: F.conv(F.substring(F.md5(F.expr("uuid()")), 1, 10), 16, 10).cast("long")
    return F.concat(F.lit(f"{prefix}_"), base32(F.unix_millis(F.current_timestamp()), 10), base32(half(), 8), base32(half(), 8))


def id_parts_error(timestamp_ms: Column, entropy: Column) -> Column:
    """What keeps a time and random bytes from making an id: a time beyond 48 bits, or other than ten bytes; null for none."""
    in_range = F.coalesce((timestamp_ms >= 0) & (timestamp_ms < F.lit(1 << 48)), F.lit(False))
    return F.when(~in_range, "timestamp").when(~F.coalesce(F.octet_length(entropy) == 10, F.lit(False)), "entropy")
