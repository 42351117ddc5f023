"""Update packages and published releases: binary containers and their manifests, read with checks.

A package is a 16-byte big-endian header (magic, format version, three lengths), a JSON manifest, the image
and a signature. Signatures themselves are out of scope: no library here can check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.binary import be_hex, be_unsigned
from loomtrace.operators.gateway import first_of, yes

# Fixed values of the format.
MAGIC, FORMAT, HEADER = "VHUP", 1, 16
MANIFEST = (
    "contract string, contract_version string, package_id string, release_channel string, created_at string, firmware_version string, firmware_build_id string, firmware_sha256 string, "
    "firmware_size_bytes long, supported_hardware_revisions array<string>, minimum_bootloader_version string, minimum_supply_millivolts long, required_capabilities array<string>"
)
RELEASE = (
    "schemaVersion string, chipFamily string, release string, hardwareFamily string, files array<struct<url: string, label: string, address: long, byteCount: long, sha256: string>>, "
    "segments array<struct<label: string, address: long, byteCount: long>>, protectedRanges array<struct<label: string, address: long, byteCount: long>>"
)
RELEASE_VERSIONS = ("1.0.0", "1.1.0")
#: A manifest holds these, null in none.
NEEDED = ("contract", "contract_version", "package_id", "release_channel", "created_at", "firmware_version", "firmware_build_id", "firmware_sha256", "firmware_size_bytes", "supported_hardware_revisions", "minimum_supply_millivolts", "required_capabilities")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of path and content, from any file system that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def key_bytes(text: Column) -> Column:
    """A public key of 32 bytes, written as 64 hex digits or in base64; null for anything else."""
    compact = F.trim(text)
    raw = F.when(compact.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(compact)).otherwise(F.try_to_binary(compact, F.lit("base64")))
    return F.when(F.octet_length(raw) == 32, raw)


def decoded(packages: DataFrame, content: str = "content") -> DataFrame:
    """Packages with format_version, manifest_json, manifest, firmware and signature; null where the header does not allow them."""
    data = F.col(content)
    whole = packages.withColumns({"format_version": be_unsigned(data, 4, 2), "__m": be_unsigned(data, 6, 4), "__f": be_unsigned(data, 10, 4), "__s": be_unsigned(data, 14, 2)})
    fits = (F.octet_length(data) == HEADER + F.col("__m") + F.col("__f") + F.col("__s")) & (F.col("__m") > 0) & (F.col("__f") > 0) & (F.col("__s") > 0)
    part = lambda start, n: F.when(yes(fits), F.substring(data, (start + 1).cast("int"), n.cast("int")))
    m, f, s = F.col("__m"), F.col("__f"), F.col("__s")
    parts = whole.withColumns({"manifest_json": part(F.lit(HEADER), m), "firmware": part(HEADER + m, f), "signature": part(HEADER + m + f, s)})
    parsed = F.from_json(F.col("manifest_json").cast("string"), MANIFEST, {"mode": "PERMISSIVE"})
    return parts.withColumn("manifest", parsed).drop("__m", "__f", "__s")


def package_error(content: str = "content", key: str | None = None) -> Column:
    """The first fault of a decoded package, as a code; null for one that is right up to its signature."""
    data = F.col(content)
    checks = [
        (F.octet_length(data) >= HEADER, "incomplete_header"),
        (F.substring(data, 1, 4) == F.lit(MAGIC).cast("binary"), "invalid_magic"),
        (F.col("format_version") == FORMAT, F.concat(F.lit("unsupported_format:"), F.col("format_version").cast("string"))),
        (F.col("signature").isNotNull(), "invalid_length"),
        (F.forall(F.array(*(F.col(f"manifest.{c}").isNotNull() for c in NEEDED)), lambda x: x), "manifest_unreadable"),
        ((F.col("manifest.contract") == "firmware.manifest") & (F.col("manifest.contract_version") == "1.0.0"), "invalid_contract"),
        (F.col("manifest.firmware_size_bytes") == F.octet_length("firmware"), "size_mismatch"),
        (F.lower("manifest.firmware_sha256") == F.sha2("firmware", 256), "hash_mismatch"),
    ]
    if key:
        checks.append((F.octet_length(key) == 32, "invalid_public_key"))
    return first_of(*checks)


def encoded(manifest_json: Column, firmware: Column, signature: Column) -> Column:
    """A package as bytes, the way `decoded` reads it."""
    sizes = [be_hex(F.octet_length(x).cast("long"), n) for x, n in ((manifest_json, 4), (firmware, 4), (signature, 2))]
    head = F.unhex(F.concat(F.hex(F.lit(MAGIC).cast("binary")), be_hex(F.lit(FORMAT), 2), *sizes))
    return F.concat(head, manifest_json.cast("binary"), firmware, signature)


def signing_digest(manifest_json: Column, firmware: Column) -> Column:
    """What a release signs: SHA-256 over manifest and image, as hex."""
    return F.sha2(F.concat(manifest_json.cast("binary"), firmware), 256)


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """Published release manifests, one JSON document a file."""
    return spark.read.schema(RELEASE).json(path, multiLine=True)


def release_error(family: str) -> Column:
    """The first fault of a release for a chip family: its version and target, then its flash ranges in order.

    A range needs a start of 0 or more and at least one byte, and may not touch a protected one; half-open.
    """
    end = lambda r: r["address"] + r["byteCount"]
    protected = F.coalesce("protectedRanges", F.array().cast("array<struct<label: string, address: long, byteCount: long>>"))

    def segment(s: Column) -> Column:
        hit = F.get(F.filter(protected, lambda p: (s["address"] < end(p)) & (end(s) > p["address"])), F.lit(0))
        valid = yes(s["address"] >= 0) & yes(s["byteCount"] > 0)
        return F.when(~valid, F.concat(F.lit("invalid_range:"), s["label"])).when(hit.isNotNull(), F.concat_ws(":", F.lit("overlaps"), s["label"], hit["label"]))

    target = first_of((F.col("schemaVersion").isin(*RELEASE_VERSIONS) & (F.col("chipFamily") == family), "unsupported_target"))
    return F.coalesce(target, F.get(F.filter(F.transform("segments", segment), lambda e: e.isNotNull()), F.lit(0)))


def artifact_errors(published: DataFrame, files: DataFrame) -> DataFrame:
    """published (path, label, byte_count, sha256) with `error` by the files that were fetched: missing, length_mismatch, or hash_mismatch where a hash is given.

    Joined by path; the content stays with its hash and length worked out below the join.
    """
    got = files.select("path", F.octet_length("content").cast("long").alias("got_bytes"), F.sha2("content", 256).alias("got_sha256"))
    joined = published.join(got, "path", "left")
    error = first_of((F.col("got_bytes").isNotNull(), "missing"), (F.col("got_bytes") == F.col("byte_count"), "length_mismatch"), (F.col("sha256").isNull() | (F.col("got_sha256") == F.lower("sha256")), "hash_mismatch"))
    return joined.withColumn("error", error)


def recovery_fits(backup_bytes: Column, flash_bytes: Column) -> Column:
    """A backup may be written back only if it is as long as the flash."""
    return yes(backup_bytes == flash_bytes)
