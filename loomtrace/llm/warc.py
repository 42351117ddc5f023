"""WARC archives: writing with duplicates as revisits, and a sequential reader.

Each record is a gzip member of its own. The reader walks an archive once, decompresses piece by piece,
frames records by Content-Length and checks block and payload digests, so its memory is bounded by one
piece and one record header, whatever the sizes of archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, saved, shared_dir, table, text_of

PIECE = 1 << 16
ARCHIVE_BYTES = 64 << 20
#: Bytes of a record's head beside its url; a reader that isn't told the longest head allows this and a megabyte.
HEAD = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_member(name: object, url: str, payload: bytes, refers_to: object | None) -> bytes:
    """A response, or for a payload that the record refers_to already holds, a revisit: the HTTP head alone. Records are named urn:page:<name>."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "urn:page:none").split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    return member(headers, block)


class Stream:
    """Bytes of the current gzip member, decompressed as they are asked for."""

    def __init__(self, source):
        self.source, self.raw, self.out, self.z = source, b"", b"", None

    def start(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        self.raw = self.raw or self.source.read(PIECE)
        self.z, self.out = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress at most one piece more; False at the end of the member."""
        while not self.z.eof:
            self.raw = self.raw or self.source.read(PIECE)
            if not self.raw:
                raise ValueError("archive ends inside a gzip member")
            got = self.z.decompress(self.raw, PIECE)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if len(self.out) > most or not self.more():
                raise ValueError("record head without an end")
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise ValueError("record is shorter than its Content-Length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            yield got


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_archive(source, keep_payload: bool = False, most: int = HEAD + (1 << 20)) -> Iterator[dict]:
    """Records of an archive, given as a file object, in order, heads of some `most` bytes at most. Raises ValueError on broken framing or a wrong digest."""
    s = Stream(source)
    while s.start():
        head = fields(s.until(b"\r\n\r\n", most))
        left = int(head["content-length"])
        kind, block, payload, kept = head["warc-type"], hashlib.sha1(), hashlib.sha1(), []
        http: dict[str, str] = {}
        if kind in ("response", "revisit"):
            top = s.until(b"\r\n\r\n", most)
            http = fields(top)
            block.update(top + b"\r\n\r\n")
            left -= len(top) + 4
        length = left
        if left < 0:
            raise ValueError("HTTP head is longer than the record")
        for part in s.exactly(left):
            block.update(part)
            payload.update(part)
            if keep_payload:
                kept.append(part)
        if b"".join(s.exactly(4)) != b"\r\n\r\n" or s.out or s.more():
            raise ValueError("record is longer than its Content-Length")
        said = lambda name: head.get(name, "").removeprefix("sha1:")
        if "warc-block-digest" in head and said("warc-block-digest") != base64.b32encode(block.digest()).decode():
            raise ValueError(f"wrong block digest in {head.get('warc-record-id')}")
        if kind == "response" and said("warc-payload-digest") != base64.b32encode(payload.digest()).decode():
            raise ValueError(f"wrong payload digest in {head.get('warc-record-id')}")
        yield {
            "record_type": kind,
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "uri": head.get("warc-target-uri"),
            "payload_bytes": int(http["content-length"]) if kind == "revisit" else length,
            "payload_digest": said("warc-payload-digest") or None,
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload": b"".join(kept) if keep_payload and kind != "revisit" else None,
        }


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row into archives in `folder` and return their list: path, n_records, n_bytes, head_bytes (none of its heads is longer).

    Null html is an empty payload; null urls get a placeholder. Of rows with equal payloads of at least
    `least_bytes` bytes one of the smallest page id is the response and the others revisit it, further rows
    of that id too. Rows with a null page id revisit a row with an id; without one each is a response. A
    record is named by its row and page id (urn:page:<row>:<id>), so repeated ids have records of their
    own. Other columns are ignored. An empty table gives no archive.

    Each task writes archives under names of its own, and only those of tasks that ended well are listed,
    so a task that is run again leaves at most files that nobody reads. The list is written once.
    """
    rows = pages.select(named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), text_of(text_col).alias("html"))
    # Written once, so that a row keeps its number.
    rows = saved(rows.withColumns({"row": F.monotonically_increasing_id(), "content": F.sha2("html", 256)}), "pages")
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"))
    firsts = saved(groups.where("n > 1 AND first IS NOT NULL").select("content", "first"), "first-pages")
    name = lambda row, page: F.concat_ws(":", row.cast("string"), F.coalesce(page.cast("string"), F.lit("")))
    refers_to = F.when(F.col("row") != F.col("first.row"), name(F.col("first.row"), F.col("first.page_id")))
    linked = rows.join(firsts, "content", "left_outer").select(name(F.col("row"), F.col("page_id")).alias("name"), "url", "html", refers_to.alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size, head = None, "", 0, 0, HEAD
        for b in batches:
            for name, url, html, first in zip(b["name"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n, head = store.open_output_stream(path, compression=None), 0, HEAD
                    size = out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_member(name, url, html.encode("utf-8"), None if pd.isna(first) else first))
                n, head = n + 1, max(head, HEAD + len(f"{url}{name}{first}".encode()))
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size], "head_bytes": [head]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size], "head_bytes": [head]})

    return saved(linked.mapInPandas(write, "path string, n_records long, n_bytes long, head_bytes long"), "archives")


def read_warc(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per page record of the listed archives: record_type, record_id, uri, payload_bytes, payload_digest, refers_to, payload (null unless asked for)."""
    schema = "record_type string, record_id string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, most in zip(b["path"], b["head_bytes"], strict=True):
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_archive(source, payloads, most):
                        if r["record_type"] == "warcinfo":
                            continue
                        rows.append(r)
                        size += 200 + len(r["payload"] or b"")
                        if size > 4 << 20:
                            yield pd.DataFrame(rows)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    spread = archives.select("path", "head_bytes").repartition(max(1, archives.count()))
    return spread.mapInPandas(read, schema)


def op8_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_warc(write_warc(table(spark, sf_dir, "pages"), folder), folder)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:\d+:(-?\d*)$", 1), F.lit("")).cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + CAST(5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
