"""Every byte that lies in a 200-byte string which also starts somewhere else.

Blockwise suffix sorting with a cover sample, cut at the depth that matters, 200 bytes. The sample has a
position in each 200-byte string, chosen by content, so that equal strings are sampled at equal offsets
(the property that a difference cover gives by residues, with an eleventh of the positions). The strings
of one sampled position stand together in the range around it, its context.

1. Sampled positions are counted by the bytes at them; only those that recur go on.
2. Equal contexts get one rank. A context of two or more positions repeats as a whole: such long ties are
   settled by rank and never sorted.
3. A context of one position may repeat in part. Where it shares its sampled bytes with other contexts, one
   of each forms a suffix bucket, sorted by itself in a task: equal neighbours are repeats.
   A bucket of more than BUCKET contexts is not gathered; its strings are grouped by Spark one by one.

Ranks are pairs of 64-bit hashes of the sampled bytes and of the context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, named, saved, table, text_of
from .substring_hash import BLOCK, Hashes, anchors

LENGTH, SAMPLED = 200, 50
#: Contexts of one bucket that a task may sort, and those of all buckets of one task, about.
BUCKET, TASK = 5_000, 40_000


def contexts(data: np.ndarray, length: int, sampled: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash at the sampled position, hash of the context, first start, last start) of all starts of `length` bytes, a block at a time."""
    for at in range(0, len(data) - length + 1, BLOCK - length):
        part = data[at : at + BLOCK - 1]
        h = Hashes(part)
        here = h.all_of(sampled)
        place = anchors(here, length - sampled + 1)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(place) - 1]))
        shift = ((place[first] - first) << 20 | (last - first)).astype(np.uint64)  # where in the context the sampled position is
        whole = h.of(first, last + length) ^ shift * np.uint64(0x9E3779B97F4A7C15)
        yield here[place[first]].view(np.int64), whole.view(np.int64), first + at, last + at


def sample(texts: DataFrame, length: int, sampled: int) -> DataFrame:
    """here, whole, key, span: span holds the first start and, in its lowest 8 bits, the number of further starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, size = [], 0
            for key, text in zip(b["key"].tolist(), b["text"], strict=True):
                for here, whole, first, last in contexts(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), length, sampled):
                    found.append((here, whole, np.full(len(here), key), first << 8 | last - first))
                    size += len(here)
                if size > 50_000:
                    yield pd.DataFrame(dict(zip(("here", "whole", "key", "span"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
                    found, size = [], 0
            if found:
                yield pd.DataFrame(dict(zip(("here", "whole", "key", "span"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return texts.mapInPandas(run, "here long, whole long, key long, span long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they touch or overlap."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]


def repeated_starts(texts: DataFrame, length: int = LENGTH, sampled: int = SAMPLED, bucket: int = BUCKET, task: int = TASK) -> DataFrame:
    """(key, spans): of each text that has any, where strings of `length` bytes start that start elsewhere too."""
    positions = sample(texts, length, sampled)
    recurring = saved(positions.groupBy("here").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("here"), "recurring")
    some = saved(positions.join(recurring, "here", "left_semi"), "positions")
    dropped(recurring)
    ranks = saved(some.groupBy("here", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "span")).alias("one")), "ranks")
    groups = saved(ranks.groupBy("here").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 AND least = 1").select("here", "contexts"), "groups")
    several = saved(ranks.where("n > 1").select("here", "whole"), "several")
    as_whole = some.join(several, ["here", "whole"], "left_semi").select("key", "span")
    ones = ranks.join(groups, "here").select("one.key", F.struct("one.span", "here", "contexts", (F.col("n") == 1).alias("alone")).alias("mark"))
    marks = ones.groupBy("key").agg(F.collect_list("mark").alias("marks"))
    parts = max(1, -(-groups.agg(F.coalesce(F.sum(F.when(F.col("contexts") <= bucket, F.col("contexts"))), F.lit(0))).first()[0] // task))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = ["here", "key", "first", "bytes", "alone", "contexts"], []
        for b in batches:
            for key, text, marks in zip(b["key"].tolist(), b["text"], b["marks"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    first = m["span"] >> 8
                    rows.append((m["here"], key, first, data[first : first + (m["span"] & 255) + length], m["alone"], m["contexts"]))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    cuts = texts.dropDuplicates(["key"]).join(marks, "key", "inner").mapInPandas(cut, "here long, key long, first long, bytes binary, alone boolean, contexts long")

    def strings(b: pd.DataFrame) -> pd.DataFrame:
        """A row for each string of the contexts: here, its hash, key, start, alone."""
        out = []
        sizes = b["bytes"].map(len).to_numpy()
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(b):  # as many contexts as fit a block
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK - 1)))
            part = b.iloc[lo:hi]
            base = ends[lo:hi] - sizes[lo:hi] - (ends[lo - 1] if lo else 0)
            hashes = Hashes(np.frombuffer(b"".join(part["bytes"]), dtype=np.uint8)).all_of(length)
            n = sizes[lo:hi] - length + 1
            which = np.repeat(np.arange(hi - lo), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(pd.DataFrame({"here": part["here"].to_numpy()[which], "string": hashes[base[which] + off].view(np.int64), "key": part["key"].to_numpy()[which], "start": part["first"].to_numpy()[which] + off, "alone": part["alone"].to_numpy()[which]}))
            lo = hi
        return pd.concat(out)

    def sort_buckets(b: pd.DataFrame) -> pd.DataFrame:
        """Sort the strings of each bucket; those alone in their context that equal a neighbour repeat."""
        s = strings(b)
        order = np.lexsort((s["string"].to_numpy(), s["here"].to_numpy()))
        h, w = s["here"].to_numpy()[order], s["string"].to_numpy()[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        again = np.zeros(len(s), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        s = s[again & s["alone"].to_numpy()].sort_values(["key", "start"])
        key, start = s["key"].to_numpy(), s["start"].to_numpy()
        if not len(s):
            return pd.DataFrame({"key": key, "span": start})
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (np.arange(1, len(key)) % 200 == 0))))
        return pd.DataFrame({"key": key[new], "span": start[new] << 8 | np.diff(np.append(new, len(key))) - 1})

    small = cuts.where(F.col("contexts") <= bucket).withColumn("part", F.pmod(F.xxhash64("here"), F.lit(parts)))
    in_buckets = small.groupBy("part").applyInPandas(lambda b: sort_buckets(b), "key long, span long")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                yield strings(b.iloc[at : at + 1000])

    large = cuts.where(F.col("contexts") > bucket).mapInPandas(each, "here long, string long, key long, start long, alone boolean")
    # Of contexts a string is in once each, so more than one row is a repeat; what is alone and its only partner come from the extremes.
    marked = F.when(F.col("alone"), F.struct("key", "start"))
    grouped = large.groupBy("here", "string").agg(F.count(F.lit(1)).alias("n"), F.min(marked).alias("a"), F.max(marked).alias("b"), F.count(marked).alias("k"))
    again = grouped.where("n > 1 AND k > 0").select("here", "string", "a", "b", "k")
    two = again.where("k <= 2").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("x.key", F.shiftleft("x.start", 8).alias("span"))
    more = large.where("alone").join(again.where("k > 2").select("here", "string"), ["here", "string"], "left_semi").select("key", F.shiftleft("start", 8).alias("span"))
    return as_whole.unionByName(in_buckets).unionByName(two).unionByName(more).groupBy("key").agg(F.collect_list("span").alias("spans"))


def removed_ranges(spans: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, more = np.asarray(spans, dtype=np.int64) >> 8, np.asarray(spans, dtype=np.int64) & 255
    return merged(np.minimum(starts, size), np.minimum(starts + more + length, size))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, sampled: int = SAMPLED) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are UTF-8 bytes, null is empty; matches never cross texts. A byte goes if a string of `length`
    bytes that holds it also starts anywhere else, in the same text or another, both as given. Repeated
    rows repeat each other, so they go whole if long enough; each row counts for itself, whatever its id, which
    may be null or of any type. Texts are known by 64-bit hashes. Empty tables give an empty result.
    """
    texts = docs.select(named(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("key"), "text")
    spans = repeated_starts(texts.select("key", "text"), length, sampled)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                rows = []
                for text, spans in zip(b["text"].iloc[at : at + 200], b["spans"].iloc[at : at + 200], strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    n, gone, kept = len(data), 0, [data]
                    a = z = ()
                    if spans is not None and len(spans):
                        a, z = removed_ranges(spans, length, n)
                        gone = int((z - a).sum())
                        kept = [data[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), n], strict=True)]
                    rows.append((n, gone, len(a), hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                out.insert(0, "doc_id", b["doc_id"].iloc[at : at + 200].to_numpy())
                yield out

    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(spans, "key", "left_outer").select("doc_id", "text", "spans")
    return joined.mapInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")
