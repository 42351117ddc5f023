"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments, each put into a 23-bit word of the perfect Golay code. Of at most
four differing bits, two of the three segments together hold at most two: one in each, or two in one and
none in the other. A word and the words one bit away decode to few codewords (one, or six), so indices
of codewords are keys that tolerate errors: words one bit apart share one that the second decodes to,
words two bits apart share one of each other's six. Fingerprints that share a key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table, text_of
from .graph import components

WORDS, SEED, ERRORS = 4, 42, 4
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Fixed value: a generator of the (23, 12) Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of n 64-bit hashes have, which come in blocks."""
    counts = np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit by bit the majority of the hashes of all runs of `words` words; of the whole sequence, if shorter; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone become small, and only space and U+0009 to U+000D separate
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    spans = ((starts[at : at + BLOCK], ends[at : at + BLOCK]) for at in range(0, n, BLOCK))
    return majority((np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(*some, strict=True)), dtype="<u8") for some in spans), n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


class Golay:
    """Decoder of 23-bit words to the index of the only codeword within three bits."""

    def __init__(self):
        def rest(x: np.ndarray) -> np.ndarray:
            x = x.copy()
            for bit in range(22, 10, -1):
                x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
            return x

        self.low, self.high = rest(np.arange(1 << 12)), rest(np.arange(1 << 11) << 12)
        flips = [0, *(1 << i for i in range(23))]
        errors = np.array(sorted({a | b | c for a in flips for b in flips for c in flips}))
        self.error = np.zeros(1 << 11, dtype=np.int64)
        self.error[rest(errors)] = errors
        self.flips = np.array(flips)

    def index(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.low[x & 0xFFF] ^ self.high[x >> 12]]) >> 11

    def near(self, x: np.ndarray) -> np.ndarray:
        """(len(x), 24): the index of each word and of those one bit from it, sorted; an index that repeats is -1 from its second place on."""
        all_of = np.sort(self.index(x[:, None] ^ self.flips[None, :]), axis=1)
        all_of[:, 1:][all_of[:, 1:] == all_of[:, :-1]] = -1
        return all_of


def keys(fp: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """(places in fp, keys, left, right): fingerprints up to four bits apart share a key, the one on the left and the other on the right."""
    u = fp.view(np.uint64)
    seg = [(u >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    near = [golay.near(s) for s in seg]
    own = [golay.index(s) for s in seg]
    places = np.arange(len(fp))
    for p, (a, b) in enumerate(PAIRS):
        # One error at most in each: the left brings all near indices, the right its own.
        both = (near[a][:, :, None] << 12 | near[b][:, None, :]).reshape(len(fp), -1)
        ok = ((near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :]).reshape(len(fp), -1)
        at, col = np.nonzero(ok)
        yield at, both[at, col] | p << 58, True, False
        yield places, own[a] << 12 | own[b] | p << 58, False, True
        # None in one, two at most in the other: each brings all near indices.
        for q, (same, other) in enumerate(((a, b), (b, a)), 1):
            at, col = np.nonzero(near[other] >= 0)
            yield at, seg[same][at] << 12 | near[other][at, col] | p << 58 | q << 56, True, True


def close_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints fp that differ in one to four bits, each pair once.

    A fingerprint has over a hundred keys, which Spark's estimate of a side's size doesn't see: without the
    hint it would broadcast them, through the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for batch in batches:
            all_fp = batch["fp"].to_numpy()
            for i in range(0, len(all_fp), 2000):
                fp = all_fp[i : i + 2000]
                for at, key, left, right in keys(fp, golay):
                    yield pd.DataFrame({"key": key, "fp": fp[at], "left": left, "right": right})

    rows = fps.select("fp").mapInPandas(run, "key long, fp long, left boolean, right boolean")
    left, right = rows.where("left").select("key", F.col("fp").alias("a")), rows.where("right").select("key", F.col("fp").alias("b"))
    return left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= ERRORS)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (the smallest id reachable by links).

    Fingerprints link at four or fewer differing bits, equal ones included. Null counts as empty; texts
    without words have fingerprint zero, linked like any other. Repeated rows share a component; a null
    id never names one unless a component has no other. An empty table gives an empty result; other
    columns are ignored. Only distinct fingerprints are compared, so groups of copies cost one each.
    """
    known = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = saved(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(close_pairs(distinct))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left_outer").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(classes.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return known.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
