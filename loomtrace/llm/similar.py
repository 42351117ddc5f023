"""Near duplicates by SimHash fingerprints and the Jaccard similarity of their runs of words, without loss.

A text is the set of its runs of five words. Sets get SimHash fingerprints of 64 bits; fingerprints up to four
bits apart are found by Golay keys (`simhash.py`), and each set is compared in full with the first one of those
that its fingerprint leads to. At a similarity of 0.8 fingerprints differ in some ten bits, so what they leave
apart is searched without loss: With all runs in one order, two sets at least 0.8 alike share
a run among the first of each, n - 0.8 n + 1 of n, so those are keys that miss no pair. Any order will do;
runs that are frequent in a sample come last, so that common phrases are seldom keys. Sets that share a key
at places and of sizes that allow the similarity are compared by their parities, a bit or two for each run,
which tell how far apart they are at least; what may still be alike is compared in full.

There each set is first compared with the least set of each of its keys, which joins large groups of near
copies; what is not in one component by then is compared pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import dropped, saved, text_of
from .graph import components

WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: One text in SAMPLE tells which runs are frequent: those in FREQUENT texts of it, the LISTED most frequent ones. They only order the keys.
SAMPLE, FREQUENT, LISTED = 16, 3, 100_000


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of `words` words, sorted; of the whole sequence, if shorter; none without words."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(parts)
    ends = (np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1).tolist()
    begins = [0, *(e + 1 for e in ends)]
    hashes = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[min(words, len(parts)) - 1 :], strict=False))
    return np.unique(np.fromiter(hashes, dtype=np.uint64).view(np.int64))


def hashed(runs: np.ndarray) -> int:
    """A set's name: a signed hash of its bytes."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(runs.tobytes(), SEED)).astype(np.int64))


def parities(runs: np.ndarray) -> bytes:
    """For each residue of a power of two, at least the number of runs, whether an odd number of runs has it."""
    bits = max(64, 1 << (len(runs) - 1).bit_length())
    return np.packbits((np.bincount(runs & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fingerprint(runs: np.ndarray) -> int:
    """The SimHash fingerprint of a set of runs, signed."""
    some = (runs[at : at + simhash.BLOCK] for at in range(0, len(runs), simhash.BLOCK))
    return int(np.uint64(simhash.majority(some, len(runs))).astype(np.int64))


def least_apart(x: bytes, y: bytes) -> int:
    """So many runs at least are in one only of the two sets with these parities: each changes one bit."""
    if len(x) < len(y):
        x, y = y, x
    p, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        p = p >> size ^ p & ((1 << size) - 1)
    return (p ^ int.from_bytes(y, "little")).bit_count()


def frequent_runs(texts: DataFrame, words: int) -> np.ndarray:
    """(2, at most LISTED): frequent runs, sorted, and in how many texts of the sample each is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"run": shingles(t, words)})

    sample = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = sample.mapInPandas(run, "run long").groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.col("n").desc(), "run").limit(LISTED).collect()
    return np.array(sorted((r["run"], r["n"]) for r in rows), dtype=np.int64).reshape(-1, 2).T


def sets_of(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, h, node (a hash of the set), n, odd (its parities), fp (its fingerprint) and keys: of each set the first runs, of which two sets that are alike share one.

    The sets themselves are eight bytes a word, more than the texts; they are made again for those compared.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent_runs(texts, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, often = shared.value
        for b in batches:
            for at in range(0, len(b), 500):
                found = []
                for text in b["text"][at : at + 500]:
                    runs = shingles(text, words)
                    node, n, odd, fp = hashed(runs), len(runs), parities(runs), fingerprint(runs)
                    if len(listed):
                        i = np.minimum(np.searchsorted(listed, runs), len(listed) - 1)
                        runs = runs[np.argsort(np.where(listed[i] == runs, often[i], 0), kind="stable")]
                    found.append((node, n, odd, fp, runs[: n - math.ceil(similarity * n - 1e-9) + 1]))
                yield b[["doc_id", "h"]][at : at + 500].reset_index(drop=True).join(pd.DataFrame(found, columns=["node", "n", "odd", "fp", "keys"]))

    return texts.mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long, node long, n int, odd binary, fp long, keys array<long>")


def may_be_alike(similarity: float) -> Column:
    """Whether sizes and places of a first shared key allow the similarity: the sets share that run and later ones at most."""
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return most >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6


def not_far_apart(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) without those whose parities differ more than sets that are alike can."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            most = (1 - similarity) / (1 + similarity) * (t["n_a"] + t["n_b"]) + 1e-6
            apart = np.fromiter(map(least_apart, t["odd_a"], t["odd_b"]), dtype=np.int64, count=len(t))
            yield t.loc[apart <= most, ["a", "b"]]

    sizes = known.select("node", "n", "odd").dropDuplicates(["node"])
    one, two = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def alike(pairs: DataFrame, texts: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are alike."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = [shingles(t, words) for t in b["text"][at : at + 500]]
                yield pd.DataFrame({"node": [hashed(s) for s in some], "runs": [s.tobytes() for s in some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            ok = []
            for x, y in zip(t["runs_a"], t["runs_b"], strict=True):
                p, q = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield t.loc[ok, ["a", "b"]]

    pairs = saved(not_far_apart(pairs, known, similarity), "close-pairs")
    # One text of each set that is compared.
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = known.select("node", "h").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")).select("h").distinct()
    some = texts.select("h", "text").join(wanted, "h", "left_semi").select("text").distinct()
    runs = saved(some.mapInPandas(sets, "node long, runs binary"), "candidate-sets")
    one, two = (runs.select(F.col("node").alias(c), F.col("runs").alias(f"runs_{c}")) for c in "ab")
    out = saved(pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long"), "alike")
    dropped(runs, pairs)
    return out


def by_fingerprint(known: DataFrame) -> DataFrame:
    """(a, b): each set with the least one of those that links of close fingerprints lead to. Sets without runs are left out."""
    sets = saved(known.where("n > 0").select("node", "fp").dropDuplicates(["node"]), "fingerprints")
    roots = components(simhash.close_pairs(sets.select("fp").distinct()))
    rooted = saved(sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left_outer").select("node", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    least = rooted.groupBy("root").agg(F.min("node").alias("a"))
    out = saved(rooted.join(least, "root").where("a < node").select("a", F.col("node").alias("b")), "simhash-pairs")
    dropped(sets, rooted)
    return out


def still_apart(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with `root`, the component of their sets, as a saved table; and those of keys with several roots."""
    rooted = saved(rows.join(components(links), "node", "left_outer").withColumn("root", F.coalesce("root", "node")), "rooted-keys")
    apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    return rooted, rooted.join(apart, "key", "left_semi")


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in rows.columns if c != "key"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest id reachable by links).

    Texts link if their sets of runs of `words` words have a Jaccard similarity of `similarity` or more. Null
    counts as empty; texts without words link with each other only. Repeated rows share a component; a null
    id never names one unless a component has no other. An empty table gives an empty result; other columns
    are ignored. Equal sets are compared once.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    known = saved(sets_of(texts, words, similarity), "run-sets")
    every = known.select("node", "n", "keys").dropDuplicates(["node"]).select("node", "n", F.posexplode("keys").alias("place", "key"))
    recurring = every.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    rows = saved(every.join(recurring, "key", "left_semi"), "recurring-keys")

    close = by_fingerprint(known)
    links = alike(close, texts, known, words, similarity)
    first, open_rows = still_apart(rows, links)
    dropped(rows)

    # The least set of each key; its other columns come with it.
    least = open_rows.groupBy("key").agg(F.min(F.struct("node", "n", "place", "root")).alias("x")).select("key", F.col("x.node").alias("a"), F.col("x.n").alias("n_a"), F.col("x.place").alias("place_a"), F.col("x.root").alias("root_a"))
    met = least.join(side(open_rows, "b"), "key").where("a < b AND root_a <> root_b").where(may_be_alike(similarity)).select("a", "b").distinct()
    pairs = saved(met.join(close, ["a", "b"], "left_anti"), "first-pairs")
    links = links.unionByName(alike(pairs, texts, known, words, similarity))

    second, open_rows = still_apart(open_rows.drop("root"), links)
    dropped(first)
    rest = side(open_rows, "a").join(side(open_rows, "b"), "key").where("a < b AND root_a <> root_b").where(may_be_alike(similarity)).select("a", "b").distinct()
    others = saved(rest.join(pairs.unionByName(close), ["a", "b"], "left_anti"), "other-pairs")
    dropped(second, pairs, close)
    links = links.unionByName(alike(others, texts, known, words, similarity))
    dropped(others)

    distinct = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = saved(distinct.join(components(links), "node", "left_outer").select("node", "least", F.coalesce("root", "node").alias("root")), "set-classes")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.select("doc_id", "node").join(classes.join(names, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
    out = saved(named, "near-texts")
    dropped(known, classes)
    return out
