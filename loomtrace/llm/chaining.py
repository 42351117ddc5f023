"""Passages of 50 words and more that documents share, exactly or edited, by collinear chaining.

1. Equal texts are taken once. Runs of five words are sampled by content (of every 8 neighbours the least
   hash), so a passage of 50 words that stands in two texts has five of the same at least.
2. Seeds are sampled runs that two texts have; two seeds 16 to 60 words apart are a key. Phrases and lines
   shorter than that make no key, and an exact passage of 50 words makes one for certain.
3. Texts that have a key are joined: all of them where they are few, else each with the first and the last.
   What is then still apart under a key is joined all with all, but for pairs with too few words in common
   for any passage. Of keys that the same texts have one is taken.
4. In a pair all shared runs of five words become matches along diagonals; a Fenwick tree finds the best
   chain of ordered matches under gap costs; the words between and around the matches are aligned, and the
   longest parts that are 0.8 alike over 50 words are passages.

Words and runs are known by 32-bit and 64-bit hashes, texts by a 64-bit one.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, table, text_of
from .graph import components
from .substring_hash import BLOCK, anchors, mixed

RUN, WINDOW = 5, 8
#: Words from the first seed of a key to the last; seeds that a seed makes a key with, the nearest ones.
NEAREST, FARTHEST, PARTNERS = 16, 60, 2
#: Words kept on each side of a key.
FLANK = 64
#: Texts of a key up to which all are compared with all; links up to which one task finds the classes of what rounds have left.
FEW, LAST_LINKS = 6, 20_000
#: Pairs with one text that a task compares, about; stretches of a key that a task holds against all others of it.
SHARE, HELD = 1_000, 256
#: Texts that are compared with one at once.
AT_ONCE = 64
LEAST_WORDS, SIMILARITY = 50, 0.8
GAP_COST = 0.05
#: Of a run that two texts hold so many times, the numbers multiplied, only places on the diagonals of rarer runs are matches.
REPEATS = 64
#: A chain with fewer words in shared runs is no passage.
LEAST_CHAIN = 10
PUNCTUATION = b".,;:!?\"'()[]"
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PASSAGE = "start_a long, end_a long, start_b long, end_b long, similarity double"


def words_of(text: str) -> np.ndarray:
    """A 32-bit hash of each word: what white space separates, without punctuation, A-Z in lower case."""
    parts = text.encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split()
    return np.fromiter(map(crc32, parts), dtype=np.uint32, count=len(parts))


def runs(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of RUN words."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    w = words.astype(np.uint64) + np.uint64(1)
    h = w[:n] * ODD
    for i in range(1, RUN):
        h += w[i : i + n]
        h *= ODD
    return mixed(h)


def sampled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the sampled runs, in order of place."""
    h = runs(words)
    if len(h) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = BLOCK - WINDOW
    places = np.unique(np.concatenate([at + anchors(h[at : at + BLOCK - 1], WINDOW) for at in range(0, len(h) - WINDOW + 1, step - 1)]))
    return places, h[places].view(np.int64)


def with_seed(key: np.ndarray, run: np.ndarray, side: int) -> np.ndarray:
    """The key that takes on one more run, on one side of it."""
    return mixed(key.view(np.uint64) * ODD + run.view(np.uint64) * OTHER + np.uint64(side)).view(np.int64)


def seed_keys(places: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, end) of the keys of a text's seeds, the first place of each."""
    begin = np.searchsorted(places, places + NEAREST)
    found = []
    for k in range(PARTNERS):
        i = np.flatnonzero(begin + k < len(places))
        j = begin[i] + k
        near = places[j] - places[i] <= FARTHEST
        i, j = i[near], j[near]
        found.append((with_seed(seeds[i], seeds[j], 0), places[i], places[j] + RUN))
    key, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    key, at = np.unique(key, return_index=True)
    return key, lo[at], hi[at]


class Fenwick:
    """Greatest value, and who has it, among places up to one."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def most(self, i: int) -> tuple[float, int]:
        """Of places 0 to i - 1."""
        found = (-1e18, -1)
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


class Side:
    """One text of a pair: its words, its runs with their order, and what its words are."""

    def __init__(self, words: np.ndarray):
        self.words, self.runs = words, runs(words)
        self.order = np.argsort(self.runs, kind="stable")
        self.sorted = self.runs[self.order]
        #: How often a run in that order is there.
        self.times = np.searchsorted(self.sorted, self.sorted, "right") - np.searchsorted(self.sorted, self.sorted, "left")
        self.known = np.unique(words)


def may_share(words: np.ndarray, begin: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which texts have LEAST_WORDS words or more in a row of which SIMILARITY are known. Others have no passage with a text of the known words.

    The texts begin at `begin` in words, each after one place that is no word of it.
    """
    if not len(known):
        return np.zeros(len(begin), dtype=bool)
    sums = np.where(known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words, 1, -4)
    # Between texts the sum falls so low that no row of words goes over it.
    sums[begin - 1] = -8 * len(words)
    sums = np.cumsum(sums)
    found = np.zeros(len(words), dtype=bool)
    found[LEAST_WORDS:] = sums[LEAST_WORDS:] >= np.minimum.accumulate(sums[:-LEAST_WORDS]) if len(words) > LEAST_WORDS else False
    return np.logical_or.reduceat(found, begin - 1)


def shared_runs(ha: np.ndarray, lo: np.ndarray, at: np.ndarray, rare: np.ndarray, other: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places (of the runs ha, of those of the other text) where the same run begins; of ha those `at` are in the other text, from `lo` on in its order."""
    some, often = at[rare], at[~rare]
    n = other.times[lo[some]]
    i = np.repeat(some, n)
    j = other.order[np.arange(len(i)) + np.repeat(lo[some] - np.cumsum(n) + n, n)]
    # Frequent runs: all places on the diagonals that are known; without any, first with first and so on.
    known = np.unique(i - j).tolist() if len(i) else [(often - other.order[lo[often]]).min()]
    found_i, found_j = [i], [j]
    for d in known:
        p = often[(often >= d) & (often < d + len(other.runs))]
        p = p[other.runs[p - d] == ha[p]]
        found_i.append(p)
        found_j.append(p - d)
    return np.concatenate(found_i), np.concatenate(found_j)


def diagonals(words: np.ndarray, begin: np.ndarray, end: np.ndarray, other: Side) -> Iterator[list[tuple[int, int, int]]]:
    """For each text (from begin to end in words) the (place in it, place in the other, words) of the maximal rows of shared runs along diagonals."""
    h = runs(words)
    lo = np.searchsorted(other.sorted, h, "left")
    at = np.flatnonzero(other.sorted[np.minimum(lo, len(other.sorted) - 1)] == h) if len(other.sorted) else lo[:0]
    text = np.searchsorted(begin, at, "right") - 1
    inside = (text >= 0) & (at + RUN <= end[text])
    at, text = at[inside], text[inside]
    times_b = other.times[lo[at]]
    _, which, times_a = np.unique(text * (len(other.sorted) + 1) + lo[at], return_inverse=True, return_counts=True)
    rare = times_b * times_a[which] <= REPEATS
    bounds = np.searchsorted(text, np.arange(len(begin) + 1)).tolist()
    # Texts with a frequent run go one by one.
    often = np.zeros(len(begin), dtype=bool)
    often[text[~rare]] = True
    every = ~often[text]
    some, n = at[every], times_b[every]
    i = np.repeat(some - begin[text[every]], n)
    j = other.order[np.arange(len(i)) + np.repeat(lo[some] - np.cumsum(n) + n, n)]
    found = [(i, j, np.repeat(text[every], n))]
    for x in np.flatnonzero(often).tolist():
        own = slice(bounds[x], bounds[x + 1])
        i, j = shared_runs(h[begin[x] :], lo[begin[x] :], at[own] - begin[x], rare[own], other)
        found.append((i, j, np.full(len(i), x)))
    i, j, t = map(np.concatenate, zip(*found, strict=True))
    # By text, diagonal and place.
    order = np.lexsort((i, i - j, t))
    i, j, t = i[order], j[order], t[order]
    new = np.flatnonzero(np.concatenate(([True], (i[1:] - i[:-1] != 1) | (j[1:] - j[:-1] != 1) | (t[1:] != t[:-1])))) if len(i) else i
    last = np.append(new[1:], len(i))[: len(new)] - 1
    rows = list(zip(i[new].tolist(), j[new].tolist(), (i[last] - i[new] + RUN).tolist(), strict=True))
    bounds = np.searchsorted(t[new], np.arange(len(begin) + 1)).tolist()
    for x, y in zip(bounds, bounds[1:], strict=False):
        yield sorted(rows[x:y])


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best chain: matches in order in both texts, each worth its words less GAP_COST for every word from its end to the next start."""
    if len(matches) == 1:
        return matches
    if all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(matches, matches[1:], strict=False)):
        # All in order: the match just before is the best one to follow.
        score, first = [float(matches[0][2])], [0]
        for m in range(1, len(matches)):
            (pi, pj, pn), (i, j, n) = matches[m - 1], matches[m]
            gain = score[-1] + GAP_COST * (pi + pj + 2 * pn) - GAP_COST * (i + j)
            score.append(n + max(0.0, gain))
            first.append(first[-1] if gain > 0 else m)
        at = score.index(max(score))
        return matches[first[at] : at + 1]
    ends = sorted({j + n for _, j, n in matches})
    place = {e: i for i, e in enumerate(ends)}
    tree, score, before = Fenwick(len(ends)), [], []
    waiting: list[tuple[int, int]] = []  # (end in a, match), to enter the tree once a start is past it
    for m, (i, j, n) in enumerate(matches):
        while waiting and waiting[0][0] <= i:
            _, w = heapq.heappop(waiting)
            wi, wj, wn = matches[w]
            tree.put(place[wj + wn], score[w] + GAP_COST * (wi + wj + 2 * wn), w)
        most, who = tree.most(bisect.bisect_right(ends, j))
        gain = most - GAP_COST * (i + j)
        score.append(n + max(0.0, gain))
        before.append(who if gain > 0 else -1)
        heapq.heappush(waiting, (i + n, m))
    at = int(np.argmax(score))
    out = []
    while at >= 0:
        out.append(matches[at])
        at = before[at]
    return out[::-1]


def matched(a: list[int], b: list[int]) -> int:
    """Words that the best alignment of a and b has in common: a row of the alignment is the bits of a number, 0 where it grows."""
    if not a or not b:
        return 0
    if len(a) == len(b) == 1:
        return int(a[0] == b[0])
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row = every = (1 << len(b)) - 1
    for x in a:
        if same := where.get(x, 0) & row:
            row = (row + same | row - same) & every
    return len(b) - row.bit_count()


def columns(links: list[tuple[int, int, int]], a: list[int], b: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """A chain as aligned parts (matched words, words, start in a, end, start in b, end), with the words around it along its first and last diagonals."""
    out = []
    i, j, _ = links[0]
    n = min(i, j, FLANK)
    for k in [*(k for k in range(n) if a[i - n + k] == b[j - n + k]), n]:
        if k < n and not out:
            out.append((1, 1, i - n + k, i - n + k + 1, j - n + k, j - n + k + 1))
        elif out:
            _, _, _, x, _, y = out[-1]
            if i - n + k > x:
                out.append((0, i - n + k - x, x, i - n + k, y, j - n + k))
            if k < n:
                out.append((1, 1, i - n + k, i - n + k + 1, j - n + k, j - n + k + 1))
    for x, (i, j, n) in enumerate(links):
        if x:
            pi, pj, pn = links[x - 1]
            ga, gb = a[pi + pn : i], b[pj + pn : j]
            if ga or gb:
                # A gap that no passage of these texts can hold is not aligned.
                hopeless = 4 * abs(len(ga) - len(gb)) > min(len(a), len(b))
                out.append((0 if hopeless else matched(ga, gb), max(len(ga), len(gb)), pi + pn, i, pj + pn, j))
        out.append((n, n, i, i + n, j, j + n))
    i, j, n = links[-1]
    i, j = i + n, j + n
    n = min(len(a) - i, len(b) - j, FLANK)
    at = 0
    for k in range(n):
        if a[i + k] != b[j + k]:
            continue
        if k > at:
            out.append((0, k - at, i + at, i + k, j + at, j + k))
        out.append((1, 1, i + k, i + k + 1, j + k, j + k + 1))
        at = k + 1
    return out


def good_parts(parts: list[tuple]) -> Iterator[list[tuple]]:
    """Rows of parts of which every beginning and every end is over 0.6 alike, so that unlike words at the ends are left out."""
    todo = [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        best, ends, total, start = 0, None, 0, lo
        for x in range(lo, hi):
            m, t = parts[x][:2]
            total += 2 * m - 3 * (t - m)
            if total <= 0:
                if ends:
                    break
                total, start = 0, x + 1
            elif total > best:
                best, ends = total, (start, x + 1)
        if ends:
            # Best from its start on; the same from its end back.
            a, z = ends
            total = most = 0
            for x in range(z - 1, a - 1, -1):
                m, t = parts[x][:2]
                total += 2 * m - 3 * (t - m)
                if total > most:
                    most, start = total, x
            yield parts[start:z]
            todo += [(z, hi), (a, start)]


def longest_alike(parts: list[tuple]) -> Iterator[tuple[int, int]]:
    """(first, end) of the longest rows of parts that are SIMILARITY alike; left and right of each the longest ones again."""
    todo = [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo:
            continue
        # Words that match are worth 1 and others -4: a row is alike if it is worth 0 or more.
        sums, place = [0], [0]
        for m, t, *_ in parts[lo:hi]:
            sums.append(sums[-1] + m - 4 * (t - m))
            place.append(place[-1] + t)
        starts = [0]
        for x, s in enumerate(sums):
            if s < sums[starts[-1]]:
                starts.append(x)
        best, end = (0, 0, 0), len(sums) - 1
        greatest = -1
        for end in range(len(sums) - 1, 0, -1):
            if greatest >= 0 and sums[end] <= sums[greatest]:
                continue
            greatest = end
            x = bisect.bisect_left(starts, True, key=lambda s, e=end: sums[s] <= sums[e])
            if x < len(starts) and starts[x] < end:
                best = max(best, (place[end] - place[starts[x]], starts[x], end))
        n, first, end = best
        if n >= LEAST_WORDS:
            yield lo + first, lo + end
            todo += [(lo, lo + first), (lo + end, hi)]


def passages(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start in a, end, start in b, end, similarity) of the passages of the best chains; a chain's matches are left out and the rest is chained again.

    Similarity is the share of matched words in the aligned ones, of the longer side where two gaps differ.
    """
    return passages_with([a], Side(b))[0]


def passages_with(texts: list[np.ndarray], other: Side) -> list[list[tuple[int, int, int, int, float]]]:
    """The passages of each text with the other one."""
    out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end = np.cumsum(lengths + 1)
    begin = end - lengths
    gap = np.zeros(1, dtype=np.uint32)
    words = np.concatenate([x for t in texts for x in (gap, t)])
    some = np.flatnonzero(may_share(words, begin, other.known))
    if len(some):
        b = other.words.tolist()
        for t, left in zip(some.tolist(), diagonals(words, begin[some], end[some], other), strict=True):
            if left:
                out[t] = passages_of(left, texts[t].tolist(), b)
    return out


def passages_of(left: list[tuple[int, int, int]], a: list[int], b: list[int]) -> list[tuple[int, int, int, int, float]]:
    """The passages of a and b, of which the shared runs are given along diagonals."""
    out = []
    while left:
        links = chain(left)
        if sum(n for _, _, n in links) < LEAST_CHAIN:
            break
        for good in good_parts(columns(links, a, b)):
            for s, e in longest_alike(good):
                while good[s][0] == 0:
                    s += 1
                while good[e - 1][0] == 0:
                    e -= 1
                i, k, j, m = good[s][2], good[e - 1][3], good[s][4], good[e - 1][5]
                if min(k - i, m - j) >= LEAST_WORDS:
                    out.append((i, k, j, m, sum(x[0] for x in good[s:e]) / sum(x[1] for x in good[s:e])))
        taken = set(links)
        left = [x for x in left if x not in taken]
    return out


def batched(rows: Iterator[tuple], names: list[str], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Rows of arrays, the first of which tells their length, as frames."""
    found, size = [], 0
    for r in rows:
        found.append(tuple(np.full(len(r[0]), x) if np.isscalar(x) else x for x in r))
        size += len(r[0])
        if size > most:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))
            found, size = [], 0
    if found:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))


def shared(rows: DataFrame, key: str, of: str) -> DataFrame:
    """The keys that two values of `of` have: few of all, so a join with them holds them in a table by hash and need not sort the rest."""
    return rows.groupBy(key).agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least < most").select(key).hint("shuffle_hash")


def stretches(contents: DataFrame) -> DataFrame:
    """(stretch, content, first, words, keys, lo, hi): the parts of texts around keys that other texts have, in words. The saved table of contents goes."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for content, w in zip(b["content"].tolist(), b["words"], strict=True):
                    places, h = sampled(np.frombuffer(w, dtype=np.uint32))
                    yield h, content, places

        yield from batched(rows(), ["run", "content", "place"])

    def to_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for content, places, seeds in zip(b["content"].tolist(), b["places"], b["seeds"], strict=True):
                    key, lo, hi = seed_keys(np.asarray(places, dtype=np.int64), np.asarray(seeds, dtype=np.int64))
                    yield key, content, lo, hi

        yield from batched(rows(), ["key", "content", "lo", "hi"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["content", "first", "words", "keys", "lo", "hi"]
        for b in batches:
            rows, size = [], 0
            for content, w, *spans in zip(b["content"].tolist(), b["words"], b["keys"], b["lo"], b["hi"], strict=True):
                words = np.frombuffer(w, dtype=np.uint32)
                key, lo, hi = (np.asarray(x, dtype=np.int64) for x in spans)
                order = np.argsort(lo, kind="stable")
                key, lo, hi = key[order], lo[order], hi[order]
                new = np.flatnonzero(lo[1:] - np.maximum.accumulate(hi)[:-1] > 2 * FLANK) + 1
                for k, x, z in zip(*(np.split(y, new) for y in (key, lo, hi)), strict=True):
                    first, end = max(0, int(x[0]) - FLANK), min(len(words), int(z.max()) + FLANK)
                    rows.append((content, first, words[first:end].tobytes(), k, x - first, z - first))
                    size += 4 * (end - first) + 24 * len(k)
                if size > 4 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    runs_of = saved(contents.select("content", "words").mapInPandas(sample, "run long, content long, place int"), "sampled-runs")
    seeds = runs_of.join(shared(runs_of, "run", "content"), "run", "left_semi").groupBy("content").agg(F.sort_array(F.collect_list(F.struct("place", "run"))).alias("x"))
    keys = saved(seeds.select("content", F.col("x.place").alias("places"), F.col("x.run").alias("seeds")).mapInPandas(to_keys, "key long, content long, lo int, hi int"), "seed-keys")
    dropped(runs_of)
    kept = keys.join(shared(keys, "key", "content"), "key", "left_semi").groupBy("content").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("x"))
    spans = kept.select("content", F.col("x.key").alias("keys"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    found = contents.select("content", "words").join(spans, "content").mapInPandas(cut, "content long, first long, words binary, keys array<long>, lo array<int>, hi array<int>")
    found = saved(found.select(F.xxhash64("content", "first").alias("stretch"), "*"), "stretches")
    dropped(keys, contents)
    return found


def same_members(*of: str) -> list[Column]:
    """Two 64-bit marks of a key's members: keys with the same ones have equal marks."""
    return [F.bit_xor(F.xxhash64(*of, F.lit(i))).alias(f"mark{i}") for i in (0, 1)]


def pairs_of(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, rep): stretches to compare, of the members (key, stretch) of each key: all of few, else each with the first and the last."""
    of_set = groups.groupBy("n", "least", "most", "mark0", "mark1").agg(F.min("key").alias("key"))
    two = of_set.where("n = 2").select(F.col("least").alias("stretch"), F.col("most").alias("rep"))
    both = members.join(of_set.where("n > 2").select("key", "n", "least", "most"), "key")
    ends = both.where(F.col("n") > FEW).select("stretch", F.explode(F.array("least", "most")).alias("rep")).where("stretch <> rep")
    few = both.where(F.col("n") <= FEW).select("key", "stretch")
    each = few.join(few.withColumnRenamed("stretch", "rep"), "key").where("stretch < rep").select("stretch", "rep")
    found = two.unionByName(ends).unionByName(each).groupBy(F.least("stretch", "rep").alias("a"), F.greatest("stretch", "rep").alias("b")).agg(F.max("rep").alias("rep"))
    return found.select(F.when(F.col("rep") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("s"), "rep")


def bag(words: np.ndarray) -> np.ndarray:
    """Words with their numbers, so that two texts have as many of these in common as they have words at most, repeats included."""
    w = np.sort(words)
    first = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, dtype=bool)
    at = np.arange(len(w))
    return w.astype(np.int64) | (at - np.maximum.accumulate(np.where(first, at, 0))) << 32


def placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members whose key stretches of several classes have, with `root`, their class.

    A stretch belongs to the class that its passages link, over the keys they hold; over others it stands alone.
    """
    roots = components(found.select(F.col("s").alias("a"), F.col("rep").alias("b")), LAST_LINKS)
    spans = found.select(F.col("s").alias("stretch"), F.col("start_a").alias("start"), F.col("end_a").alias("end")).unionByName(found.select(F.col("rep").alias("stretch"), F.col("start_b").alias("start"), F.col("end_b").alias("end")))
    held = members.join(spans.distinct(), "stretch").where("start <= first + lo AND end >= first + hi").select("key", "stretch").distinct().join(roots.withColumnRenamed("node", "stretch"), "stretch")
    rooted = members.join(held, ["key", "stretch"], "left_outer").withColumn("root", F.coalesce("root", "stretch"))
    rooted = saved(rooted.select("key", "stretch", "root"), "placed")
    return rooted.join(shared(rooted, "key", "root"), "key", "left_semi")


def rest_of(apart: DataFrame, parts: DataFrame) -> DataFrame:
    """(s, rep): all pairs of stretches of a key that are apart under it, without those that have fewer words in common than any passage."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"stretch": b["stretch"], "bag": [bag(np.frombuffer(w, dtype=np.uint32)) for w in b["words"]]})

    least = math.ceil(SIMILARITY * LEAST_WORDS - 1e-9)
    tasks = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *same_members("stretch", "root")).groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key"))
    blocks = sets.select("key", F.ceil(F.col("n") / HELD).cast("int").alias("blocks"))
    held = parts.join(apart.select("stretch").distinct(), "stretch", "left_semi").select("stretch", "words").mapInPandas(bags, "stretch long, bag array<long>")
    rows = saved(apart.select("key", "stretch", "root").join(blocks, "key").join(held, "stretch"), "still-apart")
    one = rows.select("key", F.col("stretch").alias("s"), F.col("root").alias("root_a"), F.col("bag").alias("bag_a"), F.pmod(F.xxhash64("stretch"), "blocks").cast("int").alias("block"))
    two = rows.select("key", F.col("stretch").alias("rep"), F.col("root").alias("root_b"), F.col("bag").alias("bag_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # Few bytes, much work: dealt to all tasks by number, not by size.
    both = one.repartition(tasks, "key", "block").join(two.repartition(tasks, "key", "block").hint("merge"), ["key", "block"])
    return both.where("s < rep AND root_a <> root_b").where(F.size(F.array_intersect("bag_a", "bag_b")) >= least).select("s", "rep").distinct()


def compared(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The passages of pairs (s, rep): s and rep, their contents and places in whole texts. A stretch in many pairs is dealt to several tasks."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["s", "rep", "a", "b", "start_a", "end_a", "start_b", "end_b", "similarity"]
        for t in batches:
            rows = []
            t = t[t["content_a"] != t["content_b"]]
            s, rep, a, b, fa, fb = (t[c].to_numpy() for c in ("s", "rep", "content_a", "content_b", "first_a", "first_b"))
            words_a, words_b = t["words_a"].tolist(), t["words_b"].tolist()
            # The pairs of a stretch follow each other; some at a time, so that what is held stays small.
            bounds = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1], [True]))).tolist() if len(t) else []
            for x, y in zip(bounds, bounds[1:], strict=False):
                other = Side(np.frombuffer(words_b[x], dtype=np.uint32))
                for at in range(x, y, AT_ONCE):
                    found = passages_with([np.frombuffer(w, dtype=np.uint32) for w in words_a[at : min(y, at + AT_ONCE)]], other)
                    rows += [(s[p], rep[p], a[p], b[p], i + fa[p], k + fa[p], j + fb[p], m + fb[p], alike) for p, some in enumerate(found, at) for i, k, j, m, alike in some]
            yield pd.DataFrame(rows, columns=names)

    busy = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    asked = pairs.join(busy, "rep").withColumn("share", F.pmod(F.xxhash64("s"), "shares").cast("int"))
    one = parts.select(F.col("stretch").alias("s"), F.col("content").alias("content_a"), F.col("first").alias("first_a"), F.col("words").alias("words_a"))
    two = parts.select(F.col("stretch").alias("rep"), F.col("content").alias("content_b"), F.col("first").alias("first_b"), F.col("words").alias("words_b"))
    two = two.join(busy, "rep").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # Few bytes, much work: dealt to all tasks by number, not by size.
    tasks = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = asked.select("s", "rep", "share").join(one, "s").repartition(tasks, "rep", "share").join(two.repartition(tasks, "rep", "share").hint("merge"), ["rep", "share"])
    return saved(texts.mapInPandas(compare, "s long, rep long, a long, b long, " + PASSAGE), "passages")


def linked(parts: DataFrame) -> DataFrame:
    """All passages that pairs of stretches are found to share."""
    members = parts.select("stretch", "first", F.explode(F.arrays_zip("keys", "lo", "hi")).alias("x")).select(F.col("x.keys").alias("key"), "stretch", "first", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"), *same_members("stretch")).where("least < most")
    groups = saved(groups, "groups")
    pairs = saved(pairs_of(members.select("key", "stretch"), groups), "pairs")
    found = compared(pairs, parts)
    apart = placed(members.join(groups.where(F.col("n") > FEW).select("key"), "key", "left_semi"), found)
    dropped(groups)
    turned = pairs.select(F.col("rep").alias("s"), F.col("s").alias("rep"))
    more = saved(rest_of(apart, parts).join(pairs.unionByName(turned), ["s", "rep"], "left_anti"), "more-pairs")
    return found if more.isEmpty() else saved(found.unionByName(compared(more, parts)), "all-passages")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, class_id, partner_id, similarity): the shared passages of documents, in words.

    Each passage is listed in both of its documents. Of equal texts one is compared and all get its passages;
    each of them also shares its whole text with the others, similarity 1. partner_id is the least id that
    has the best other text, or the greatest where the least is the document's own; class_id is the least id
    of the documents that passages link. Rows of one id are one document and share nothing with each other.
    Texts of fewer than 50 words, null ones included, have no passage; a null id is a document of its own and
    names a class or partner only where there is no other id; an empty table gives an empty result; other
    columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.length("text") >= 2 * LEAST_WORDS - 1)
    texts = texts.select("doc_id", F.xxhash64("text").alias("content"), "text")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                words = list(map(words_of, b["text"].iloc[at : at + 500]))
                out = pd.DataFrame({"content": b["content"].iloc[at : at + 500].to_numpy(), "n": list(map(len, words)), "words": [w.tobytes() for w in words]})
                yield out[out["n"] >= LEAST_WORDS]

    contents = saved(texts.select("content", "text").dropDuplicates(["content"]).mapInPandas(tokenize, "content long, n long, words binary"), "contents")
    rows = saved(texts.select("doc_id", "content").join(contents.select("content", "n"), "content"), "rows")
    parts = stretches(contents)
    alike = linked(parts)

    copies = saved(rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "copies")
    roots = components(alike.select("a", "b"), LAST_LINKS)
    classes = copies.join(roots.withColumnRenamed("node", "content"), "content", "left_outer").withColumn("root", F.coalesce("root", "content"))
    classes = saved(classes.select("content", "copies", "least", "most", "root"), "roots")
    names = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = saved(classes.join(names, "root").drop("root"), "classes")
    sides = alike.select(F.col("a").alias("content"), F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.col("b").alias("other"), "similarity").unionByName(
        alike.select(F.col("b").alias("content"), F.col("start_b").alias("start"), F.col("end_b").alias("end"), F.col("a").alias("other"), "similarity")
    )
    others = classes.select(F.col("content").alias("other"), F.col("least").alias("other_least"), F.col("most").alias("other_most"))
    best = F.max_by(F.struct("similarity", "other_least", "other_most"), F.struct("similarity", "other")).alias("x")
    linked_parts = saved(sides.join(others, "other").groupBy("content", "start", "end").agg(best).select("content", "start", "end", "x.*"), "parts")
    of_class = rows.join(classes, "content")
    by_link = of_class.join(linked_parts, "content").select("doc_id", "start", "end", "class_id", "other_least", "other_most", "similarity")
    whole = of_class.where("copies > 1").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), "class_id", F.col("least").alias("other_least"), F.col("most").alias("other_most"), F.lit(1.0).alias("similarity"))
    partner = F.when(F.col("other_least") == F.col("doc_id"), F.col("other_most")).otherwise(F.col("other_least"))
    out = by_link.unionByName(whole).select("doc_id", "start", "end", "class_id", partner.alias("partner_id"), "similarity")
    return out.where(F.col("doc_id").isNull() | F.col("partner_id").isNull() | (F.col("doc_id") != F.col("partner_id")))


def op10_collinear_chaining(spark, sf_dir):
    return shared_passages(table(spark, sf_dir, "documents"))
