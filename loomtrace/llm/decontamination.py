"""Benchmark items that training documents contain, as they are or edited.

Runs of three words of the items are looked up in the documents, and every shared run is a seed, however
many documents have it. Items of which the document has too few words go at once. A seed joins the passage
around it to the item, and a Smith-Waterman alignment of the words tells how much of the item the passage
holds. Three words suffice to miss nothing by substitution: of n words with a fifth replaced, three in a
row are left.

The items are the stated query set. They go to every task in blocks of at most BLOCK_WORDS words, so what
is broadcast has a fixed bound; the documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

RUN, SIMILARITY = 3, 0.8
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Cells of an alignment matrix; beyond, the text is aligned in tiles.
CELLS = 8_000_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of a matched by the best local alignment with b, and the part of b that it takes: (matches, start, end)."""
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    back = -GAP * np.arange(len(b) + 1)
    for i, x in enumerate(a):
        row = np.maximum(h[i] + GAP, 0)
        row[1:] = np.maximum(row[1:], h[i, :-1] + np.where(b == x, MATCH, MISMATCH))
        h[i + 1] = np.maximum.accumulate(row + back) - back
    i, end = np.unravel_index(int(h.argmax()), h.shape)
    j, matches = end, 0
    while h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matches, int(j), int(end)


def align_in_tiles(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same with bounded memory: an alignment worth more than 0 spans less than three times a's words, so it lies whole in one of the tiles of six times as many."""
    step = 3 * len(a)
    if len(a) * len(b) <= CELLS or len(b) <= 2 * step:
        return align(a, b)
    found = [(m, -(at + start), at + end) for at in range(0, len(b) - step, step) for m, start, end in (align(a, b[at : at + 2 * step]),)]
    m, start, end = max(found)
    return m, -start, end


@dataclass
class Items:
    """A block of items: their words as numbers, and the runs of three as sorted keys.

    Where a key has several places, and an item several words, they stand one after the other; `first` and
    `word_first` tell where those of each begin.
    """

    ids: list
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    keys: np.ndarray  # distinct runs, sorted
    first: np.ndarray
    at_item: np.ndarray  # item and place of each run
    at_place: np.ndarray
    word_first: np.ndarray
    word: np.ndarray  # distinct words of each item, and how often it has each
    often: np.ndarray
    short: dict[int, list[int]]  # items of fewer than three words, by their first word
    seen: np.ndarray | None = None  # times a text has each word; zeros between texts

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int64) for _, text in rows]
        found: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            for p, k in enumerate(runs(w).tolist()):
                found.setdefault(k, []).append((n, p))
            if 0 < len(w) < RUN:
                short.setdefault(int(w[0]), []).append(n)
        keys = np.array(sorted(found), dtype=np.int64)
        at = [found[k] for k in keys.tolist()]
        places = np.array([x for some in at for x in some], dtype=np.int64).reshape(-1, 2)
        distinct = [np.unique(w, return_counts=True) for w in words]
        word, often = (np.concatenate([d[i] for d in distinct]) for i in (0, 1))
        return cls([i for i, _ in rows], vocabulary, words, keys, starts(map(len, at)), places[:, 0], places[:, 1], starts(len(d[0]) for d in distinct), word, often, short)

    def numbers(self, text: str) -> np.ndarray:
        """The document's words; -1 for those of no item."""
        return np.fromiter(map(self.vocabulary.get, words_of(text), repeat(-1)), dtype=np.int64)

    def hits(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document that begin one of `keys`, and which."""
        k = runs(numbers)
        places = np.flatnonzero(k >= 0)
        if not len(places) or not len(keys):
            return places[:0], places[:0]
        which = np.minimum(np.searchsorted(keys, k[places]), len(keys) - 1)
        same = keys[which] == k[places]
        return places[same], which[same]

    def held(self, items: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many words of each item the text has, in any order: no alignment matches more."""
        if self.seen is None:
            self.seen = np.zeros(len(self.vocabulary), dtype=np.int64)
        words, n = np.unique(text[text >= 0], return_counts=True)
        self.seen[words] = n
        at, sizes = spread(self.word_first, items)
        total = np.add.reduceat(np.minimum(self.seen[self.word[at]], self.often[at]), np.cumsum(sizes) - sizes)
        self.seen[words] = 0
        return total

    def regions(self, numbers: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The parts of the text around the runs it shares with items that it may hold, by item."""
        places, which = self.hits(numbers, self.keys)
        if not len(places):
            return {}
        items = np.unique(self.at_item[spread(self.first, np.unique(which))[0]])
        maybe = np.zeros(len(self.words), dtype=bool)
        lengths = np.array([len(self.words[i]) for i in items.tolist()])
        maybe[items] = self.held(items, numbers) >= SIMILARITY * lengths
        if not maybe.any():
            return {}
        out: dict[int, list[tuple[int, int]]] = {}
        at, sizes = spread(self.first, which)
        ok = maybe[self.at_item[at]]
        at, p = at[ok], np.repeat(places, sizes)[ok]
        for item, shift in np.unique(np.stack((self.at_item[at], p - self.at_place[at]), axis=1), axis=0).tolist():
            n = len(self.words[item])
            out.setdefault(item, []).append((max(0, shift - n // 2), shift + n + n // 2 + 1))
        return out

    def matches(self, numbers: np.ndarray) -> Iterator[tuple]:
        """(item, similarity, first word, end) of the items that the document holds, the best place of each."""
        regions = self.regions(numbers)
        for first, items in self.short.items():
            for item in items:
                regions[item] = [(int(p), int(p) + len(self.words[item])) for p in np.flatnonzero(numbers == first)]
        for item, spans in regions.items():
            a = self.words[item]
            one, least = np.array([item]), SIMILARITY * len(a)
            best = (0, 0, 0)
            merged: list[list[tuple[int, int]]] = []
            to = -1
            for s, e in sorted(spans):
                if merged and s < to:
                    merged[-1].append((s, e))
                else:
                    merged.append([(s, e)])
                to = max(to, e)
            for some in merged:
                # Where the best alignment of all together is of too few words, another part may hold the item yet.
                for s, e in dict.fromkeys([(some[0][0], max(e for _, e in some)), *some]):
                    b = numbers[s:e]
                    if self.held(one, b)[0] >= least:
                        m, start, end = align_in_tiles(a, b)
                        best = max(best, (m, -(s + start), s + end))
                        if m >= least:
                            break
            if best[0] >= SIMILARITY * len(a) and best[0]:
                yield self.ids[item], best[0] / len(a), -best[1], best[2]


def starts(sizes: Iterable[int]) -> np.ndarray:
    """Where each of parts of these sizes begins, and where the last ends."""
    return np.cumsum([0, *sizes])


def spread(first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all members of `parts`, part by part, and how many each has."""
    sizes = first[parts + 1] - first[parts]
    return np.arange(sizes.sum()) + np.repeat(first[parts] - np.cumsum(sizes) + sizes, sizes), sizes


def runs(numbers: np.ndarray) -> np.ndarray:
    """A key for each run of three words, below 0 if one of them is in no item. Keys are hashes: what they let meet is aligned."""
    if len(numbers) < RUN:
        return np.zeros(0, dtype=np.int64)
    a, b, c = (numbers[i : len(numbers) - 2 + i].astype(np.uint64) for i in range(RUN))
    h = ((a * ODD + b) * ODD + c) * ODD
    h = (h ^ (h >> np.uint64(32))) * ODD
    return np.where((numbers[:-2] | numbers[1:-1] | numbers[2:]) >= 0, (h >> np.uint64(1)).view(np.int64), -1)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WORDS words, as they are counted here, or of one item, fetched one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text")).toLocalIterator():
        n = 1 + len(words_of(r["text"]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, end): the items of which documents hold 0.8 or more.

    similarity is the share of the item's words that the best alignment matches; start and end count the
    document's words. Words are runs of letters, digits and underscores in lower case. Null texts and
    items count as empty, and empty ones match nothing; items of fewer than three words match where they
    stand as they are; repeated documents and items each give their rows; a null id gives rows with a
    null. Without items or documents the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kinds = texts.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start long, end long"
    out = spark.createDataFrame([], schema)
    for rows in blocks(benchmark, item_col, item_text_col):
        items = Items.of(rows)
        shared = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            for b in batches:
                rows = [(doc_id, *m) for doc_id, t in zip(b["doc_id"].tolist(), b["text"], strict=True) for m in block.matches(block.numbers(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "start", "end"])

        out = out.unionByName(texts.mapInPandas(find, schema))
    return out


def op6_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
