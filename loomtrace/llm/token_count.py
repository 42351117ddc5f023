"""Token counts of byte-level BPE, by a heap and a linked list.

Only the number of tokens is wanted, so no identifiers are made: a word of n bytes starts as n symbols,
each merge takes one away, and special strings count one each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Fixed value: the published pattern that cuts text into words before byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose count a worker remembers; beyond, it forgets them all and starts anew.
REMEMBERED = 400_000
OVER = 1024


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordCounts(dict):
    """Word to number of tokens; counts a word when it is first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.count(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        """Pop the lowest-rank adjacent pair (the leftmost of equals) until none is left."""
        parts: list[str | None] = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n, ranks = len(parts), self.ranks
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # one of the two has gone into another symbol since
            parts[i], parts[j], k, h = a + b, None, after[j], before[i]
            after[i] = k
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return n - merges


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from text to token count, made once in each worker."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    words = WordCounts({(a, b): r for r, (a, b) in enumerate(merges)})
    special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))) or r"(?!)")
    cut, count = regex.compile(WORDS), words.__getitem__

    def tokens(text: str) -> int:
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(count, cut.findall(p))) for p in parts)

    return tokens


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > over).

    `path` names a tokenizer file of the byte-level kind, which every worker can open. Null counts as
    empty, with 0 bytes and 0 tokens; repeated rows and null ids are counted like any other; an empty
    table gives an empty result; other columns are ignored. A word of any length takes n log n steps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [tokens(t) for t in b["text"]]})

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
