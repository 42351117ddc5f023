"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Documents are range-sorted by length, longest first, so that pieces of one length are a run of ranks and
need no names in a match; gaps of one size are a run of sequences. A round sends each run of pieces to the
successor of its length, the smallest gap size that holds it, range-partitions pieces and gaps by that size
and sweeps each range in a task: longest pieces first, each to the smallest gap that holds it; ranks settle
which pieces of a run get the gaps. Matched gaps are updated, what is left goes to the next round. Where no
gap holds any piece that is left, as many sequences are opened as their tokens fill at least. Lengths go in
bands, the longest first, so that short pieces don't take the gaps of longer ones.

Lengths and gaps lie between 1 and the sequence length, so runs are few, whatever the number of documents;
ranks and places are worked out by Spark for each piece.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, saved, table, text_of
from .token_count import byte_letters

ROOM = 2048
#: Ranges of gap sizes that a round sweeps at once; lengths of a band are at most BAND times as long as others in it.
RANGES, BAND = 4, 8
#: Words whose identifiers a worker remembers; beyond, it forgets them all before the next text and starts anew.
REMEMBERED = 400_000
#: White space as tokenizers see it; Python's own split() also cuts at the four separators U+001C to U+001F.
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: A full stop or comma between a letter or digit and white space is a word of its own for the tokenizer too.
#: Not after U+0130: its small letter ends in a combining dot, which the tokenizer joins with the stop.
#: The sign comes first and is looked back at, so that the search jumps from sign to sign.
END = re.compile(r"([.,])(?<=[^\W_][.,])(?<!\u0130[.,])(?=\s|$)")
#: The special strings. They are looked for as they stand, before any letter is made small.
SPECIAL = re.compile(r"(<\|(?:startoftext|endoftext)\|>)")
#: Marks that join with a letter before them; some join with small letters only, so such texts are left to the library.
MARKS = re.compile("[\u0300-\u036f]")


def small(text: str) -> str:
    """The text with A-Z made small, where that leaves the tokenizer's ids as they are."""
    if not text.isascii() and MARKS.search(text):
        return text
    if "<|" not in text:
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    # What becomes a special string only by small letters is cut where the tokenizer cuts words anyhow.
    parts = SPECIAL.split(text)
    for i in range(0, len(parts), 2):
        parts[i] = SPECIAL.sub(lambda m: f"<| {m.group(1)[2:-2]} |>", parts[i].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    return "".join(parts)
#: Below, all letters are in composed form or have no other.
LATIN_END = "\u0250"


class Remembered(dict):
    """What `make` gives for a key, made when it is first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class WordIds:
    """Token identifiers of texts, as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space, lower-case, and cut words into runs of letters and others before
    byte-level BPE: a text's identifiers are those of its words one after the other. The library encodes
    each word once, a plain word of Latin letters by its BPE model alone, and the worker remembers it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.known = Remembered(lambda word: array("I", self.ids(word)).tobytes())

    def ids(self, word: str) -> list[int]:
        if word.isalpha() and word[-1] < LATIN_END and max(word) < LATIN_END and word == word.lower():
            return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in word.encode()]))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            t = END.sub(r" \1", small(t))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            out.append(b"".join(map(self.known.__getitem__, SPACE.split(t) if SEPARATORS.search(t) else t.split())))
        return out


def word_ids(path: str) -> WordIds:
    return held(("word ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, room: int = ROOM, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `room` tokens: doc_id, piece, start, length, ids_crc32. Each document ends with `end_id`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = word_ids(path), np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            names, texts = b["doc_id"].tolist(), b["text"].tolist()
            at = 0
            while at < len(texts):  # some 4 MB of text at a time
                to, size = at, 0
                while to < len(texts) and (size == 0 or size + len(texts[to]) <= 4 << 20):
                    size += len(texts[to]) + 1
                    to += 1
                rows = []
                for name, data in zip(names[at:to], ids.encode(texts[at:to]), strict=True):
                    data = memoryview(data + end)
                    rows += [(name, k // (4 * room), k // 4, len(p := data[k : k + 4 * room]) // 4, zlib.crc32(p)) for k in range(0, len(data), 4 * room)]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = to

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], room: int = ROOM) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Best fit of runs of pieces (length, first rank, number) into runs of gaps (size, first sequence, number), longest first.

    Matches (length, first rank, number, first sequence, offset), pieces left and gaps left. Piece rank + k of
    a match goes to sequence first + k.
    """
    free: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []  # of the gaps, ascending

    def put(gap: int, first: int, number: int) -> None:
        if gap:
            if gap not in free:
                bisect.insort(sizes, gap)
                free[gap] = deque()
            free[gap].append((first, number))

    for gap in gaps:
        put(*gap)
    matches, over = [], []
    for length, rank, left in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, number = free[gap].popleft()
            if not free[gap]:
                del free[gap], sizes[at]
            if number > left:
                put(gap, first + left, number - left)
                number = left
            matches.append((length, rank, number, first, room - gap))
            put(gap - length, first, number)
            rank, left = rank + number, left - number
        if left:
            over.append((length, rank, left))
    return matches, over, [(gap, *run) for gap, some in free.items() for run in some]


RUNS = "kind string, length long, rank long, number long, gap long, first long"


def sweep_round(runs: DataFrame, low: int, room: int) -> DataFrame:
    """One round over the runs of pieces longer than `low` and of gaps; pieces stand at their successor, `gap`. Matches are carried along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat([pd.DataFrame(columns=["kind"]), *batches])
        if not len(t):
            return
        rows = lambda kind, *columns: list(t.loc[t["kind"] == kind, list(columns)].astype("int64").itertuples(index=False, name=None))
        matches, over, gaps = sweep(rows("piece", "length", "rank", "number"), rows("gap", "gap", "first", "number"), room)
        out = [("match", length, rank, n, room - offset, first) for length, rank, n, first, offset in matches]
        out += [("piece", length, rank, n, length, 0) for length, rank, n in over] + [("gap", 0, 0, n, gap, first) for gap, first, n in gaps]
        yield pd.DataFrame(out, columns=["kind", "length", "rank", "number", "gap", "first"])

    now = (F.col("kind") == "gap") | ((F.col("kind") == "piece") & (F.col("length") > low))
    swept = runs.where(now).repartitionByRange(RANGES, "gap").sortWithinPartitions("gap").mapInPandas(run, RUNS)
    return saved(swept.unionByName(runs.where(~now)), "sweep")


def swept(counts: DataFrame, room: int = ROOM) -> DataFrame:
    """The matches of all pieces, of which counts has (length, number): RUNS, with the size of the gap that was taken in `gap`."""
    spark, opened, low = counts.sparkSession, 0, room // BAND
    runs = saved(counts.select(F.lit("piece").alias("kind"), "length", F.lit(0).cast("long").alias("rank"), "number", F.col("length").alias("gap"), F.lit(0).cast("long").alias("first")), "sweep")
    while True:
        # At most a row for each length and each size of a gap.
        seen = runs.where("kind <> 'match'").groupBy("kind", F.when(F.col("kind") == "piece", F.col("length")).otherwise(F.col("gap")).alias("size")).agg(F.sum("number").alias("number")).collect()
        left = {r["size"]: r["number"] for r in seen if r["kind"] == "piece" and r["size"] > low}
        if not left:
            if not any(r["kind"] == "piece" for r in seen):
                return runs
            low = 0 if low < BAND else low // BAND
            continue
        sizes = sorted(r["size"] for r in seen if r["kind"] == "gap")
        if not sizes or sizes[-1] < min(left):
            new = max(1, sum(length * n for length, n in left.items()) // room)
            runs = runs.unionByName(spark.createDataFrame([("gap", 0, 0, new, room, opened)], RUNS))
            opened, sizes = opened + new, [*sizes, room]
        successor = F.coalesce(F.get(F.filter(F.array(*map(F.lit, sizes)), lambda g: g >= F.col("length")), F.lit(0)), F.lit(room + 1))
        runs = sweep_round(runs.withColumn("gap", F.when(F.col("kind") == "piece", successor.cast("long")).otherwise(F.col("gap"))), low, room)


def pack(docs: DataFrame, path: str, room: int = ROOM, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and is one piece, the end mark. Pieces of one length are interchangeable; ties
    are settled by id, piece and start. Repeated rows and null ids are documents like any other. An empty
    table gives an empty result; other columns are ignored. Documents up to `room` tokens are never cut.
    """
    cut = saved(pieces(docs, path, room, end_id, id_col, text_col), "pieces")
    parts = max(1, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = saved(ranked, "ranked-pieces")
    # At most a row for each length and partition: a partition holds neighbouring lengths only.
    runs = sorted((r["part"], -r["length"], r["first"], r["n"]) for r in ranked.groupBy(F.shiftright("at", 33).alias("part"), "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    before = []
    for _, length, first, n in runs:
        before.append((-length, first, counts.get(-length, 0)))
        counts[-length] = counts.get(-length, 0) + n
    spark = cut.sparkSession
    found = swept(spark.createDataFrame(sorted(counts.items()), "length long, number long"), room).where("kind = 'match'")
    matches = np.array([(r["length"], r["rank"], r["number"], r["first"], room - r["gap"]) for r in found.collect()], dtype=np.int64).reshape(-1, 5)
    steps = np.array(before, dtype=np.int64).reshape(-1, 3)
    steps = steps[np.argsort(steps[:, 1])]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (matches[:, 0] << 44) + matches[:, 1]
        by = np.argsort(keys)
        for b in batches:
            at, length = b["at"].to_numpy(), b["length"].to_numpy()
            s = steps[np.searchsorted(steps[:, 1], at, side="right") - 1]
            rank = at - s[:, 1] + s[:, 2]
            m = matches[by[np.searchsorted(keys[by], (length << 44) + rank, side="right") - 1]]
            yield b.drop(columns="at").assign(sequence_id=m[:, 3] + rank - m[:, 1], offset=m[:, 4])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
