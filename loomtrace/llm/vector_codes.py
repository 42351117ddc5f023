"""Compression of vectors to codes: product quantisation by Lloyd's rounds with Hamerly's bounds, all in integers.

A vector is cut into parts and each part gets the index of the nearest entry of its codebook. Between rounds
every part keeps one upper bound on the distance to its entry and one lower bound on that to the second
nearest, in a table beside the vector. A round moves the bounds by how far the entries moved; only where the
upper bound isn't strictly below the lower one (or below half the way to the next entry) is the part compared
with all entries, in exact integers, so ties always go to the lower index. Bounds are rounded outwards.

Codebooks are of fixed size, so they go to every task and come back through the driver as sums by entry;
these are sums of changes only, added up in each task and then by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, named, saved, table
from .vectors import exact_kind, extent, finite, integers, lists, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Rows compared with all entries at once.
STEP = 4096


def above(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * 1e-12


def below(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * 1e-12


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest entry (the lower index of equals), and the distances to it and to the second nearest."""
    at, first, second = np.empty(len(x), dtype=np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    own = (book * book).sum(axis=1)
    for i in range(0, len(x), STEP):
        some = x[i : i + STEP]
        far = (some * some).sum(axis=1)[:, None] - 2 * (some @ book.T) + own[None, :]
        rows, best = np.arange(len(some)), far.argmin(axis=1)
        at[i : i + STEP], first[i : i + STEP] = best, np.sqrt(far[rows, best].astype(np.float64))
        if len(book) > 1:
            far[rows, best] = far.max()
            second[i : i + STEP] = np.sqrt(far.min(axis=1).astype(np.float64))
    return at, above(first), below(second)


def apart(book: np.ndarray) -> np.ndarray:
    """Half the distance of each entry to the nearest other one."""
    if len(book) < 2:
        return np.full(len(book), np.inf)
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
    np.fill_diagonal(far, np.inf)
    return below(np.sqrt(far.min(axis=1)) / 2)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring at, upper and lower of one part up to date with the entries, which moved; returns how many rows were scanned."""
    order = np.argsort(moved)
    others = np.where(at == order[-1], moved[order[-2]] if len(moved) > 1 else 0.0, moved[order[-1]])
    upper[:], lower[:] = above(upper + moved[at]), below(lower - others)
    limit = np.maximum(lower, apart(book)[at])
    open_rows = np.flatnonzero(~(upper < limit))
    if len(open_rows):  # the exact distance to the own entry may settle it
        rest = x[open_rows] - book[at[open_rows]]
        upper[open_rows] = above(np.sqrt((rest * rest).sum(axis=1).astype(np.float64)))
        open_rows = open_rows[~(upper[open_rows] < limit[open_rows])]
    if len(open_rows):
        at[open_rows], upper[open_rows], lower[open_rows] = scan(x[open_rows], book)
    return len(open_rows)


def assigned(rows: DataFrame, carried: list[str], books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One round over all rows: their parts' entries and bounds, or at the last their codes and errors.

    Rows with an entry carry what a task found: how the number and the sum of the parts of that entry changed.
    """
    parts, entries, width = books.shape
    kind = books.dtype
    schema = rows.select(*carried).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    names = [*carried, "vector", "code", "upper", "lower", "error", "entry", "number", "change"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, change = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        kinds = None
        for b in batches:
            kinds = kinds or [b.schema.field(c).type for c in carried]
            n = len(b)
            x = matrix(b.column("vector"), parts * width, kind).reshape(n, parts, width)
            old = np.full((n, parts), -1) if moved is None else matrix(b.column("code"), parts, np.dtype(np.int64))
            at, upper, lower = old.copy(), np.empty((n, parts)), np.empty((n, parts))
            if moved is not None:
                upper, lower = matrix(b.column("upper"), parts, np.dtype(np.float64)), matrix(b.column("lower"), parts, np.dtype(np.float64))
            error = np.zeros(n, dtype=np.int64)
            for p in range(parts):
                part = x[:, p]
                if moved is None:
                    at[:, p], upper[:, p], lower[:, p] = scan(part, books[p])
                else:
                    assign(part, books[p], moved[p], at[:, p], upper[:, p], lower[:, p])
                if last:
                    rest = part - books[p][at[:, p]]
                    error += (rest * rest).sum(axis=1).astype(np.int64)
                    continue
                new = np.flatnonzero(at[:, p] != old[:, p])
                whole = part[new].astype(np.int64)
                for entry, sign in ((at[new, p], 1), (old[new, p], -1)):
                    known = entry >= 0
                    np.add.at(number, p * entries + entry[known], sign)
                    np.add.at(change, p * entries + entry[known], sign * whole[known])
            none = lambda t: pa.nulls(n, t)  # noqa: B023, E731
            own = [b.column(c) for c in carried]
            if last:
                yield pa.RecordBatch.from_arrays([*own, none(pa.list_(pa.int64())), lists(at, pa.int32()), none(pa.list_(pa.float64())), none(pa.list_(pa.float64())), pa.array(error), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=names)
            else:
                yield pa.RecordBatch.from_arrays([*own, b.column("vector"), lists(at, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=names)
        some = np.flatnonzero((number != 0) | (change != 0).any(axis=1))
        if len(some):
            none = lambda t: pa.nulls(len(some), t)
            yield pa.RecordBatch.from_arrays([*map(none, kinds), none(pa.list_(pa.int64())), none(pa.list_(pa.int32())), none(pa.list_(pa.float64())), none(pa.list_(pa.float64())), none(pa.int64()), pa.array(some.astype(np.int32)), pa.array(number[some]), lists(change[some], pa.int64())], names=names)

    return rows.mapInArrow(run, f"{fields}, vector array<long>, code array<int>, upper array<double>, lower array<double>, error long, entry int, number long, change array<long>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The kept rows (id, the columns in `carry`, code: an index by part, error: squared distance), and the codebooks (part, entry, position).

    Rows whose vector is null or holds null or non-finite components are left out. A component x is
    floor(scale * x). Codebooks start as the parts of the rows of the smallest ids, nulls last, of equal ids
    those of the smallest vector; repeated rows are rows like any other. Fewer rows than entries give fewer
    entries, an empty table none. Vectors shorter than others, or not of whole parts, count as filled up
    with zeros; components so large that an error is no long are refused with a ValueError. Other columns,
    whatever their names, are ignored.
    """
    carried = [id_col, *(c for c in carry if c != id_col)]
    inner = [f"c{i}" for i in range(len(carried))]
    kept = vectors.where(finite(named(vector_col))).select(*(named(c).alias(i) for c, i in zip(carried, inner, strict=True)), integers(named(vector_col), scale).alias("vector"))
    length, most = extent(kept, "vector")
    width = -(-length // parts)
    kind = exact_kind(4 * max(width, 1) * most**2 * parts)
    seeds = kept.orderBy(F.asc_nulls_last("c0"), "vector").select("vector").limit(entries).collect()
    books = matrix(pa.array([r[0] for r in seeds], pa.list_(pa.int64())), parts * width, kind).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    state, moved, written = kept, None, None
    sums = [[[0] * width for _ in range(len(seeds))] for _ in range(parts)]
    counts = np.zeros((parts, len(seeds)), dtype=np.int64)
    for turn in range(rounds + 1 if seeds else 0):
        now = saved(assigned(state, inner, books, moved, turn == rounds), "codes")
        if written is not None:
            dropped(written)
        written, state = now, now.where("entry IS NULL")
        if turn == rounds:
            break
        found = written.where("entry IS NOT NULL")
        for r in found.groupBy("entry").agg(F.sum("number").alias("n")).collect():
            counts[divmod(r["entry"], len(seeds))] += r["n"]
        by_place = found.select("entry", F.posexplode("change").alias("at", "x")).groupBy("entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in by_place.collect():  # a row for each place of each entry
            p, j = divmod(r["entry"], len(seeds))
            sums[p][j][r["at"]] += int(r["x"])
        new = books.copy()
        for p, j in zip(*np.nonzero(counts), strict=True):
            new[p, j] = [s // int(counts[p, j]) for s in sums[p][j]]
        moved = above(np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)))
        books = new
    if not seeds:
        state = kept.select(*inner, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    return state.select(*(F.col(i).alias(c) for c, i in zip(carried, inner, strict=True)), "code", "error"), books


def codebook_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and place, with commas."""
    return ",".join(str(int(x)) for x in books.reshape(-1))


def op11_vector_codes(spark, sf_dir):
    codes, books = compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    digits = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["of_label"])).select(
        "vec_id",
        digits.alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(codebook_text(books).encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """Lloyd's rounds written out; all sums are of integers below 2^53, so doubles are exact."""
    near = """a{n} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.v) AS v, list_inner_product(any_value(x.v), any_value(x.v)) + min(list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v)) AS e,
      arg_min(c.j, {{e: list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v), j: c.j}}) AS j FROM parts x JOIN c{n} c ON c.p = x.p GROUP BY vec_id, x.p)"""
    step = """s{n} AS (SELECT p, j, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS i) GROUP BY ALL),
    u{n} AS (SELECT p, j, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::DOUBLE ORDER BY i) AS v FROM s{n} GROUP BY p, j),
    c{m} AS MATERIALIZED (SELECT c.p, c.j, coalesce(u.v, c.v) AS v FROM c{n} c LEFT JOIN u{n} u ON u.p = c.p AND u.j = c.j)"""
    rounds = ",\n".join(near.format(n=n) + ",\n" + step.format(n=n, m=n + 1) for n in range(ROUNDS)) + ",\n" + near.format(n=ROUNDS)
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{rounds},
codes AS (SELECT vec_id, string_agg(lpad(lower(to_hex(j)), 2, '0'), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(x, ',' ORDER BY p, j)) AS h FROM (SELECT p, j, array_to_string(list_transform(v, lambda x: x::BIGINT), ',') AS x FROM c{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), books
"""


SQL = _sql()
