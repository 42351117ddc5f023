"""Vector codes, hard negatives and shards against brute force, on odd rows and on hot groups."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import negatives, sharding, vector_codes
from loomtrace.llm.vectors import finite

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, entry int, c0 long, `a.b` string"


def clustered(n, d, seed, hot=0.3):
    """Rows around few centres, a third of them one and the same vector, with ties and unusable rows."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.3, 0.3) for _ in range(d)] for _ in range(6)]
    one = [round(x, 2) for x in centres[0]]
    rows = []
    for i in range(n):
        v = one if rng.random() < hot else [rng.choice([rng.gauss(c, 0.05), round(c, 1)]) for c in centres[rng.randrange(6)]]
        rows.append((i, list(v), rng.choice([0, 0, 0, 1, 2, 3, None])))
    rows += [(n, None, 1), (n + 1, [math.nan] * d, 1), (n + 2, [None] * d, 1), (n + 3, [math.inf] + [0.0] * (d - 1), 2), (n + 4, [-0.5] * d, 5), (50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]), (None, [0.25] * d, 0), (None, [0.25] * d, 1)]
    return [(i, v, x, "mine", 1, 2, 3, "x") for i, v, x in rows]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, entries, rounds, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if usable(v)]
    width = len(kept[0][1]) // parts
    x = np.array([v for _, v in kept]).reshape(-1, parts, width)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = x[order].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
        at = far.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for j in range(books.shape[1]):
                    if (at[:, p] == j).any():
                        books[p, j] = x[at[:, p] == j, p].sum(axis=0) // (at[:, p] == j).sum()
    return sorted((str(kept[k][0]), tuple(at[k].tolist()), int(far[k].min(axis=1).sum())) for k in range(len(kept))), books


@pytest.mark.parametrize(("n", "entries"), [(400, 16), (5, 16), (300, 1)])
def test_codes(spark, n, entries):
    rows = clustered(max(n, 60), 8, n)[-n - 9 :] if n < 60 else clustered(n, 8, n)
    out, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries, carry=("label", "a.b"))
    expected, plain = plain_codes(rows, entries, vector_codes.ROUNDS)
    assert out.columns == ["vec_id", "label", "a.b", "code", "error"]
    assert (books == plain).all()
    assert sorted((str(r.vec_id), tuple(r.code), r.error) for r in out.collect()) == expected


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    out, books = vector_codes.compress(none)
    assert out.collect() == [] and books.size == 0
    unfit, _ = vector_codes.compress(spark.createDataFrame([(1, [math.nan], 1), (2, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert unfit.collect() == []
    short, books = vector_codes.compress(spark.createDataFrame([(1, [0.5, 0.25, 1.0, 2.0, 3.0]), (2, [0.5]), (3, [])], "vec_id long, embedding array<double>"))
    assert {(r.vec_id, tuple(r.code), r.error) for r in short.collect()} == {(1, (0, 0, 0, 0), 0), (2, (1, 1, 1, 0), 0), (3, (2, 1, 1, 0), 0)}
    assert books.shape == (4, 3, 2)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"))


def test_bounds_save_scans_and_keep_ties():
    """Over rounds of moving entries the bounded assignment is the plain one, and most parts are not scanned."""
    rng = np.random.default_rng(5)
    book = rng.integers(-300, 300, (40, 6)).astype(float)
    book[7], book[20] = book[3], book[3] + 0  # equal entries: the lower index wins
    x = (book[rng.integers(0, 40, 3000)] + rng.integers(-12, 13, (3000, 6))).astype(float)
    at, upper, lower = vector_codes.scan(x, book)
    scanned = 0
    for turn in range(6):
        new = book + rng.integers(-6 + turn, 7 - turn, book.shape) if turn < 6 else book
        new[7] = new[3]
        moved = vector_codes.above(np.sqrt(((new - book) ** 2).sum(axis=1)))
        book = new
        scanned += vector_codes.assign(x, book, moved, at, upper, lower)
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (at == far.argmin(axis=1)).all()
        true = np.sqrt(far[np.arange(len(x)), at])
        far[np.arange(len(x)), at] = np.inf
        assert (upper >= true).all() and (lower <= np.sqrt(far.min(axis=1))).all()
    assert scanned < 0.3 * 6 * len(x)


def plain_negatives(rows, anchor):
    r = [(i, x, np.array([math.floor(256 * y) for y in v], dtype=object)) for i, v, x, *_ in rows if usable(v) and x is not None]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for k, (i, x, v) in enumerate(r):
        if i is None or not anchor(i):
            continue
        scored = [(int(v @ w), j, y, m) for m, (j, y, w) in enumerate(r) if m != k]
        for s, j, *_ in sorted((s for s in scored if s[2] == x), key=order)[:5]:
            window = sorted((t for t in scored if t[2] != x and 50 * s <= 100 * t[0] <= 95 * s), key=order)[:3]
            out += [(i, j, n + 1, t[1], s, t[0]) for n, t in enumerate(window)]
    return Counter(out)


@pytest.mark.parametrize(("group", "block", "pivots"), [(512, 16_384, 32), (4, 40, 5), (1, 7, 1)])
def test_negatives(spark, monkeypatch, group, block, pivots):
    """Groups, blocks and cells of any size give the rows of brute force; a third of the rows are one vector, an anchor's row is repeated."""
    for name, value in (("GROUP", group), ("BLOCK", block), ("PIVOTS", pivots)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(300, 6, 21)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(expected) > 100 and Counter(map(tuple, got.collect())) == expected


def test_cells_hold_back_rows(spark, monkeypatch):
    """Far cells are not sent to a group: fewer rows than rows times groups meet the anchors."""
    monkeypatch.setattr(negatives, "GROUP", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (8, 12))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.02, 12)).tolist(), i % 3) for i in range(800)]
    sent = []
    real = negatives.saved
    monkeypatch.setattr(negatives, "saved", lambda df, tag: (out := real(df, tag), sent.append((tag, out)))[0])
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    plans = [df for tag, df in sent if tag == "serving-cells"]
    groups = plans[0].select("key", "home", "chunk").distinct().count()
    assert plans[0].agg(F.sum("n")).collect()[0][0] < 0.6 * 800 / 3 * groups


def test_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("vec_id") % 2 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (3, [1.0, 2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(alone, F.col("vec_id") % 2 == 0).collect() == []
    assert negatives.hard_negatives(alone, F.lit(None).cast("boolean")).collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e12, 1.0], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True)).collect()


def test_finite(spark):
    rows = [([1.0, 2.0], True), ([], True), (None, False), ([None, 1.0], False), ([math.nan], False), ([-math.inf, 1.0], False)]
    df = spark.createDataFrame(rows, "v array<float>, ok boolean")
    assert df.where(finite(F.col("v")) != F.col("ok")).count() == 0


def spread(out, n, shards):
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(slots) == list(range(min(n, shards))) or n < shards
    assert max(map(len, slots.values()), default=0) - (min(map(len, slots.values()), default=0) if len(slots) == shards else 0) <= 1


def test_shards(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = sharding.shard(docs, bucket_bytes=20_000)
    rows = out.collect()
    spread(rows, docs.count(), 8)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.lang) for r in rows) == Counter((r.doc_id, r.text, r.lang) for r in docs.collect())
    where = {(r.doc_id, r.text): (r.shard, r.slot) for r in rows}
    again = sharding.shard(docs.repartition(7, "lang"), bucket_bytes=20_000).collect()
    assert where == {(r.doc_id, r.text): (r.shard, r.slot) for r in again}  # not a matter of files and partitions
    other = sharding.shard(docs, bucket_bytes=20_000, seed=7).collect()
    moved = sum(where[r.doc_id, r.text] != (r.shard, r.slot) for r in other)
    assert moved > 0.9 * len(other)
    assert sharding.shard(no_docs).collect() == []
    odd = odd_docs.withColumnsRenamed({"lang": "row_key", "source": "row_bucket", "n_tokens": "a.b"}).withColumns({"row_place": F.lit(1), "row_start": F.lit("x"), "of_bucket": F.create_map(F.lit("k"), F.lit(1))})
    got = sharding.shard(odd, shards=3)
    assert got.columns == [*odd.columns, "shard", "slot"]
    spread(got.collect(), odd.count(), 3)


def test_shards_of_repeated_rows(spark, monkeypatch):
    """Rows that are all alike, far more than a bucket holds, are dealt over the buckets."""
    docs = spark.createDataFrame([(1, "the same text again") for _ in range(4000)] + [(i, f"text {i}") for i in range(3000)], "doc_id long, text string").repartition(6)
    kept = []
    real = sharding.saved
    monkeypatch.setattr(sharding, "saved", lambda df, tag: (out := real(df, tag), kept.append((tag, out)))[0])
    rows = sharding.shard(docs, bucket_bytes=30_000).collect()
    spread(rows, 7000, 8)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    counts = [r[1] for r in dict(kept)["shuffled-buckets"].groupBy("row_bucket").count().collect()]
    assert len(counts) > 10 and max(counts) < 2 * np.mean(counts)
    same = Counter(r.shard for r in rows if r.doc_id == 1)
    assert len(same) == 8 and max(same.values()) < 1.3 * min(same.values())


def test_shards_are_written(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sharding.write_shards(sharding.shard(docs, shards=4, bucket_bytes=9000), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    spread(back.collect(), 1000, 4)
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 == docs.exceptAll(back.select("doc_id", "text")).count()


def test_shard_query(spark):
    out = sharding.op12_external_shuffle(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = out.collect()
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    spread(rows, len(texts), 8)
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items()}
