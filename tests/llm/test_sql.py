"""Operators that SQL can express give what DuckDB gives, on the small tables and on odd rows."""

import glob
import os

import duckdb
import pytest

from loomtrace.llm import exact_dedup, line_dedup, queries

DATA = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_tables(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df, r = queries.QUERIES[name](spark, DATA), con.execute(queries.SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df, columns) == sorted(tuple(map(str, x)) for x in r.fetchall())


def test_exact_dedup_odd(spark, odd_docs, no_docs):
    out = exact_dedup.exact_dedup(odd_docs).toPandas()
    assert len(out) == odd_docs.count()
    same = out[out.text_sha256 == out.text_sha256[out.doc_id == 5].iloc[0]]
    assert set(same.keep_id) == {5} and set(same.group_size) == {4} and same.kept.sum() == 1
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_chunks_join_to_the_text(spark, odd_docs):
    from pyspark.sql import functions as F

    texts = odd_docs.where("text IS NOT NULL").select("text", F.array_join(exact_dedup.chunks_of(F.col("text")), "").alias("joined"), F.array_max(F.transform(exact_dedup.chunks_of(F.col("text")), F.length)).alias("longest"))
    assert all(r.text == r.joined and (r.longest or 0) <= exact_dedup.MAX_CHUNK for r in texts.collect())


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    """With a hash of two values all chunks clash, and contents decide."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text number {i % 5} " * 3) for i in range(20)], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(2)))
    out = exact_dedup.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i, 15 + i % 5, 4) for i in range(20)}


def test_line_dedup(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(
        [
            (1, "Posted by user17 on 3 May\nfirst text of its own here\n\nshort line\nThe quick brown fox jumps over the lazy dog today"),
            (2, "Posted by user99 on 8 May\nsecond text of its own there\n\nshort line\nThe quick brown fox jumps over the lazy cat today"),
            (3, "third text is alone with words\nthird text is alone with words"),
            (None, "Posted by user17 on 3 May"),
        ],
        "doc_id long, text string",
    )
    out = {r.doc_id: (r.text, r.n) for r in line_dedup.line_dedup(docs, dropped_col="n").collect()}
    assert out[1][1] == 0 and out[3][1] == 0 and out[None][1] == 0
    assert out[2] == ("second text of its own there\n", 3)  # lines of two words recur too
    clash = docs.withColumnsRenamed({"doc_id": "a.id"}).selectExpr("*", "1 AS lines", "2 AS line_key", "3 AS line_numbers", "4 AS `x.y`", "5 AS __id", "6 AS __lines")
    again = line_dedup.line_dedup(clash, id_col="a.id")
    assert again.columns == clash.columns and {r["a.id"]: r.text for r in again.collect()} == {i: t for i, (t, _) in out.items()}
    odd = line_dedup.line_dedup(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count() and odd.where("text IS NULL").count() == 2
    assert line_dedup.line_dedup(no_docs).count() == 0
