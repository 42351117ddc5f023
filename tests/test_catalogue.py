"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomtrace.plans import calculations, catalogue, evidence, references, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"


def normal(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    r = con.execute(catalogue.SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(normal(row[c]) for c in columns) for row in df.collect()) == sorted(tuple(map(normal, row)) for row in r.fetchall())
