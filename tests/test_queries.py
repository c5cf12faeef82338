"""Every query with SQL gives what DuckDB gives; a few hold golden values and identities."""

import math
import os

import pytest

from tarn.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


def norm(v):
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    for r in rows:
        assert all(not (isinstance(v, float) and math.isnan(v)) for v in r)
