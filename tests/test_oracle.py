"""Every query that has a SQL twin, against DuckDB."""

import os

import duckdb
import pytest

from sparkloom.plans import registry


def cells(row):
    return tuple("NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, sf, con):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = con.execute(registry.ORACLE_SQL[name])
    order = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
    assert [want.description[i][0] for i in order] == names
    assert sorted(cells(r) for r in df.select(*(f"`{n}`" for n in names)).collect()) == sorted(cells(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0
