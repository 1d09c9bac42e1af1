"""Every registered query against its DuckDB twin (row count, columns, values)."""

import decimal
import os

import duckdb
import pytest

from touchline import catalog


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else v
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    assert not isinstance(v, decimal.Decimal)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert mine == theirs
