"""Every query with a SQL twin gives the same rows as DuckDB on the same files."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest
from conftest import SMALL

from curatrix import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def shown(value) -> str:
    return f"{float(value):.6g}" if isinstance(value, float | decimal.Decimal) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted([shown(dict(zip(names, r))[c]) for c in order] for r in found.fetchall())
    assert sorted([shown(r[c]) for c in order] for r in rows) == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
