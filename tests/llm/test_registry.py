"""The registered queries with SQL twins, and that the rest imports without this subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SMALL

from curatrix.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    df = registry.QUERIES[name](spark, SMALL)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    assert sorted([str(r[c]) for c in order] for r in df.collect()) == sorted([str(dict(zip(names, r))[c]) for c in order] for r in found.fetchall())


def test_rest_imports_without_llm():
    code = "import sys; sys.modules['curatrix.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
