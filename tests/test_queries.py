"""Every registered query of the library against its SQL on the smallest tables that hold its boxes."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from stepgrid.plans import queries as plans

SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the data tables are not there")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_rows_equal_sql(spark, tables, name):
    got = plans.QUERIES[name](spark, str(SF))
    columns = sorted(got.columns)
    want = tables.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert rows(got.select(columns).collect()) == rows([r[i] for i in order] for r in want.fetchall())
