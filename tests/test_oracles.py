"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from triviary import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    con = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in con.fetchall()), key=repr)
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert not catalog.queries()[name](spark, SF).isEmpty()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not entry.entry(spark).isEmpty()
