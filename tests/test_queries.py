"""Each query against its SQL in DuckDB, rows without order."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [names[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1], [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
