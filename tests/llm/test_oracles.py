"""Registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

pytest.importorskip("tideline.llm")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_quote_links", "op6_line_dedup", "op8_url_filter", "op9_ngram_join"])
def test_matches_sql(spark, name):
    from tideline.llm import registry

    if name not in registry.oracle_sql():
        pytest.skip("no SQL")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got, want = (sorted(map(tuple, rows), key=repr) for rows in (df.select(*names).collect(), found.fetchall()))
    assert len(got) == len(want) and got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]
