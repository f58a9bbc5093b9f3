"""Corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

pytest.importorskip("tidemark.llm.queries")
import duckdb

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda table: sorted((tuple(x) for x in table), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())
