"""Every registered observability query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        out.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return out


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert (got[c].isna() == want[c].isna()).all(), c
        a, b = got[c].dropna(), want[c].dropna()
        assert ((a - b).abs() < 2e-6).all() if a.dtype.kind == "f" else (a == b).all(), c


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
