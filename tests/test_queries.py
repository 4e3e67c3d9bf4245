"""Every query with SQL against DuckDB on the smallest tables, and all others for rows."""

import duckdb
import pytest

from marginmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(got, df.columns) == rows_of(want.fetchall(), cols)
    else:
        assert df.columns and got
