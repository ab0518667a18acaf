"""Every query of the library with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from veriplumb.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert columns and rows
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 45
