"""Queries that SQL can express give the same rows as DuckDB, over the whole tables."""

import duckdb
import pytest

from veriplumb.llm.queries import ORACLE_SQL, QUERIES

from .cases import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[found.columns.index(k)]) for k in columns) for r in found.fetchall()), key=repr)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
