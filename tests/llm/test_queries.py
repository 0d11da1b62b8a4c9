"""Queries with SQL give the same rows in DuckDB."""

import pytest

from talus.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    theirs = sorted(tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall())
    assert sorted(map(tuple, df.collect())) == theirs and (theirs or name == "op11_hard_negatives")
