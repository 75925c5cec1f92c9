"""The training-data queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from keyfold.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql.SQL[name])
    columns = sorted(c[0] for c in cur.description)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    want = sorted(map(repr, (tuple(r[i] for i in sorted(range(len(r)), key=lambda i: cur.description[i][0])) for r in cur.fetchall())))
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want
