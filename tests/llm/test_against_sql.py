"""The queries that SQL can express, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    wanted = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in wanted.description)
    at = [[c[0] for c in wanted.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[k] for k in at]) for r in wanted.fetchall())
