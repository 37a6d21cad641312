"""Each query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = plans.QUERIES[name](spark, SF)
    wanted = con.execute(plans.ORACLES[name])
    columns = sorted(c[0] for c in wanted.description)
    at = [[c[0] for c in wanted.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted([_plain(r[c]) for c in columns] for r in df.collect()) == sorted([_plain(r[k]) for k in at] for r in wanted.fetchall())


def test_queries_without_sql_repeat(spark):
    for name in sorted(set(plans.QUERIES) - set(plans.ORACLES)):
        once, again = (sorted(map(tuple, plans.QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert once and once == again
