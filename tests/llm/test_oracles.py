"""Registered queries with SQL, held against DuckDB on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from colloquy.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


def norm(rows):
    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(x) for x in r) for r in rows), key=repr)


def test_every_operator_is_registered():
    numbers = {int(n.split("_")[0][2:]) for n in QUERIES}
    assert numbers == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = E.queries()[name](spark, SMALL)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    at = [cols.index(c) for c in got.columns]
    assert norm(got.collect()) == norm([[r[i] for i in at] for r in cur.fetchall()])
