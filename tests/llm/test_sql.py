"""The registered queries of the corpus operators against their SQL in DuckDB."""

import math

import duckdb
import pytest

from koinea.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return con


def plain(rows):
    out = [tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(map(tuple, found.select(*columns).collect())) == plain(want)
    assert want
