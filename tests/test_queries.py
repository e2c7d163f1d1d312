"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
from numbers import Number
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from koinea.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, Number) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", ["spelling_alignment", "letter_phoneme_alignment", "augmented_distance"])
def test_kernels_see_every_word(spark, tmp_path, name):
    texts = ["one two three four five six seven eight nine ten", "ten eleven"]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.src for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(set(" ".join(texts).split()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
