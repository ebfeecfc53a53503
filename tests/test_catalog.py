"""Every catalogue query with SQL gives the same rows as DuckDB does."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from folio import catalog

catalog.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(frame):
    def cell(v):
        if v is None or v is pd.NA or v != v:  # DuckDB's frames may hold integers as a type with NA
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 6)
        return str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).columns
