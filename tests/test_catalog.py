"""Catalogue queries against DuckDB on the smallest driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from vitaeflow.plans import catalog, problems, repairs

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | repairs.QUERIES | problems.QUERIES
ORACLE = catalog.ORACLE | repairs.ORACLE | problems.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or pd.isna(x):
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(ORACLE[name]).fetchdf()
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns
