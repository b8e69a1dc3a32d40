"""Every query with SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from freshet.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame, columns):
    return sorted(tuple((x != x or x is None, 0 if x != x or x is None else x) for x in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(oracle.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_sql():
    assert queries.queries().keys() == oracle.ORACLE_SQL.keys()
