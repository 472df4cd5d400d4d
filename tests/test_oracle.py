"""Every core query against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pandas as pd
import pytest

from vellumspark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(([plain(v) for v in r] for r in frame.values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    ours = core.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(core.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_has_rows(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0
