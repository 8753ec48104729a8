"""Each query of the catalog against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from corvid.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    exp = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(exp.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(exp.fetchall(), exp.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_of_sql_are_queries():
    assert set(SQL) <= set(QUERIES)
