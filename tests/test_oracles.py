"""Every registered query against its SQL in DuckDB: same columns, same rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    ours = entry.queries()[name](spark, SF)
    theirs = db.sql(entry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got, want = rows(ours.columns, ours.collect()), rows(theirs.columns, theirs.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert want
