"""Every library query runs on the smallest tables and equals its SQL there."""

import os

import pytest

import __spark_entry__
from tallyframe.plans import queries as library

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def norm(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    df = library.QUERIES[name](spark, DATA)
    rows = df.collect()
    sql = library.SQL.get(name)
    if not sql:
        return
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    r = db.sql(sql)
    columns = r.columns
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(norm(x[c]) for c in columns) for x in rows) == sorted(tuple(map(norm, x)) for x in r.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
