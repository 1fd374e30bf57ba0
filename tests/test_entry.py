import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, sql, name):
    frame = catalog.QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*cols).collect())
    cur = sql.execute(catalog.ORACLES[name])
    order = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[order.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(order) == cols and got == want
    # an empty result proves nothing; no given text speaks of a preference, test_text.py has some that do
    assert want or name == "preference_text"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect() is not None


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir("/root/testdata")
