"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenqc import queries
from lumenqc import raster_queries  # noqa: F401  it registers its queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(table):
    plain = lambda v: round(float(v), 9) if isinstance(v, float) and not math.isnan(v) else None if v != v else v
    return sorted(str([plain(v) for v in r]) for r in table[sorted(table.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 1
