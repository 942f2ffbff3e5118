"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return "N" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


CORE = {**entry.registry.ORACLE, **entry.problems.ORACLE}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    compare(spark, con, name, CORE)


def compare(spark, con, name, sql):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(sql[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted([norm(row[names.index(c)]) for c in cols] for row in r.fetchall())
    assert sorted([norm(row[c]) for c in cols] for row in df.collect()) == want
