"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_registry_is_complete():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine, "a query without rows checks nothing"
    if name not in entry_module.oracle_sql():
        return
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert {d[0]: str(d[1]) for d in cur.description} == {c: TYPES[t] for c, t in df.dtypes}
    at = [names.index(c) for c in cols]
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
