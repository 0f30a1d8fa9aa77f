"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
CORE = [m for m in entry._MODULES if ".llm." not in m.__name__]
NAMES = sorted(k for m in CORE for k in m.QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(f"{float(r[i]):.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


def test_every_query_has_sql_or_a_reason():
    assert {k for m in CORE for k in m.QUERIES} - {k for m in CORE for k in m.SQL} == {"random_policy", "p2_features"}


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/shardloom/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "llm" not in open(f).read(), f
