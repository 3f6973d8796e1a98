"""Every registered query of the library against its DuckDB statement, on the smallest tables."""

import math
import os

import duckdb
import pytest

from recollect.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)


def test_limiter_in_order(spark):
    from recollect.operators import windows

    rows = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 61)], "k int, s double").selectExpr("k", "timestamp_seconds(s) AS ts")
    got = windows.rate_limited(rows, "k", "ts", 2, 60).orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, False, True]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
