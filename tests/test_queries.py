"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canon
from flowspark.catalog import load

QUERIES, ORACLE = load()
# the costly ones have their own brute-force tests
SLOW = {"m05_dbscan", "m05_dbscan_two_fields", "m06_dbscan_strict", "x08_similar_clusters", "m09_m10_svm_many_classes"}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n not in SLOW))
def test_query_equals_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and n not in SLOW))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
