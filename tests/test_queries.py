"""Every query of the catalogue against its SQL twin in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stratum.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == columns
    at = [there.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["hostname", "kept", "removed"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
