"""Every query that SQL can state, against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    done = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in done.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr) == want


def test_entry_is_stable(spark):
    first = __spark_entry__.entry(spark)
    assert first.columns == ["level", "key", "n", "pos", "rate"] and first.count() > 0
