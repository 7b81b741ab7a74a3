"""Queries against their SQL on small tables made for what the given ones lack."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.test_oracles import plain


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compares a query with its SQL on tables that are given as SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet'")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        done = con.execute(__spark_entry__.oracle_sql()[name])
        names = [d[0] for d in done.description]
        want = sorted(([plain(x) for x in r] for r in done.fetchall()), key=repr)
        got = __spark_entry__.queries()[name](spark, os.fspath(tmp_path)).select(*names).collect()
        assert sorted(([plain(x) for x in r] for r in got), key=repr) == want
        return want

    return check


def test_latest_snapshot_rounds_halves_to_even(same_as_sql):
    """Prices of a half decide ties by their hash: 2.5 is written 2."""
    rows = same_as_sql("latest_service_snapshot", lineitem="SELECT (i // 6)::BIGINT AS l_partkey, i::BIGINT AS l_orderkey, 1::INTEGER AS l_linenumber, (i % 5)::BIGINT AS l_suppkey, i + 0.5::DOUBLE AS l_extendedprice, TIMESTAMP '1996-01-01' AS l_shipdate FROM range(600) r(i)")
    assert len(rows) == 100


def test_bearing_of_points_half_a_turn_apart(same_as_sql):
    """The sign of a rounding error is the bearing's; every pair of places that the keys can make."""
    rows = same_as_sql("great_circle", supplier="SELECT s::BIGINT AS s_suppkey, n::INTEGER AS s_nationkey FROM range(2720) a(s), range(25) b(n)")
    assert len(rows) == 68_000


@pytest.mark.parametrize("busy", [10, 5000])
def test_searches_meet_only_holders_of_their_rarest_word(spark, busy):
    """Long numbers share their letters by three with many others, but each is met by its own entry; a busy word is cut and loses none."""
    from pyspark.sql import functions as F

    from portolan.operators import search

    number = (F.col("id") + 100_000).cast("string")
    entries = spark.range(900).select(F.col("id").alias("entry"), F.lit("t").alias("title"), F.concat(F.lit("p"), number).alias("code"), F.lit("brand").alias("place"), F.lit("ring").alias("name"), F.lit("").alias("land"))
    asked = spark.range(900).select(F.concat(F.lit("p "), number).alias("query")).union(spark.createDataFrame([("brand ring",)], "query string"))
    counts = {r.query: r["count"] for r in search.meetings(entries, asked, busy).groupBy("query").count().collect()}
    assert counts.pop("brand ring") == 900 and len(counts) == 900 and set(counts.values()) == {1}


@pytest.mark.parametrize("most", [3, 1000])
def test_levels_known_before_equal_counting(spark, most):
    import random

    from portolan.operators import temporal

    rng = random.Random(most)
    rows = [(i, rng.choice([0, 1, 2, None]), rng.randrange(2), rng.choice([rng.randrange(90), None]), rng.choice([rng.randrange(90), None]), rng.randrange(3)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a long, b long, t long, u long, x int")
    got = {r.id: (r.of_a.x, r.of_b.x) for r in temporal.known_before_by_level(df, ["a", "b"], "t", "u", ["x"], 40, most).collect()}
    seen = lambda level, k, t: sum(r[5] for r in rows if k is not None and t is not None and r[level] == k and r[4] is not None and r[4] < t)
    assert got == {i: (seen(1, a, t), seen(2, b, t)) for i, a, b, t, _, _ in rows}


def test_first_examples_of_many_keys(spark):
    """Only keys go into the cut, and the bound that cuts them loses none of the first."""
    from portolan.operators import matching

    rows = spark.range(3000).selectExpr("id % 3 as g", "3000 - id as k", "id % 7 as j")
    for most in (1, 5, 2000):
        got = sorted((r.g, r.k, r.j, r.place) for r in matching.first_of_each(rows, ["g"], ["k", "j"], most, "place").collect())
        want = [(g, k, j, i + 1) for g in range(3) for i, (k, j) in enumerate(sorted((3000 - x, x % 7) for x in range(3000) if x % 3 == g)[:most])]
        assert got == sorted(want)
