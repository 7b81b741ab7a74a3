"""Running sums and quotas for groups of any size, against plain loops."""

import math
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from portolan.operators import metrics, quotas, running, states


def test_order_key_never_falls(spark):
    rng = random.Random(0)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, math.nextafter(1.0, 2), 0.5, 1e308, -1e308, math.inf, -math.inf] + [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [0.7 + i * 1e-13 for i in range(500)]
    values = sorted({v for v in values if not math.isnan(v)})
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double").select("x", running.order_key(F.col("x")).alias("k")).collect()
    keys = {r.x: r.k for r in rows if r.x is not None and not math.isnan(r.x)}
    assert all(keys[a] <= keys[b] for a, b in zip(values, values[1:])) and len({keys[0.7 + i * 1e-13] for i in range(500)}) > 30
    assert next(r.k for r in rows if r.x is None) < min(keys.values()) and next(r.k for r in rows if r.x is not None and math.isnan(r.x)) > max(keys.values())


@pytest.mark.parametrize("most", [2, 7, 100_000])
def test_exclusive_sums(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["a", None]), None, k, rng.randrange(5)) for k in {rng.choice([rng.random(), rng.random() * 1e-9, -rng.random() * 100]) for _ in range(400)}]
    df = spark.createDataFrame(rows, "g string, h int, x double, n long").dropDuplicates(["g", "x"])
    rows = df.collect()
    got = running.exclusive_sums(df.withColumn("key", running.order_key(F.col("x"))), ["g", "h"], "key", ["x"], ["n"], most).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [s for s in rows if s.g == r.g]
        assert r.before_n == sum(s.n for s in own if s.x < r.x) and r.all_n == sum(s.n for s in own)
    assert running.exclusive_sums(df.limit(0).withColumn("key", F.lit(0).cast("long")), ["g"], "key", ["x"], ["n"], most).count() == 0


def test_ranking_takes_time_in_proportion(spark):
    """Distinct scores of one slice within a millionth: ten times as many take no more than fifteen times as long."""

    def seconds(n):
        df = spark.range(n).select(F.lit("s").alias("s"), (0.5 + F.col("id") * (1e-6 / n)).alias("p"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
        began = time.time()
        (r,) = metrics.ranking(df, ["s"], "p", "y").collect()
        assert r.n == n and abs(r.auc - 0.5) < 0.05
        return time.time() - began

    seconds(2000)
    assert seconds(200_000) < 15 * max(seconds(20_000), 0.7)


def plain_quota(rows, window, limit):
    out, state = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        opened, used = state.get(key, (None, 0))
        if opened is None or t >= opened + window:
            opened, used = t, 0
        ok = used < limit
        state[key] = (opened, used + ok)
        out[i] = (ok, opened, 0 if ok else max(1, -(-(opened + window - t) // 1_000_000)))
    return out


@pytest.mark.parametrize("most", [3, 100_000])
@pytest.mark.parametrize("window", [7, 40, 5_000_000])
def test_windows_open_as_one_by_one(spark, window, most):
    rng = random.Random(window)
    keys = ["hot"] * 4 + ["a", "b", None, "="]
    rows = [(i, rng.choice(keys), rng.choice([rng.randrange(-300, 1000), rng.randrange(100, 130), 5000 + rng.randrange(40)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, t long")
    got = {r.id: (r.allowed, r.opened, r.retry_after) for r in quotas.fixed_window(df, "k", "t", ["t", "id"], window, 3, most).collect()}
    assert got == plain_quota(rows, window, 3)


def test_quota_of_a_hot_key_in_one_window(spark):
    """A third of all rows are one key's, in a burst and in a long trail; the fold that goes through them one by one agrees."""
    rng = random.Random(5)
    rows = [(i, 0, 10_000 + i) for i in range(3000)] + [(i, 0, rng.randrange(1_000_000)) for i in range(3000, 5000)] + [(i, rng.randrange(1, 900), rng.randrange(1_000_000)) for i in range(5000, 15_000)]
    df = spark.createDataFrame(rows, "id int, k int, t long")
    start, step = states.quota_step(20_000, 5)
    want = {r.id: (r.allowed, r.opened) for r in states.fold(df, "k", ["t", "id"], start, step, "allowed boolean, opened long, retry_after long").collect()}
    got = quotas.fixed_window(df, "k", "t", ["t", "id"], 20_000, 5, most=500)
    assert {r.id: (r.allowed, r.opened) for r in got.collect()} == want


def test_quota_of_odd_requests(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, None, 7), (4, "a", None), (5, "a", 6), (5, "a", 6)], "id int, k string, t long")
    rows = sorted(((r.id, r.allowed, r.opened) for r in quotas.fixed_window(df, "k", "t", ["t", "id"], 10, 2).collect()), key=repr)
    assert rows == [(1, True, 5), (2, True, 5), (3, False, 5), (4, None, None), (5, True, 6), (5, True, 6)]
    spread = sorted(((r.id, r.allowed, r.opened) for r in quotas.fixed_window(df, "k", "t", ["t", "id"], 10, 2, most=1).collect()), key=repr)
    assert spread == rows
    assert quotas.fixed_window(df.limit(0), "k", "t", ["t", "id"], 10, 2).count() == 0
    assert quotas.fixed_window(df.filter("id = 4"), "k", "t", ["t", "id"], 10, 2).count() == 1


def test_fold_takes_nulls_as_one_key(spark):
    df = spark.createDataFrame([(i, None, i) for i in range(3)] + [(9, 7, 1)], "id int, k int, t long")
    start, step = states.quota_step(100, 2)
    rows = states.fold(df, "k", ["t"], start, step, "allowed boolean, opened long, retry_after long").collect()
    assert {r.id: r.allowed for r in rows} == {0: True, 1: True, 2: False, 9: True} and {r.k for r in rows} == {None, 7}


def test_table_is_rebuilt_and_put_back(spark):
    for name in ("again", "again_old", "again_next"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.range(3).write.saveAsTable("again")
    states.rebuild_table(spark.table("again").filter("id > 0"), "again")
    assert spark.table("again").count() == 2 and not spark.catalog.tableExists("again_old")
    spark.sql("ALTER TABLE again RENAME TO again_old")  # as a failure between the two renames leaves it
    states.rebuild_table(spark.range(1), "again")
    assert spark.table("again").count() == 1 and not spark.catalog.tableExists("again_old")
    spark.sql("DROP TABLE again")
