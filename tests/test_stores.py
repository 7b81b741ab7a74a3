"""A quota store of bounded size, against a plain list."""

import random

import pytest

from portolan.operators import stores


def plain(rows, window, limit, capacity):
    """Each request's fate, with the store as a list that is searched from its start."""
    held, out = [], {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        held = [e for e in held if e[1] + window > t]
        mine = [e for e in held if e[0] == key]
        if not mine:
            held = held[max(0, len(held) - capacity + 1):] + [[key, t, 0]]
            mine = held[-1:]
        ok = mine[0][2] < limit
        mine[0][2] += ok
        out[i] = (ok, mine[0][1], 0 if ok else max(1, -(-(mine[0][1] + window - t) // 1_000_000)))
    return out


@pytest.mark.parametrize(("capacity", "span_rows"), [(1, 100), (3, 60), (12, 100), (1000, 100), (5, 10_000)])
def test_store_equals_a_plain_list(spark, capacity, span_rows):
    rng = random.Random(capacity)
    keys = [None] + ["hot"] * 10 + [f"k{i}" for i in range(19)]
    rows = [(i, rng.choice(keys), rng.randrange(40_000_000)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, k string, t long").repartition(3)
    got = stores.bounded_store(df, "k", "t", ["t", "id"], 5_000_000, 2, capacity, span_rows)
    assert {r.id: (r.allowed, r.opened, r.retry_after) for r in got.collect()} == plain(rows, 5_000_000, 2, capacity)
    assert got.columns == ["id", "k", "t", "allowed", "opened", "retry_after"]


def test_store_of_odd_requests(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", 5), (4, "a", 5)], "id long, k string, t long")
    got = {r.id: (r.allowed, r.opened) for r in stores.bounded_store(df, "k", "t", ["t", "id"], 10, 1, 1).collect()}
    assert got == {1: (None, None), 2: (True, 5), 3: (True, 5), 4: (True, 5)}  # each drops the one before
    assert stores.bounded_store(df.limit(0), "k", "t", ["t", "id"], 10, 1, 1).count() == 0
    with pytest.raises(ValueError):
        stores.bounded_store(df, "k", "t", ["t", "id"], 10, 1, 0)


@pytest.mark.parametrize("most", [100_000, 20])
def test_a_store_that_is_never_full_is_settled_at_once(spark, monkeypatch, most):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefgh"), rng.randrange(40_000_000)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    written, real, quota = [], stores.settled, stores.fixed_window
    monkeypatch.setattr(stores, "settled", lambda d, label: written.append(label) or real(d, label))
    monkeypatch.setattr(stores, "fixed_window", lambda *a: quota(*a, most))
    got = {r.id: (r.allowed, r.opened, r.retry_after) for r in stores.bounded_store(df, "k", "t", ["t", "id"], 5_000_000, 2, 8, 60).collect()}
    assert got == plain(rows, 5_000_000, 2, 8)
    assert written.count("store-states") == 2  # the guess, and one round that confirms it
