"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from portolan.llm.nearest import beam, build, descend, nearest, shard_count


def brute(rows, every, k):
    good = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(key, []).append(np.array(v, np.float64))
    out = {}
    for key, own in good.items():
        if key % every == 0:
            near = {(float(np.sqrt(((v - q) ** 2).sum())), i) for q in own for i, vs in good.items() for v in vs if i != key and len(v) == len(q)}
            out[key] = sorted(near)[:k]
    return out


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24)) * 4
    points = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))
    order, layers = build(points, 16, 64)
    assert sorted(order) == list(range(3000)) and len(layers[0]) == 3000
    points = points[order]
    queries = points[::30]
    found, dist = beam(points, layers[0], queries, descend(points, layers[1:], queries), 100)
    exact = ((points[None] - queries[:, None]) ** 2).sum(2)
    right = sum(len(set(np.argsort(e, kind="stable")[:10]) & set(f[:10].tolist())) for e, f in zip(exact, found))
    assert right / (10 * len(queries)) > 0.97
    assert (np.diff(dist[:, :10], axis=1) >= 0).all()


@pytest.mark.parametrize("shard_rows", [64, 4096])
def test_embeddings(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = nearest(table, every=20, shard_rows=shard_rows).collect()
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 20, 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.97
    exact = {(q, i): d for q in want for d, i in want[q]}
    assert all(math.isclose(d, exact[q, i], rel_tol=1e-12) for q in got for d, i in got[q] if (q, i) in exact)


def test_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 400, 10)] + [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (100, [0.0, 0.0]), (200, [1.0, None]), (300, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (None, [5.0, 5.0])]
    rows += [(500, [1.0, 2.0, 3.0]), (501, [1.0, 2.0, 4.0]), (600, [7.0]), (7, [-3.0, 1.0]), (8, [4.0, 4.0])]
    rows = [r for r in rows if not (r[0] in (100, 200, 300) and r[1] == [1.0, 2.0])]
    table = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = {q: x for q, x in brute(rows, 100, 10).items() if x}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert nearest(table.limit(0)).count() == 0


def test_recall_over_shards_of_the_default_size(spark):
    rng = np.random.default_rng(3)
    n, centres = 52_000, rng.normal(size=(300, 16)) * 2
    points = (centres[rng.integers(0, 300, n)] + rng.normal(size=(n, 16))).astype(np.float32)
    assert shard_count(n, 16384, 131072) == 4
    table = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(table, every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = points.astype(np.float64)
    hits = 0
    for q, found in got.items():
        d = ((exact - exact[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 260 and hits / (10 * len(got)) >= 0.95


def test_shards_grow_with_the_table():
    counts = [shard_count(n, 16384, 131072) for n in (0, 1, 16384, 16385, 100_000, 1_000_000, 1_048_577, 10_000_000)]
    assert counts == [1, 1, 1, 2, 7, 8, 9, 77]


def test_large_and_small_magnitudes(spark):
    rng = np.random.default_rng(5)
    for scale, kind in ((1e30, "float"), (1e-30, "float"), (1e200, "double"), (1.0, "double")):
        rows = [(i, v) for i, v in enumerate((rng.normal(size=(300, 6)) * min(scale, 1e150)).astype(np.float32 if kind == "float" else np.float64).tolist())]
        got = {}
        for r in nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        want = brute(rows, 100, 10)
        assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
