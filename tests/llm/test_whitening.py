"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from portolan.llm.whitening import certified, ritz, whiten


def check(spark, rows, k=8, **how):
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n int"), k=k, **how).collect()
    kept = [(r[0], r[1]) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = min(k, x.shape[1])
    assert len(got) == n * many
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    want = {}
    for (key, _), row, c in zip(kept, x, centred):
        for i in range(many):
            want.setdefault((key, i + 1), []).append((int(((n * row - sums) ** 2).sum()), abs(c @ vectors[:, i]) / math.sqrt(values[i]) if values[i] > 1e-9 * values[0] else None))
    assert set(by) == set(want)
    for key, found in by.items():
        assert all(r.n == n and r.identity_error < 1e-9 for r in found)
        assert sorted(int(r.deviation) for r in found) == sorted(d for d, _ in want[key])
        assert [None if r.whitened is None else True for r in found] == [None if w is None else True for _, w in want[key]]
        assert np.allclose(sorted(abs(r.whitened or 0) for r in found), sorted(w or 0 for _, w in want[key]), rtol=1e-7, atol=1e-8)
        assert all(abs(r.explained - max(values[key[1] - 1], 0) / values.sum()) < 1e-9 for r in found)
    return got


def rows_of(x):
    return [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]


def test_clear_gaps(spark):
    rng = np.random.default_rng(0)
    check(spark, rows_of(rng.normal(size=(600, 40)) * 1.5 ** -np.arange(40)))


def test_flat_spectrum_and_correlation(spark):
    rng = np.random.default_rng(1)
    check(spark, rows_of(rng.normal(size=(400, 40)) @ (np.eye(40) + rng.normal(size=(40, 40)) / 20)))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    rows = rows_of(x) + rows_of(x[:7]) + [(None, x[3].tolist(), None, None), (500, None, 1, 1), (501, [], 1, 1), (502, [1.0, None, 1.0, 1.0, 1.0], 1, 1), (503, [float("nan")] * 5, 1, 1), (504, [float("inf")] + [0.0] * 4, 1, 1)]
    check(spark, rows)
    check(spark, rows, k=2, block=1)


def test_no_variance(spark):
    one = check_none = whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in check_none)
    flat = [(i, [i / 4, i / 4, 1.0], 1, 1) for i in range(9)]  # one direction only
    got = check(spark, flat)
    assert {r.component for r in got if r.whitened is not None} == {1}
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(Exception, match="components"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    check(spark, rows_of(rng.normal(size=(50, 3)) * 1e7))
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_signs_agree_and_table(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = whiten(data).collect()
    w = {}
    for r in rows:
        w.setdefault(r.component, {})[r.vec_id] = r.whitened
    keys = sorted(w[1])
    full = np.array([[w[c][i] for c in range(1, 9)] for i in keys])
    assert np.abs(full.T @ full / len(keys) - np.eye(8)).max() < 1e-10


def test_certificates():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    v = a @ a.T
    q = np.linalg.qr(rng.normal(size=(30, 12)))[0]
    values, _, residuals = ritz(q, v @ q)
    assert not certified(values, residuals, 4, 30, 1e-8)
    for _ in range(300):
        q = np.linalg.qr(v @ q)[0]
    values, vectors, residuals = ritz(q, v @ q)
    assert certified(values, residuals, 4, 30, 1e-8) and np.allclose(values[:4], np.linalg.eigvalsh(v)[::-1][:4])
