"""Codes with bounds against Lloyd rounds that compare everything."""

import hashlib
import math

import numpy as np
import pytest

from portolan.llm.vector_codes import assign, coded_vectors, packed_bounds, unpacked_bounds, vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label) and the books by the definition; ints only."""
    kept = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for j in range(len(books[p])):
                members = [c[p] for c, o in zip(cut, own) if o == j]
                if members:
                    books[p][j] = [sum(col) // len(members) for col in zip(*members)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    return out, books


def check(spark, rows, extra=False):
    schema = "vec_id long, embedding array<float>, label int"
    data = spark.createDataFrame([(i, v, x) for i, v, x in rows], schema)
    if extra:
        data = data.selectExpr("*", "label as codes", "vec_id as error", "label as c0", "label as x_").repartition(3)
    got = coded_vectors(data).collect()
    want, books = plain(rows)
    per = {}
    for _, _, error, label in want:
        per[label] = per.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, code, error, per[label], digest) for i, code, error, label in want], key=repr)


def test_codes(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    rows = [(int(i), (centres[rng.integers(20)] + rng.normal(size=32) / 4).astype(np.float32).tolist(), int(rng.integers(4)) if i % 7 else None) for i in rng.permutation(400)]
    check(spark, rows, extra=True)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 16) / 256).tolist(), i % 3) for i in range(150)]  # few values: many ties
    rows += rows[:40] + [(i, rows[0][1], 0) for i in range(500, 520)] + [(None, rows[5][1], None), (None, rows[6][1], 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * 16, 1), (903, [float("nan")] + [0.0] * 15, 1), (904, [0.0] * 15 + [float("inf")], 2), (905, [0.0] * 16, 2)]
    check(spark, rows)
    check(spark, rows[:30])  # fewer vectors than entries
    check(spark, rows[:1])
    check(spark, [(900, None, 1)])
    assert coded_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).collect() == []


def test_lengths_and_range(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="components"):
        coded_vectors(make([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        coded_vectors(make([(1, [0.0] * 17, 1)])).collect()
    with pytest.raises(ValueError, match="above"):
        coded_vectors(make([(1, [1e9] * 16, 1)])).collect()


def test_bounds_prune_and_hold():
    """After a small move few distances are computed, and what is pruned changes nothing."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 4)) * 60).astype(np.int64) + rng.integers(0, 4, (3000, 1)) * 400
    book = x[:64].copy()
    lower = np.zeros((3000, 64))
    own, upper, _, first = assign(x, book, np.zeros(3000, np.int64), np.sqrt(((x - book[0]) ** 2).sum(1)) * (1 + 1e-9), lower)
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (lower <= np.sqrt(every)).all() and first < 3000 * 64 * 0.8
    levels, step = packed_bounds(lower)
    assert (unpacked_bounds(levels, step) <= lower + 1e-9).all() and levels.dtype == np.uint8
    moved = book + rng.integers(-3, 4, book.shape)
    shift = np.sqrt(((moved - book) ** 2).sum(1))
    lower = np.maximum(unpacked_bounds(levels, step) - shift, 0)
    again, upper, square, second = assign(x, moved, own, upper + shift[own], lower)
    every = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (again == every.argmin(1)).all() and (upper**2 >= every[np.arange(3000), again] - 1e-3).all() and second < first / 3
    exact = assign(x, moved, own, np.full(3000, np.inf), np.zeros((3000, 64)), exact=True)
    assert (exact[0] == every.argmin(1)).all() and (exact[2] == every.min(1)).all()


def test_many_labels_are_joined_by_shuffle(spark):
    from portolan.llm.vector_codes import with_label_error

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, i) for i in range(200)], "id int, label int, error long")
    few, many = (sorted(with_label_error(rows, "label", n).collect(), key=repr) for n in (100, 0))
    assert [tuple(sorted(r.asDict().items())) for r in few] == [tuple(sorted(r.asDict().items())) for r in many] and len(few) == 200


def test_books_of_any_rounds(spark):
    rows = [(i, [float((i * k) % 7) / 16 for k in range(1, 9)], 0) for i in range(60)]
    for rounds in (0, 1, 4):
        coded, books = vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=4, entries=5, rounds=rounds)
        want, wanted = plain(rows, 4, 5, rounds)
        assert books.tolist() == wanted and {r.vec_id: ("".join(f"{c:02x}" for c in r.codes), r.error) for r in coded.collect()} == {i: (code, error) for i, code, error, _ in want}
