"""Vector code compression: product codes from Lloyd rounds with Elkan's bounds, in exact integers.

A vector is cut into equal parts, and each part position has a codebook. A round assigns each part to the nearest
entry of its codebook. What a row has learned goes with it to the next round, in a written table: for each part an
upper bound of the distance to its own entry, and a lower bound of the distance to every entry. When entries move,
bounds are shifted by as much. By the triangle inequality an entry whose lower bound, or half whose distance from
the part's own entry, is strictly above the upper bound can't be as near; all others are compared by exact integer
distances, so that ties are settled by numbers alone. New entries come from sums that are aggregated before the
shuffle. Only codebooks reach the driver: as many vectors as a codebook has entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import drop, finite, materialize, matrix

#: Distances are kept as doubles, moved outwards by this share, so that a bound never errs on the wrong side.
SLACK = 1e-9
#: Components of at most 2**26 in size, so that squares and their sums stay in 64 bits.
LIMIT = 1 << 26


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors * scale)
    if np.abs(scaled).max(initial=0.0) > LIMIT:
        raise ValueError(f"a component is above {LIMIT} / {scale}")
    return scaled.astype(np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("...w,...w->...", apart, apart)


def assign(x: np.ndarray, book: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, upper bound, squared distance or -1 where bounds were enough, distances computed) for parts x of one position.

    own and upper are the entry of the last round and a bound of the distance to it, lower (rows, entries) is improved
    in place. Of entries at one distance the first wins. With `exact` every squared distance is computed.
    """
    own, upper = own.copy(), upper.copy()
    square = np.full(len(x), -1)
    between = np.sqrt(squares(book[:, None], book[None])) * (1 - SLACK)
    near = np.where(np.eye(len(book), dtype=bool), np.inf, between).min(1, initial=np.inf)
    computed = 0

    def tighten(rows: np.ndarray) -> None:
        nonlocal computed
        rows = rows[square[rows] < 0]
        square[rows] = squares(x[rows], book[own[rows]])
        root = np.sqrt(square[rows])
        upper[rows], lower[rows, own[rows]] = root * (1 + SLACK), root * (1 - SLACK)
        computed += len(rows)

    open_ = np.arange(len(x)) if exact else np.flatnonzero(near[own] <= 2 * upper)  # the others' own entry is nearest of all
    if exact:
        tighten(open_)
        open_ = open_[near[own[open_]] <= 2 * upper[open_]]
    for j in range(len(book)):
        maybe = lambda rows: rows[(own[rows] != j) & (lower[rows, j] <= upper[rows]) & (between[own[rows], j] <= 2 * upper[rows])]  # noqa: B023, E731
        rows = maybe(open_)
        tighten(rows)
        rows = maybe(rows)
        if not len(rows):
            continue
        found = squares(x[rows], book[j])
        computed += len(rows)
        root = np.sqrt(found)
        lower[rows, j] = root * (1 - SLACK)
        better = (found < square[rows]) | (found == square[rows]) & (j < own[rows])
        moved = rows[better]
        own[moved], square[moved], upper[moved] = j, found[better], root[better] * (1 + SLACK)
    return own, upper, square, computed


def packed_bounds(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (..., entries) as one byte each, rounded down, and the step of a byte for each row."""
    step = (lower.max(-1) / 255).astype("<f4")
    return np.floor(lower / np.where(step > 0, step, 1)[..., None]).clip(0, 255).astype(np.uint8), step


def unpacked_bounds(levels: np.ndarray, step: np.ndarray) -> np.ndarray:
    return levels * step.astype(np.float64)[..., None] * (1 - 1e-6)


def vector_codes(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(all columns but the vector, and codes array<int>, error long: one row for each kept row; codebooks: parts x entries x components).

    Rows whose vector is null, empty or holds a null or non-finite component are dropped. Components become
    floor(scale * x). Codebooks start as the parts of the vectors with the smallest ids, equal ids by their components, null ids last; with
    fewer vectors they have fewer entries. Repeated rows are rows of their own. Vectors must have one length, a multiple
    of `parts`, and components of at most LIMIT / scale; ValueError if not. An empty table gives an empty result. Columns
    may have any names.
    """
    names = [f"c{i}" for i in range(len(table.columns))]
    id_, vector = (names[table.columns.index(c)] for c in (id_col, vector_col))
    kept = table.toDF(*names).filter(finite(F.col(vector)))
    rest = [n for n in names if n != vector]
    types = {f.name: f.dataType.simpleString() for f in table.toDF(*names).schema}
    restored = lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(names, table.columns) if n != vector], "codes_", "error_").withColumnsRenamed({"codes_": "codes", "error_": "error"})
    starts = kept.orderBy(F.col(id_).asc_nulls_last(), vector).select(vector).limit(entries).toArrow().column(0).combine_chunks()
    if not len(starts):
        none = kept.limit(0).select(*rest, F.lit(None).cast("array<int>").alias("codes_"), F.lit(None).cast("long").alias("error_"))
        return restored(none), np.zeros((parts, 0, 0), np.int64)
    dim = len(starts[0])
    if dim % parts:
        raise ValueError(f"{dim} components are not {parts} equal parts")
    width = dim // parts
    books = np.ascontiguousarray(whole(matrix(starts, dim), scale).reshape(len(starts), parts, width).transpose(1, 0, 2))
    count = len(starts)

    state = [f"{n} {types[n]}" for n in rest] + ["x_ binary", "own_ binary", "upper_ binary", "step_ binary", "lower_ binary"]
    cells = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
    numbers = lambda batch, name, kind, *shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(len(batch), *shape)

    def begin(batch):
        x = whole(matrix(batch.column(vector), dim), scale).reshape(len(batch), parts, width)
        own = np.zeros((len(batch), parts), np.int64)
        return x, own, np.sqrt(squares(x, books_of[0][:, 0])) * (1 + SLACK), np.zeros((len(batch), parts, count))

    def carry(batch):
        """What a row knew of the last entries, shifted by how far each has moved."""
        x = numbers(batch, "x_", "<i4", parts, width).astype(np.int64)
        own = numbers(batch, "own_", np.uint8 if count <= 256 else "<i4", parts).astype(np.int64)
        moved = np.sqrt(squares(books_of[-1], books_of[-2])) * (1 + SLACK)
        upper = (numbers(batch, "upper_", "<f4", parts).astype(np.float64) + moved[np.arange(parts), own]) * (1 + SLACK)
        lower = unpacked_bounds(numbers(batch, "lower_", np.uint8, parts, count), numbers(batch, "step_", "<f4", parts))
        return x, own, upper, np.maximum(lower - moved, 0.0)

    def step(load, last):
        def run(batches):
            for whole_batch in batches:
                for at in range(0, len(whole_batch), 2048):
                    batch = whole_batch.slice(at, 2048)
                    x, own, upper, lower = load(batch)
                    square = np.zeros_like(own)
                    for p in range(parts):
                        own[:, p], upper[:, p], square[:, p], _ = assign(x[:, p], books_of[-1][p], own[:, p], upper[:, p], lower[:, p], exact=last)
                    columns = [batch.column(n) for n in rest]
                    if last:
                        flat = pa.array(own.astype(np.int32).reshape(-1))
                        columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * parts), flat), pa.array(square.sum(1))]
                        yield pa.RecordBatch.from_arrays(columns, names=[*rest, "codes_", "error_"])
                    else:
                        levels, steps = packed_bounds(lower)
                        above = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
                        columns += [cells(x.astype("<i4")), cells(own.astype(np.uint8 if count <= 256 else "<i4")), cells(above), cells(steps), cells(levels)]
                        yield pa.RecordBatch.from_arrays(columns, names=[*rest, "x_", "own_", "upper_", "step_", "lower_"])

        return run

    def sums(batches):
        held, total = np.zeros((parts, count), np.int64), np.zeros((parts, count, width), np.int64)
        for batch in batches:
            x = numbers(batch, "x_", "<i4", parts, width).astype(np.int64)
            own = numbers(batch, "own_", np.uint8 if count <= 256 else "<i4", parts).astype(np.int64)
            for p in range(parts):
                held[p] += np.bincount(own[:, p], minlength=count)
                np.add.at(total[p], own[:, p], x[:, p])
        where = np.argwhere(held)
        columns = [pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(held[held > 0])] + [pa.array(total[held > 0][:, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    books_of, rows = [books], kept
    for turn in range(rounds):
        before, rows = rows, materialize(rows.mapInArrow(step(carry if turn else begin, False), ", ".join(state)), "codes-bounds")
        if turn:
            drop(before)
        parted = rows.select("x_", "own_").mapInArrow(sums, ", ".join(f"{n} long" for n in ("part", "entry", "n", *[f"s{i}" for i in range(width)])))
        books = books_of[-1].copy()
        for r in parted.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in parted.columns[2:]]).collect():  # one row an entry
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        books_of = [books_of[-1], books]
    coded = rows.mapInArrow(step(carry if rounds else begin, True), ", ".join([*state[: len(rest)], "codes_ array<int>", "error_ long"]))
    return restored(coded), books_of[-1]


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str, broadcast_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """coded with label_error: the sum of `error` over rows of one label, nulls being one.

    The sums are broadcast if they are few by count; beyond that each is sent to `salts` tasks, so that no label's rows are one task's.
    """
    sums = materialize(coded.groupBy(F.col(label_col).alias("of_")).agg(F.sum("error").alias("label_error")), "codes-labels")
    if sums.count() <= broadcast_rows:
        return coded.join(F.broadcast(sums), F.col(label_col).eqNullSafe(F.col("of_")), "left").drop("of_")
    spread = sums.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = coded.withColumn("at_", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(spread, F.col(label_col).eqNullSafe(F.col("of_")) & (F.col("at_") == F.col("salt_")), "left").drop("of_", "salt_", "at_")


def coded_vectors(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256; see vector_codes."""
    coded, books = vector_codes(table.select(id_col, label_col, vector_col), id_col=id_col, vector_col=vector_col)
    coded = materialize(coded, "codes")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code")
    return with_label_error(coded, label_col).select(F.col(id_col), code, "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
