"""Embedding whitening by block subspace iteration, without a covariance matrix.

Each Spark pass multiplies the covariance with a block of directions: a task centres its rows and adds up X'(XQ), the
tasks' sums are added in two steps, and the driver holds blocks of (dimensions x directions) only. QR and
Rayleigh-Ritz give the next block and the residual of each component; the passes end when the residuals certify all
components against their gaps, or have reached round-off. Where neighbouring eigenvalues are too close for that to
happen soon, the block is widened; a block of all dimensions is exact after one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import finite, matrix

EPS = np.finfo(np.float64).eps


def whole(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    scaled = np.floor(vectors * scale) + offset
    if np.abs(scaled).max(initial=0.0) >= 1 << 52:
        raise ValueError(f"a component is too large: {scale} * c must stay below 2**52")
    return scaled.astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they hold it, else as Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return n * x - np.array(sums, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(sums, object)


def exact_squares(y: np.ndarray) -> list[int]:
    """The sum of squares of each row as Python's integers."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) if y.size else 0
    small = most * most * max(1, y.shape[1]) < 1 << 63
    return (y * y).sum(1).tolist() if small else [sum(v * v for v in row) for row in y.astype(object).tolist()]


def added(rows: DataFrame, block, groups: int = 64) -> np.ndarray:
    """The sum over all Arrow batches of block(batch), an array of one shape: in each task, then in `groups` tasks, then here."""

    def first(batches):
        total = 0
        for batch in batches:
            if len(batch):
                total = total + block(batch)
        if not np.isscalar(total):
            yield of(total)

    def second(batches):
        total = 0
        for batch in batches:
            for row in range(len(batch)):
                total = total + back(batch, row)
        if not np.isscalar(total):
            yield of(total)

    def of(total):
        return pa.RecordBatch.from_arrays([pa.array([list(total.shape)], pa.list_(pa.int64())), pa.array([total.tobytes()], pa.binary())], names=["shape", "sums"])

    def back(batch, row):
        return np.frombuffer(batch.column("sums")[row].as_py(), np.float64).reshape(batch.column("shape")[row].as_py())

    schema = "shape array<long>, sums binary"
    parts = rows.mapInArrow(first, schema).repartition(groups).mapInArrow(second, schema).toArrow()
    return sum((back(parts, row) for row in range(parts.num_rows)), np.float64(0))


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Ritz values by falling size, Ritz vectors, residual norms) of a symmetric matrix from an orthonormal block and its product."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def certified(values: np.ndarray, residuals: np.ndarray, k: int, dim: int, exact: float) -> bool:
    """Whether the first k Ritz pairs are eigenpairs: each residual below `exact` times the gap to other values, or at round-off.

    A residual over the gap bounds the angle to the eigenvector. The value after the k-th stands for all that is not in the block.
    """
    floor = 8 * dim * EPS * max(values[0], 0.0)
    for i in range(k):
        others = np.delete(values[: k + 1], i)
        gap = np.abs(others - values[i]).min() if len(others) else values[i]
        if residuals[i] > max(floor, exact * gap):
            return False
    return True


def components(rows: DataFrame, vector_col: str, dim: int, n: int, sums: list[int], k: int, scale: int, offset: int, block: int, exact: float, passes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, the k largest; RuntimeError if `passes` do not certify them."""
    rng = np.random.default_rng(0)
    width = min(dim, max(block, 2 * k))
    q = np.linalg.qr(rng.normal(size=(dim, width)))[0]
    before = np.inf
    for _ in range(passes):

        def times(batch, q=q):
            x = deviations(whole(matrix(batch.column(0), dim), scale, offset), n, sums).astype(np.float64) / n
            return np.concatenate([(x.T @ (x @ q)).reshape(-1), [np.einsum("nd,nd->", x, x)]])

        flat = added(rows.select(vector_col), times) / n
        trace = float(flat[-1])
        values, vectors, residuals = ritz(q, flat[:-1].reshape(q.shape))
        if q.shape[1] == dim or certified(values, residuals, min(k, len(values) - 1), dim, exact):
            return values[:k], vectors[:, :k], trace
        worst = residuals[:k].max()
        q = np.linalg.qr(flat[:-1].reshape(q.shape) @ (vectors.T @ q).T)[0]
        if worst > 0.03 * before:  # slower than a third of a digit and more in each pass: a wider block separates better
            q = np.linalg.qr(np.concatenate([q, rng.normal(size=(dim, min(dim, 2 * q.shape[1]) - q.shape[1]))], axis=1))[0]
        before = worst
    raise RuntimeError(f"components were not certified in {passes} passes")


def whiten(table: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000, block: int = 16, exact: float = 1e-11, passes: int = 60, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error for each kept row and component up to k.

    Rows whose vector is null, empty or holds a null or non-finite component are dropped. x = floor(scale * c) + offset; with
    the sums S over all n rows, deviation = sum of (n * x - S)^2, exact, as decimal(38, 0). Components are eigenvectors of the covariance
    (divisor n) by falling eigenvalue e, their largest entry positive; whitened is the centred x on the component over
    sqrt(e), explained is e over the trace, and identity_error the largest entry, in size, of the whitened values' covariance
    minus the identity, measured in a pass of its own. Vectors of fewer than k dimensions have as many components as dimensions.
    A component of no variance (as with one row, or equal rows) has whitened null and explained 0 (null where the trace is 0 too), and takes no
    part in identity_error. Repeated rows count each. Vectors must have one length; ValueError if not. An empty table gives an
    empty result; other columns are ignored.
    """
    kept = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(finite(F.col("vector")))
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    one = kept.select(F.size("vector").alias("dim")).first()
    if one is None:
        return table.sparkSession.createDataFrame([], schema)
    dim = one["dim"]

    def moments(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = whole(matrix(batch.column(0), dim), scale, offset)
            n += len(x)
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            total = [a + b for a, b in zip(total, (x if small else x.astype(object)).sum(0).tolist())]
        if n:
            import decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([decimal.Decimal(v) for v in total], pa.decimal128(28, 0))], names=["at", "n", "s"])

    sums = kept.select("vector").mapInArrow(moments, "at int, n long, s decimal(28,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # one row a dimension
    n, totals = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    values, vectors, trace = components(kept, "vector", dim, n, totals, min(k, dim), scale, offset, block, exact, passes)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    varied = values > 8 * dim * EPS * max(values[0], 0.0)
    weights = vectors[:, varied] / np.sqrt(values[varied])

    def projected(vector):
        y = deviations(whole(matrix(vector, dim), scale, offset), n, totals)
        return y, (y.astype(np.float64) / n) @ weights

    def gram(batch):
        w = projected(batch.column(0))[1]
        return w.T @ w

    error = float(np.abs(added(kept.select("vector"), gram) / n - np.eye(int(varied.sum()))).max(initial=0.0)) if varied.any() else 0.0

    def run(batches):
        import decimal

        for all_rows in batches:
            for at in range(0, len(all_rows), 2048):
                batch = all_rows.slice(at, 2048)
                y, w = projected(batch.column(1))
                out = np.full((len(batch), len(values)), np.nan)
                out[:, varied] = w
                each = np.repeat(np.arange(len(batch)), len(values))
                squares = pa.array([decimal.Decimal(v) for v in exact_squares(y)], pa.decimal128(38, 0))
                share = np.where(varied, values, 0.0) / trace if trace > 0 else np.full(len(values), np.nan)
                columns = [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, len(values) + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(each), n, np.int64)), squares.take(pa.array(each)),
                    pa.array(out.reshape(-1), from_pandas=True), pa.array(np.tile(share, len(batch)), from_pandas=True), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
