"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Equal vectors are one node with its smallest ids, so that copies can't fill each other's neighbour lists. Nodes are
dealt to shards by hash; shards grow with the table up to a size that a task can hold, so that the work of building
grows in proportion and queries meet few shards. A shard's graph is built layer by layer from the top: nodes stand in the
order of their levels, so that a layer is a prefix of them and its links are one flat array of fixed width. Whole
batches of nodes are searched, linked and pruned at once with array operations. Queries come in large blocks, so that a
graph is loaded once for many of them; each block meets each shard with a beam that widens with the root of the
shard's size, and the shards' best are merged by exact distances on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import materialize

INDEX = "dim int, shard long, ids array<array<long>>, vectors binary, sizes array<int>, links binary, width int"


def distances(points: np.ndarray, queries: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distance of each query to its own row of point numbers."""
    apart = np.subtract(points[which], queries[:, None, :])
    return np.einsum("qnd,qnd->qn", apart, apart)


def working(points: np.ndarray, single: bool) -> np.ndarray:
    """The points as the graph work sees them: in single precision where the column has no more and no square leaves its range."""
    top = np.abs(points).max(initial=0.0)
    return points.astype(np.float32 if single and 1e-15 < top < 1e15 else np.float64, copy=False)


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, together: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes found for each query from its entry nodes (-1: none): (nodes, squared distances), -1 and inf where fewer."""
    n, width = len(queries), links.shape[1]
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(points) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    nodes = np.full((n, ef), -1)
    dist = np.full((n, ef), np.inf, points.dtype)
    done = np.ones((n, ef), bool)
    new = entry
    while True:
        fresh = ~seen[rows, new]
        # a node may be listed twice among the new ones
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        seen[rows, new] = True
        d = np.where(fresh, distances(points, queries, new), np.inf).astype(points.dtype)
        nodes, dist, done = np.concatenate([nodes, np.where(fresh, new, -1)], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
        best = np.argsort(np.where(nodes < 0, np.inf, dist), axis=1, kind="stable")[:, :ef]
        nodes, dist, done = (np.take_along_axis(x, best, 1) for x in (nodes, dist, done))
        open_ = ~done & (nodes >= 0)
        if not open_.any():
            return nodes, np.where(nodes < 0, np.inf, dist)
        first = np.argsort(~open_, axis=1, kind="stable")[:, :together]
        chosen = np.where(np.take_along_axis(open_, first, 1), np.take_along_axis(nodes, first, 1), -1)
        np.put_along_axis(done, first, True, 1)
        new = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(n, together * width)


def nearest_of(nodes: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest of each row's nodes (-1: none), in no order."""
    if nodes.shape[1] <= most:
        return nodes, dist
    place = np.argpartition(np.where(nodes < 0, np.inf, dist), most - 1, axis=1)[:, :most]
    return np.take_along_axis(nodes, place, 1), np.take_along_axis(dist, place, 1)


def select(points: np.ndarray, own: np.ndarray, nodes: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """For each of own at most `most` of its candidates: nearer to it than to any chosen before, then the nearest left over."""
    order = np.argsort(np.where(nodes < 0, np.inf, dist), axis=1, kind="stable")
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    n, k = nodes.shape
    vectors = points[nodes]
    square = np.einsum("nkd,nkd->nk", vectors, vectors)
    between = square[:, :, None] + square[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    chosen, count = np.zeros((n, k), bool), np.zeros(n, int)
    for j in range(k):
        near = np.where(chosen, between[:, j, :], np.inf).min(1)
        take = (nodes[:, j] >= 0) & (count < most) & (dist[:, j] < near)
        chosen[:, j] = take
        count += take
    place = np.argsort(~chosen + 2 * (nodes < 0), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(nodes, place, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def link(points: np.ndarray, links: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
    """Set the links of own, and the links back; lists that overflow are chosen anew."""
    width = links.shape[1]
    links[own, : chosen.shape[1]] = chosen
    source = np.repeat(own, chosen.shape[1])[chosen.reshape(-1) >= 0]
    target = chosen.reshape(-1)[chosen.reshape(-1) >= 0]
    while len(target):
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.repeat(starts, np.diff(np.r_[starts, len(target)]))
        now = rank < width  # the rest of a crowded list in the next round
        which, slot = np.unique(target[now], return_inverse=True)
        added = np.full((len(which), width), -1)
        added[slot, rank[now]] = source[now]
        both = np.concatenate([links[which], added], 1)
        both = np.where((both[:, :, None] == both[:, None, :]) & (np.arange(2 * width)[None, :, None] > np.arange(2 * width)[None, None, :]), True, False).any(2) * (-1 - both) + both
        count = (both >= 0).sum(1)
        fits = count <= width
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
        links[which[fits]] = packed[fits]
        if not fits.all():
            crowded = which[~fits]
            dist = np.where(both[~fits] < 0, np.inf, distances(points, points[crowded], both[~fits]))
            links[crowded] = select(points, crowded, both[~fits], dist, width)
        source, target = source[~now], target[~now]


def build(points: np.ndarray, m: int, ef: int, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order of the points by level, links of each layer from the lowest up); links are places in that order."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1.0 - rng.random(len(points))) / math.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    points, level = points[order], level[order]
    layers: list[np.ndarray] = []
    for height in range(int(level.max(initial=0)), -1, -1):
        size = int((level >= height).sum())
        links = np.full((size, 2 * m if height == 0 else m), -1)
        at = 0
        while at < size:
            batch = np.arange(at, min(size, at + min(256, max(32, at // 2))))
            inside = np.repeat(batch[None, :], len(batch), 0)
            apart = distances(points, points[batch], inside)
            near = np.argsort(np.where(inside == batch[:, None], np.inf, apart), axis=1, kind="stable")[:, : min(ef, len(batch))]
            nodes, dist = np.take_along_axis(inside, near, 1), np.take_along_axis(apart, near, 1)
            nodes = np.where(nodes == batch[:, None], -1, nodes)
            if at:
                entry = descend(points, layers, points[batch])
                entry = np.where(entry < at, entry, -1)
                entry = np.concatenate([entry, np.zeros((len(batch), 1), int)], 1)  # some node of the layer in any case
                found, far = beam(points[:size], links, points[batch], entry, ef)
                nodes, dist = np.concatenate([nodes, found], 1), np.concatenate([dist, far], 1)
            link(points, links, batch, select(points, batch, *nearest_of(nodes, dist, ef), m))
            at += len(batch)
        layers.insert(0, links)
    return order, layers


def descend(points: np.ndarray, upper: list[np.ndarray], queries: np.ndarray, ef: int = 4) -> np.ndarray:
    """Entry nodes for the layer below `upper` (lowest first)."""
    entry = np.zeros((len(queries), 1), int)
    for links in reversed(upper):
        entry, _ = beam(points[: len(links)], links, queries, entry, ef)
    return entry


def _usable(vector):
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def shard_count(rows: int, shard_rows: int, most_shard_rows: int, early: int = 8) -> int:
    """Shards of about shard_rows until there are `early` of them, then no more until they are full."""
    return max(1, -(-rows // most_shard_rows), min(early, -(-rows // shard_rows)))


def nearest(table: DataFrame, k: int = 10, every: int = 100, m: int = 16, ef_build: int = 64, ef_search: int = 256, shard_rows: int = 16384, most_shard_rows: int = 131072, most_shard_bytes: int = 256 << 20, block_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    score is the Euclidean distance in double precision; ties go to smaller ids. Vectors that are null, zero or hold a
    null or non-finite component take no part, nor do rows without an id; vectors of another length are not
    compared. A repeated row counts once. Copies of a query's vector are candidates at distance 0. Fewer than k
    candidates are all returned. An empty table gives an empty result; other columns are ignored. ef_search is the
    width of the beam in a shard of shard_rows. A shard's vectors take at most about most_shard_bytes, however long they are.
    """
    single = table.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")  # as the column has them: distances are taken in double precision
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & _usable(F.col("vector")))
    first = Window.partitionBy("vector").orderBy("id")
    few = vectors.distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector"))  # k + 1 ids at most
    nodes = materialize(nodes, "ann-nodes")
    most = lambda dim: max(1, min(most_shard_rows, most_shard_bytes // (kind.itemsize * dim)))
    shards = {r.dim: shard_count(r.n, min(shard_rows, most(r.dim)), most(r.dim)) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    count = F.lit(1)
    for dim, n in shards.items():
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), count).cast("long"))
    tasks = 4 * sum(shards.values()) or 1  # by number, so that no two shards are put together for being small

    def index(group: pa.Table) -> pa.Table:
        ids = group.column("ids").to_pylist()
        dim = group.column("dim")[0].as_py()
        points = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
        by_id = np.argsort([x[0] for x in ids], kind="stable")  # the same graph however the rows arrive
        order, layers = build(working(points[by_id], single), m, ef_build)
        order = by_id[order]
        width = max(x.shape[1] for x in layers)
        flat = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1) for x in layers]).astype("<i4")
        row = {"dim": dim, "shard": group.column("shard")[0].as_py(), "ids": [ids[i] for i in order], "vectors": points[order].astype(kind).tobytes(), "sizes": [len(x) for x in layers], "links": flat.tobytes(), "width": width}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())), ("links", pa.binary()), ("width", pa.int32())]))

    graphs = materialize(nodes.select("dim", "shard", "ids", "vector").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(index, INDEX), "ann-index")
    asked = vectors.filter(F.col("id") % every == 0).distinct().withColumn("dim", F.size("vector"))
    asked = materialize(asked, "ann-queries")
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))  # about block_rows
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))).drop("block")

    def search(batches):
        for batch in batches:
            for row in range(len(batch)):
                ids, sizes, width = batch.column("ids")[row].as_py(), batch.column("sizes")[row].as_py(), batch.column("width")[row].as_py()
                dim = batch.column("dim")[row].as_py()
                points = np.frombuffer(batch.column("vectors")[row].as_buffer(), kind).reshape(-1, dim)
                flat = np.frombuffer(batch.column("links")[row].as_buffer(), "<i4").reshape(-1, width)
                layers = [flat[a - n : a] for a, n in zip(np.cumsum(sizes).tolist(), sizes)]
                queries = batch.column("queries")[row].values
                keys = queries.field("id").to_numpy()
                wanted = queries.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), dim)
                own = working(points, single and np.abs(wanted).max(initial=0.0) < 1e15)
                ef, out = int(ef_search * max(1.0, len(points) / shard_rows) ** 0.5), []
                for at in range(0, len(keys), 256):
                    part = wanted[at : at + 256]
                    found, _ = beam(own, layers[0], part.astype(own.dtype), descend(own, layers[1:], part.astype(own.dtype)), ef)
                    exact = np.sqrt(np.where(found >= 0, distances(points, part, found), np.inf))
                    best = np.argsort(exact, axis=1, kind="stable")[:, : k + 1]
                    far = np.take_along_axis(exact, best[:, -1:], 1)  # ties with the last one count
                    for key, places, d, last in zip(keys[at : at + 256].tolist(), found, exact, far[:, 0].tolist()):
                        ok = (places >= 0) & (d <= last)
                        near = sorted((x, i) for p, x in zip(places[ok].tolist(), d[ok].tolist()) for i in ids[p] if i != key)[:k]
                        out += [(key, i, x) for x, i in near]
                a, b, c = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = asked.repartition(tasks, "dim", "shard").join(graphs.repartition(tasks, "dim", "shard"), ["dim", "shard"]).select("dim", "ids", "vectors", "sizes", "links", "width", "queries").mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
