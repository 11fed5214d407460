"""Approximate nearest neighbours with a robust-pruned directed graph in each shard.

Vectors are spread over shards by hash.  In a shard equal vectors are one vertex that carries all
their ids, as pruning leaves copies no edges.  The graph starts out random; then each vector,
in batches, searches the graph greedily from the medoid and its candidates are pruned: the nearest
one stays, and with it go those that are nearer to it, times ``alpha``, than to the vector.  Edges
also point back, and lists that grow too long are pruned likewise.  A query runs a beam search in
each shard, and the nearest of all shards are its result.

Defined results
  null id, null or empty vector, null, NaN or infinite component, a length other than the
    commonest: the row is no query and no candidate
  repeated ids: a vector is no neighbour of a row with its own id; an id is listed once a distance
  repeated vectors under other ids: neighbours at distance 0, the lower ids first
  fewer than k others: as many as there are; empty table: no rows; extra columns: ignored

All steps are seeded, so a shard that is built again is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import NEIGHBOURS, asked, best, matrix, neighbours, stream, usable

K, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA, SHARD_ROWS = 10, 32, 64, 48, 1.2, 8192
#: Vectors searched at once, and beam entries expanded at once.
BATCH, EXPAND = 512, 4


def _distances(v: np.ndarray, norm: np.ndarray, q: np.ndarray, q_norm: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of rows."""
    return np.maximum(norm[rows] + q_norm[:, None] - 2 * np.einsum("bcd,bd->bc", v[rows], q), 0)


def beam_search(v: np.ndarray, norm: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of each query's beam, nearest first; -1 and inf where it isn't full."""
    b, n = len(q), len(v)
    q_norm = (q**2).sum(axis=1)
    rows = np.full((b, beam), -1, dtype=np.int32)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    rows[:, 0], done[:, 0] = start, False
    dist[:, 0] = _distances(v, norm, q, q_norm, np.full((b, 1), start))[:, 0]
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column is for missing edges
    seen[:, start] = seen[:, n] = True
    active = np.arange(b)
    while len(active):
        open_ = ~done[active]
        # the nearest entries not yet expanded
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :EXPAND]
        valid = np.take_along_axis(open_, pick, axis=1)
        done[active[:, None], pick] = True
        source = np.where(valid, np.take_along_axis(rows[active], pick, axis=1), -1)
        edge = np.where(source[:, :, None] >= 0, graph[source], -1).reshape(len(active), -1)
        edge = np.where(edge < 0, n, edge)
        edge.sort(axis=1)
        twice = np.zeros(edge.shape, dtype=bool)
        twice[:, 1:] = edge[:, 1:] == edge[:, :-1]
        fresh = ~twice & ~seen[active[:, None], edge]
        seen[active[:, None], edge] = True
        d = _distances(v, norm, q[active], q_norm[active], np.where(edge < n, edge, 0)).astype(np.float32)
        d[~fresh] = np.inf
        all_d = np.concatenate((dist[active], d), axis=1)
        all_r = np.concatenate((rows[active], np.where(fresh, edge, -1).astype(np.int32)), axis=1)
        all_done = np.concatenate((done[active], ~fresh), axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(all_d, order, axis=1), axis=1), axis=1)
        dist[active], rows[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_d, all_r, all_done))
        active = active[(~done[active]).any(axis=1)]
    return rows, dist


def robust_prune(v: np.ndarray, norm: np.ndarray, own: np.ndarray, rows: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of each row of ``own``, from its candidate rows (-1: none), nearest first."""
    rows = rows.copy()
    rows[rows == own[:, None]] = -1
    rows.sort(axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    d = _distances(v, norm, v[own], norm[own], np.maximum(rows, 0))
    d[rows < 0] = np.inf
    vectors = v[np.maximum(rows, 0)]
    c_norm = norm[np.maximum(rows, 0)]
    edges = np.full((len(own), degree), -1, dtype=np.int32)
    live = np.isfinite(d)
    at = np.arange(len(own))
    for k in range(degree):
        masked = np.where(live, d, np.inf)
        near = masked.argmin(axis=1)
        some = np.isfinite(masked[at, near])
        if not some.any():
            break
        edges[some, k] = rows[at, near][some]
        live[at, near] = False
        picked = vectors[at, near]
        between = c_norm + c_norm[at, near][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, picked)
        live &= ~((alpha**2 * np.maximum(between, 0) <= d) & some[:, None])
    return edges


def build(v: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges of all rows (-1: none) and the row that searches start from."""
    n = len(v)
    norm = (v**2).sum(axis=1)
    rng = np.random.default_rng(seed)
    start = int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, dtype=np.int32)
    if n > 1:
        draw = rng.integers(0, n - 1, (n, min(degree, n - 1, 16)))
        graph[:, : draw.shape[1]] = draw + (draw >= np.arange(n)[:, None])
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            own = order[lo : lo + BATCH]
            found, _ = beam_search(v, norm, graph, start, v[own], beam)
            graph[own] = robust_prune(v, norm, own, np.concatenate((found, graph[own]), axis=1), degree, a)
            # edges back, into free places or by pruning
            source = np.repeat(own, degree)
            target = graph[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            node, first, count = np.unique(target, return_index=True, return_counts=True)
            # those with many edges back together, so that few lists are wide
            by = np.argsort(count, kind="stable")
            node, first, count = node[by], first[by], count[by]
            for p in range(0, len(node), BATCH):
                some, c = node[p : p + BATCH], count[p : p + BATCH]
                inside = np.arange(c[-1]) < c[:, None]
                back = np.where(inside, source[np.where(inside, first[p : p + BATCH, None] + np.arange(c[-1]), 0)], -1)
                known = (back[:, :, None] == graph[some][:, None, :]).any(axis=2)
                both = np.concatenate((graph[some], np.where(known, -1, back)), axis=1)
                full = (both >= 0).sum(axis=1) > degree
                graph[some[~full]] = -np.sort(-both[~full], axis=1)[:, :degree]
                if full.any():
                    graph[some[full]] = robust_prune(v, norm, some[full], both[full], degree, a)
    return graph, start


def vertices(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vectors in the order of their least ids, all ids by vertex and size, and where each vertex's ids start."""
    v = np.ascontiguousarray(v + np.float32(0))  # no negative zeros
    by = np.argsort(ids, kind="stable")
    _, first, number = np.unique(v[by].view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    pairs = np.unique(np.stack((rank[number], ids[by]), axis=1), axis=0)
    return v[by[np.sort(first)]], np.ascontiguousarray(pairs[:, 1]), np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))


def search(embeddings: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM, choose: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """query_id, neighbour_id, distance and rank: about the k nearest others of every vector, or of those that ``choose`` keeps.

    All vectors are indexed, whichever are asked for.
    """
    rows = cut(usable(embeddings))
    total = rows.count()
    n_shards = max(1, -(-total // shard_rows))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))

    def make(data: pd.DataFrame) -> pd.DataFrame:
        ids, v = data["vec_id"].to_numpy(np.int64), np.stack(data["v"].to_numpy()).astype(np.float32)
        v, ids, bounds = vertices(ids, v)
        graph, start = build(v)
        body = b"".join(x.tobytes() for x in (np.array([len(v), v.shape[1], graph.shape[1], start, len(ids)], np.int64), bounds.astype(np.int64), ids, v, graph))
        return pd.DataFrame({"shard": [int(data["shard"].iloc[0])], "vec_id": [0], "v": [[]], "extra": [body]})

    graphs = cut(shards.groupBy("shard").applyInPandas(make, "shard int, vec_id bigint, v array<double>, extra binary"))
    queries = choose(rows).select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "vec_id", "v", F.lit(None).cast("binary").alias("extra"))

    def prepare(data: pa.Table) -> tuple:
        body = data.column("extra")[0].as_py()
        n, dim, degree, start, n_ids = np.frombuffer(body, np.int64, 5).tolist()
        bounds = np.frombuffer(body, np.int64, n + 1, 40)
        ids = np.frombuffer(body, np.int64, n_ids, at := 48 + 8 * n)
        v = np.frombuffer(body, np.float32, n * dim, at := at + 8 * n_ids).reshape(n, dim)
        graph = np.frombuffer(body, np.int32, n * degree, at + 4 * n * dim).reshape(n, degree)
        return ids, bounds, v, (v**2).sum(axis=1), graph, start

    def answer(ready: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, bounds, v, norm, graph, start = ready
        for lo in range(0, part.num_rows, BATCH):
            p = part.slice(lo, BATCH)
            q_id, q = np.asarray(p.column(0)), matrix(p.column(1))
            found, _ = beam_search(v, norm, graph, start, q.astype(np.float32), max(beam, k + 1))
            # a vertex's ids are equally far: the least k besides the query's own are enough
            count = np.where(found >= 0, np.minimum(bounds[found + 1] - bounds[found], k + 1), 0)
            row, hit = np.repeat(np.arange(len(q)), count.sum(axis=1)), np.repeat(found.ravel(), count.ravel())
            near = ids[bounds[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count.ravel(), count.ravel())]
            other = near != q_id[row]
            row, hit, near = row[other], hit[other], near[other]
            some = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, hit, near = row[some], hit[some], near[some]
            exact = np.sqrt(((v[hit].astype(float) - q[row]) ** 2).sum(axis=1))
            yield neighbours(q_id[row], near, np.round(exact, 6))

    return best(stream(graphs, queries, prepare, answer, NEIGHBOURS), k)


def op5_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), choose=asked)
