"""Exact k nearest neighbours (Euclidean) by pivot-table elimination.

Distances to many pivots are stored with each vector.  The largest difference between a query's
and a candidate's distance to a pivot is a lower bound of theirs.  Cells hold the vectors that
share a nearest pivot, in shards of ``SHARD_ROWS``, with each cell's range of distances to every
pivot.  A query first searches its own shard, which bounds its k-th distance, then the shards of
those cells whose ranges allow something nearer.

Within a shard candidates are evaluated in the order of their bounds, in steps that grow, until
the next bound exceeds the k-th distance found.  A block of queries with the same nearest pivot
shares its order, by the least of their bounds, so that a step is one product of matrices; it ends
when no query of the block can gain.  Products choose only, within a proven error; distances are
those of differences.  Slacks are relative to the distances at hand, so any scale and offset of
the vectors gives exact results.

Distances are rounded to six decimals; of equal ones the lower id is nearer.

Defined results
  null id, null or empty vector, null, NaN or infinite component, a length other than the
    commonest: the row is no query and no candidate
  repeated ids: a vector is no neighbour of a row with its own id; an id is listed once a distance
  repeated vectors under other ids: neighbours at distance 0
  fewer than k others: as many as there are; empty table: no rows; extra columns: ignored
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import NEIGHBOURS, asked, best, matrix, neighbours, stream, usable

K, PIVOTS, SHARD_ROWS = 10, 32, 8192
#: Rows that pivots are chosen among (any pivots give the same result), queries of a block, and candidates of the first and the largest step.
PIVOT_SAMPLE, BLOCK, STEP, LARGEST_STEP = 2048, 64, 256, 4096
#: Half of the last decimal: distances that are rounded alike may differ by twice as much.
_ROUND = 5e-7


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other, the first one the farthest from the mean."""
    if not len(vectors):
        return vectors
    distance = np.linalg.norm(vectors - vectors.mean(axis=0), axis=1)
    chosen: list[int] = []
    nearest = np.full(len(vectors), np.inf)
    while len(chosen) < min(count, len(vectors)):
        k = int(distance.argmax())
        if chosen and nearest[k] == 0:
            break
        chosen.append(k)
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[k], axis=1))
        distance = nearest
    return vectors[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by differences, exact to a few units in the last place."""
    out = np.empty((len(v), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((v - p) ** 2).sum(axis=1))
    return out


def _firsts(query: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest (query, distance, id) of each query, each once."""
    order = np.lexsort((ids, d, query))
    query, d, ids = query[order], d[order], ids[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (d[1:] != d[:-1]) | (ids[1:] != ids[:-1])
    query, d, ids = query[fresh], d[fresh], ids[fresh]
    some = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[some], d[some], ids[some]


class Shard:
    """Vectors of a shard with their pivot table; ``evaluated`` counts the pairs whose distance was looked at."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivot: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.table = np.ascontiguousarray(pivot.T, dtype=np.float32)
        self.farthest = float(pivot.max())
        self.centre = v.mean(axis=0)
        self.moved = v - self.centre
        self.square = (self.moved**2).sum(axis=1)
        self.largest = float(np.abs(v).max())
        self.twice = int(np.unique(ids, return_counts=True)[1].max())
        self.evaluated = 0

    def search(self, q_id: np.ndarray, q: np.ndarray, q_pivot: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, distance) of each query's k nearest at most ``limit`` away."""
        order = np.lexsort((q_pivot.min(axis=1), q_pivot.argmin(axis=1)))
        out = [self._block(q_id[some], q[some], q_pivot[some], k, limit[some]) for some in (order[at : at + BLOCK] for at in range(0, len(order), BLOCK))]
        query, d, ids = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        return query, ids, d

    def _block(self, q_id: np.ndarray, q: np.ndarray, q_pivot: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = q_pivot.astype(np.float32)
        bound = np.zeros((len(q), len(self.v)), dtype=np.float32)
        gap = np.empty_like(bound)
        for p in range(len(self.table)):
            np.subtract(self.table[p][None, :], near[:, p : p + 1], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        # single precision errs by less than three parts in 2**24 of the larger distance
        slack = 4 * 2.0**-24 * max(self.farthest, float(q_pivot.max()))
        least = bound.min(axis=0)
        order = np.argsort(least, kind="stable")
        moved = q - self.centre
        square = (moved**2).sum(axis=1)
        reach = max(float(self.square.max()), float(square.max()))
        error = 1e-12 * reach + 1e-13 * max(self.largest, float(np.abs(q).max())) * np.sqrt(reach)
        kth = limit.astype(float).copy()
        best_ = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, max(STEP, 2 * k * self.twice)
        while at < len(order):
            if least[order[at]] - slack > kth.max() + 2 * _ROUND:
                break  # so are all that follow
            live = np.flatnonzero(kth + 2 * _ROUND + slack >= least[order[at]])
            rows = order[at : at + step]
            at, step = at + step, min(2 * step, LARGEST_STEP)
            self.evaluated += len(live) * len(rows)
            d2 = self.square[rows][None, :] + square[live][:, None] - 2 * (moved[live] @ self.moved[rows].T)
            d2[bound[np.ix_(live, rows)] - slack > kth[live][:, None] + 2 * _ROUND] = np.inf
            d2[self.ids[rows][None, :] == q_id[live][:, None]] = np.inf
            most = (kth[live] + 2 * _ROUND) ** 2 + error
            open_ = np.flatnonzero(~np.isfinite(kth[live]))
            if len(open_) and len(rows) > k * self.twice:
                # as many rows as surely hold k of different ids
                start = np.sqrt(np.maximum(np.partition(d2[open_], k * self.twice - 1, axis=1)[:, k * self.twice - 1], 0) + error)
                most[open_] = (start + 2 * _ROUND) ** 2 + error
            x, y = np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))
            if not len(x):
                continue
            mine, row = live[x], rows[y]
            d = np.round(np.sqrt(((self.v[row] - q[mine]) ** 2).sum(axis=1)), 6)
            keep = d <= limit[mine] + 2 * _ROUND
            found = mine[keep], d[keep], self.ids[row[keep]]
            best_ = _firsts(*(np.concatenate(c) for c in zip(best_, found, strict=True)), k)
            last = np.searchsorted(best_[0], np.arange(len(q)), side="right")
            full = np.bincount(best_[0], minlength=len(q)) == k
            kth[full] = np.minimum(kth[full], best_[1][last[full] - 1])
        return q_id[best_[0]], best_[1], best_[2]


def _unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def top_k(embeddings: DataFrame, k: int = K, n_pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, choose: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """query_id, neighbour_id, distance and rank: the k nearest others, exactly, of every vector or of those that ``choose`` keeps."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()
    pivots = choose_pivots(matrix(sample.column(0)), n_pivots)
    if not len(pivots):
        return spark.createDataFrame([], NEIGHBOURS + ", rank int")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = to_pivots(matrix(batch.column(1)), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), batch.column(0), batch.column(1), pa.array([x.tobytes() for x in d], pa.binary())], names=["cell", "vec_id", "v", "extra"])

    placed = cut(rows.mapInArrow(assign, "cell int, vec_id bigint, v array<double>, extra binary"))

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell in this task how many rows it has, and the ranges."""
        count, low, high = np.zeros(len(pivots), np.int64), np.full((len(pivots),) * 2, np.inf), np.full((len(pivots),) * 2, -np.inf)
        for batch in batches:
            if batch.num_rows:
                cell, d = np.asarray(batch.column(0)), _unpack(batch.column(1))
                count += np.bincount(cell, minlength=len(pivots))
                np.minimum.at(low, cell, d)
                np.maximum.at(high, cell, d)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([low[c].tolist()]), pa.array([high[c].tolist()])], names=["cell", "n", "low", "high"])

    ranges = placed.select("cell", "extra").mapInArrow(extent, "cell int, n bigint, low array<double>, high array<double>")
    ends = [F.array(*[f(F.expr(f"{name}[{j}]")) for j in range(len(pivots))]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    # as many rows as pivots, at any size of the table
    cells = {r.cell: r for r in ranges.groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect()}
    first: dict[int, tuple[int, int]] = {}
    shard, filled = -1, shard_rows
    for c in sorted(cells):
        # large cells are split by hash, small ones share a shard with the next
        if filled + cells[c].n > shard_rows:
            shard, filled = shard + 1, 0
        parts = max(1, -(-cells[c].n // shard_rows))
        first[c] = (shard, parts)
        filled += cells[c].n if parts == 1 else shard_rows
        shard += parts - 1
    where = F.broadcast(spark.createDataFrame([(c, s, n) for c, (s, n) in first.items()], "cell int, base int, parts int"))
    shards = placed.join(where, "cell").select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "v", "extra")
    queries = choose(placed).join(where, "cell").select("cell", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "v", "extra")

    def prepare(data: pa.Table) -> Shard:
        return Shard(data.column("vec_id").to_numpy(), matrix(data.column("v")), _unpack(data.column("extra")))

    def own(ready: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield neighbours(*ready.search(np.asarray(part.column(0)), matrix(part.column(1)), _unpack(part.column(2)), k, np.full(part.num_rows, np.inf)))

    near = cut(stream(shards, queries.drop("cell"), prepare, own, NEIGHBOURS))
    # the k-th distance in the own shard, if it has as many
    found = F.sort_array(F.collect_set(F.struct("distance", "neighbour_id")))
    tau = near.groupBy("query_id").agg(found.alias("d")).select(F.col("query_id").alias("vec_id"), F.expr(f"get(d, {k - 1}).distance").alias("tau"))
    names = np.array(sorted(cells))
    low, high = (np.array([cells[c][side] for c in names]) for side in ("low", "high"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, limit = _unpack(batch.column(3)), np.asarray(batch.column(4).fill_null(np.inf))
            slack = 1e-12 * max(float(d.max()), float(high.max()))
            bound = np.zeros((batch.num_rows, len(names)))
            for p in range(len(pivots)):
                np.maximum(bound, np.maximum(low[:, p][None] - d[:, p : p + 1], d[:, p : p + 1] - high[:, p][None]), out=bound)
            row, to = np.nonzero(bound - slack <= limit[:, None] + 2 * _ROUND)
            take = pa.array(row)
            extra = [x + np.float64(t).tobytes() for x, t in zip(batch.column(3).take(take).to_pylist(), limit[row], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names[to].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(extra, pa.binary())], names=["cell", "own", "vec_id", "v", "extra"])

    far = queries.join(tau, "vec_id", "left").select("shard", "vec_id", "v", "extra", "tau").mapInArrow(route, "cell int, own int, vec_id bigint, v array<double>, extra binary")
    # cells that share a shard ask it once
    far = far.join(where, "cell").withColumn("shard", F.explode(F.sequence("base", F.col("base") + F.col("parts") - 1))).where("shard <> own")
    far = cut(far.dropDuplicates(["shard", "vec_id", "v"]).select("shard", "vec_id", "v", "extra"))

    def others(ready: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d = _unpack(part.column(2))
        yield neighbours(*ready.search(np.asarray(part.column(0)), matrix(part.column(1)), d[:, :-1], k, d[:, -1]))

    return best(near.union(stream(shards, far, prepare, others, NEIGHBOURS)), k)


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), choose=asked)


OP7_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_distance(a.v, b.v), 6) AS distance
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
)
SELECT query_id, neighbour_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank
FROM d QUALIFY rank <= 10
"""
