"""Vectors in shards, and queries that stream past them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Queries that a task takes past one shard.
QUERIES_A_TASK = 1024
NEIGHBOURS = "query_id bigint, neighbour_id bigint, distance double"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (doubles): rows with an id, of the commonest length, without null or NaN in them."""
    rows = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def asked(rows: DataFrame) -> DataFrame:
    """The registered queries' set of queries: every row whose id is divisible by 20, to be held against all rows."""
    return rows.where("vec_id % 20 = 0")


def stream(shards: DataFrame, queries: DataFrame, prepare: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer(prepare(shard's rows), batch of queries)`` for each shard and its queries.

    shards: shard, vec_id, v, extra (binary); queries the same.  A shard with many queries is copied
    to several tasks, so that none takes more than about QUERIES_A_TASK.
    """
    counts = queries.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("copies"))
    tasks = counts.agg(F.sum("copies")).first()[0] or 1
    copies = F.coalesce("copies", F.lit(0))
    shards, queries = shards.join(counts, "shard"), queries.join(counts, "shard")
    data = shards.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(0).alias("kind"), "vec_id", "v", "extra")
    asked_ = queries.select("shard", F.pmod(F.xxhash64("vec_id"), copies).cast("int").alias("copy"), F.lit(1).alias("kind"), "vec_id", "v", "extra")
    rows = data.union(asked_).repartition(max(1, min(tasks, 4 * partitions(shards.sparkSession))), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1)
            bounds = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1), [True])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if tuple(k[a, :2]) != key:
                    key, held, ready = tuple(k[a, :2]), [], None
                part = batch.slice(a, b - a).select(["vec_id", "v", "extra"])
                if k[a, 2] == 0:
                    held.append(part)
                elif held or ready is not None:
                    if ready is None:
                        ready, held = prepare(pa.Table.from_batches(held)), []
                    yield from answer(ready, part)

    return rows.mapInArrow(run, schema)


def neighbours(query: np.ndarray, neighbour: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(neighbour, pa.int64()), pa.array(distance, pa.float64())], names=["query_id", "neighbour_id", "distance"])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank, equal distances by id."""
    pair = F.struct("distance", "neighbour_id")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(pair)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", F.col("t.neighbour_id").alias("neighbour_id"), F.col("t.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
