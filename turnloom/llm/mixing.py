"""Mixing sources to target weights.

Tokens are words, each with the white space after it (a document's first also with that before),
so that the pieces of a document put together are its text.

1. The documents of a source are laid end to end and cut into blocks of ``block`` tokens, within
   a task; what is left over at the tasks' ends is packed once more by source.
2. Blocks get a dense index within their source.
3. Each output shard draws its sources' block counts from a multinomial with the target weights.
4. The k-th slot of a source takes block perm(k mod n) of its n blocks, where perm is a
   pseudorandom permutation of the source and epoch; slots join blocks by (source, index).

All draws come from the seed, the shard and the source, so a lost task is redone alike.

Defined results
  null source: a source of its own with an empty name; null doc_id: kept as null
  null or empty text, or white space only: no tokens, in no block
  repeated rows: each is packed; ties don't arise
  empty table: no blocks, no rows; extra columns: ignored unless named in ``carry``
  very long texts: cut into as many pieces as their tokens need
  last block of a source: shorter, as is that of each 1024 tasks' left-overs
  weights: of sources without blocks are dropped, the rest count relative to their sum; sources
    without a weight are left out; no weights mean equal ones
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions, table, temporary_table
from .textbatch import mix, slices, words

BLOCK, SHARD, SEED = 512, 1024, 17
#: Shards whose counts are summed as one.
SPAN = 4096
#: Rows of the table of index offsets that are broadcast at most, 40 bytes each; beyond, it is joined.
OFFSET_ROWS = 1_000_000


class Pieces:
    """Rows of arrays, one entry a piece of a document, built column by column."""

    def __init__(self, carry: Sequence[str]) -> None:
        self.carry = list(carry)
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, head: tuple, pieces: list[tuple]) -> None:
        """pieces: doc_id, first token, tokens, bytes, carried values."""
        self.rows.append((*head, *[[p[k] for p in pieces] for k in range(4 + len(self.carry))]))
        self.bytes += sum(len(p[3]) for p in pieces)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in schema]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        self.clear()
        return out


def piece_fields(carry: Sequence[str]) -> tuple[list[pa.Field], list[T.StructField]]:
    names = [("doc_ids", pa.int64(), T.LongType()), ("first_tokens", pa.int64(), T.LongType()), ("lengths", pa.int64(), T.LongType()), ("texts", pa.string(), T.StringType())]
    names += [(c, pa.string(), T.StringType()) for c in carry]
    return [pa.field(n, pa.list_(a)) for n, a, _ in names], [T.StructField(n, T.ArrayType(s)) for n, _, s in names]


def token_edges(w, row: int) -> np.ndarray:
    """Byte bounds of a row's tokens: the first begins with the text, the last ends with it."""
    edges = np.append(w.start[w.first[row] : w.first[row + 1]], w.offsets[row + 1])
    edges[0] = w.offsets[row]
    return edges


def _blocks(docs: DataFrame, block: int, carry: Sequence[str]) -> DataFrame:
    """source, part, local, n_tokens and the pieces; part and local name a block within its source."""
    arrow, spark_ = piece_fields(carry)
    schema = pa.schema([pa.field("source", pa.string()), pa.field("part", pa.int64()), pa.field("local", pa.int64()), pa.field("n_tokens", pa.int64()), *arrow])
    out = T.StructType([T.StructField("source", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("part", "local", "n_tokens")], *spark_])

    def cut_blocks(open_: dict, local: dict, source: str, pieces: Iterator[tuple], rows: Pieces, part: int) -> None:
        held, filled = open_.get(source, ([], 0))
        for doc, first, edges, data, carried in pieces:
            at, count = 0, len(edges) - 1
            while at < count:
                take = min(count - at, block - filled)
                held.append((doc, first + at, take, data[edges[at] : edges[at + take]].tobytes(), *carried))
                at, filled = at + take, filled + take
                if filled == block:
                    rows.add((source, part, local.get(source, 0), filled), held)
                    local[source] = local.get(source, 0) + 1
                    held, filled = [], 0
        open_[source] = (held, filled)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_: dict[str, tuple] = {}
        local: dict[str, int] = {}
        rows = Pieces(carry)
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words(piece.column(1))
                ids, sources = piece.column(0).to_pylist(), piece.column(2).to_pylist()
                extra = list(zip(*[piece.column(3 + k).to_pylist() for k in range(len(carry))], strict=True)) if carry else [()] * len(ids)
                for r in np.flatnonzero(w.counts()).tolist():
                    cut_blocks(open_, local, sources[r], [(ids[r], 0, token_edges(w, r), w.data, extra[r])], rows, part)
                    if rows.bytes > 4 << 20:
                        yield rows.batch(schema)
        for source, (held, filled) in open_.items():
            if held:
                rows.add((source, part, -1, filled), held)
        yield rows.batch(schema)

    def again(rest: pd.DataFrame) -> pd.DataFrame:
        """The left-over pieces of one source and up to 1024 tasks, packed into blocks."""
        rest = rest.sort_values("part")
        part = -1 - int(rest["part"].iloc[0]) // 1024
        open_: dict[str, tuple] = {}
        local: dict[str, int] = {}
        rows = Pieces(carry)
        for r in rest.itertuples(index=False):
            for k in range(len(r.doc_ids)):
                text = pa.array([r.texts[k]], pa.string())
                w = words(text)
                doc = None if pd.isna(r.doc_ids[k]) else int(r.doc_ids[k])
                carried = tuple(getattr(r, c)[k] for c in carry)
                cut_blocks(open_, local, r.source, [(doc, int(r.first_tokens[k]), token_edges(w, 0), w.data, carried)], rows, part)
        for source, (held, filled) in open_.items():
            if held:
                rows.add((source, part, local.get(source, 0), filled), held)
        return pd.DataFrame([list(r) for r in rows.rows], columns=schema.names).astype({"part": "int64", "local": "int64", "n_tokens": "int64"})

    used = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), *[docs[c].cast("string").alias(c) for c in carry])
    spark = docs.sparkSession
    # all of it is needed twice, to number the blocks and to place them
    path = temporary_table(spark, "blocks")
    used.mapInArrow(pack, out).write.partitionBy().parquet(path)
    rest = spark.read.schema(out).parquet(path).where("local < 0")
    spark_rest = rest.groupBy("source", F.floor(F.col("part") / 1024).alias("task_group")).applyInPandas(again, out)
    spark_rest.write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path).where("local >= 0")


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), by key: a Feistel network with cycle walking."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = network(index.astype(np.uint64))
    while True:
        outside = out >= size
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = network(out[outside])


def _name_key(name: str, seed: int, epoch: int = 0) -> int:
    h = 1469598103934665603
    for b in f"{seed}|{epoch}|{name}".encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, epochs: float = 1.0, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """shard, slot, source, block_index, epoch, n_tokens, doc_ids, first_tokens, lengths, texts.

    As many slots as ``epochs`` times the blocks there are; a source with more slots than blocks
    repeats, one with fewer gives a random subset.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, block, carry)
    per_part = cut(blocks.groupBy("source", "part").agg(F.count("*").alias("blocks")))
    before = F.sum("blocks").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.withColumn("offset", F.coalesce(before, F.lit(0))).select("source", "part", "offset")
    # a row a task and source: sent to all tasks while that is small, so that blocks move only once
    offsets = F.broadcast(offsets) if per_part.count() <= OFFSET_ROWS else offsets
    indexed = blocks.join(offsets, ["source", "part"]).withColumn("block_index", F.col("offset") + F.col("local")).drop("offset", "part", "local")

    sizes = {r.source: r.n for r in per_part.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    names = sorted(s for s in sizes if weights is None or weights.get(s, 0) > 0)
    p = np.array([1.0 if weights is None else float(weights[s]) for s in names])
    p = p / p.sum() if len(p) else p
    total = int(round(epochs * sum(sizes[s] for s in names)))
    shards = -(-total // shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"].tolist():
                slots = min(shard, total - s * shard)
                count = np.random.default_rng([seed, s]).multinomial(slots, p)
                base = np.concatenate(([0], np.cumsum(count)[:-1]))
                yield pd.DataFrame({"shard": s, "source": names, "count": count, "base": base, "slots": slots})

    drawn = spark.range(0, shards, 1, min(max(1, shards), partitions(spark))).mapInPandas(draw, "shard bigint, source string, count bigint, base bigint, slots bigint")
    # how many slots of its source come before, by groups of shards first, so that no task orders all shards
    drawn = drawn.where("count > 0").withColumn("span", F.floor(F.col("shard") / SPAN))
    spans = drawn.groupBy("source", "span").agg(F.sum("count").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("source", "span", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    before = F.sum("count").over(Window.partitionBy("source", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).join(spans, ["source", "span"]).withColumn("start", F.col("earlier") + F.col("before"))
    # a row becomes up to ``shard`` slots, so rows are spread before
    drawn = drawn.select("shard", "source", "count", "base", "slots", "start").repartition(min(max(1, shards), partitions(spark)), "shard", "source")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                n = sizes[r.source]
                ordinal = np.arange(r.start, r.start + r.count)
                epoch = ordinal // n
                index = np.concatenate([permute(ordinal[epoch == e] % n, n, _name_key(r.source, seed, int(e))) for e in np.unique(epoch)])
                order = np.random.default_rng([seed, r.shard, 1]).permutation(r.slots)
                yield pd.DataFrame({"shard": r.shard, "slot": order[r.base : r.base + r.count], "source": r.source, "block_index": index, "epoch": epoch})

    slots = drawn.mapInPandas(place, "shard bigint, slot bigint, source string, block_index bigint, epoch bigint")
    # the slots are the light side: a hash table of them, so that the blocks aren't sorted
    joined = indexed.join(slots.hint("shuffle_hash"), ["source", "block_index"])
    return joined.select("shard", "slot", "source", "block_index", "epoch", "n_tokens", "doc_ids", "first_tokens", "lengths", "texts", *carry)


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The mixture as rows with the columns doc_id, text, lang, source, n_chars, a row a piece."""
    mixed = mix_sources(docs, weights, carry=["lang"], **options)
    pieces = mixed.select("source", F.explode(F.arrays_zip("doc_ids", "texts", "lang")).alias("p"))
    return pieces.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.texts").alias("text"), F.col("p.lang").alias("lang"), F.nullif(F.col("source"), F.lit("")).alias("source"), F.length("p.texts").cast("bigint").alias("n_chars"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
