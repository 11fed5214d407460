"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

A sequence is filled greedily with the longest pieces that fit.  Then its smallest piece is
replaced by two unpacked ones if they fill the gap, expanded by that piece, more tightly.
Documents are spread by hash over groups of about ``GROUP_DOCS`` documents or ``GROUP_BYTES`` of
text, whichever are more groups, and packed group by group, so the work is in proportion to the
documents and a task holds one group; lengths are integers, so a step costs as much at any size.
Within a group documents are in the order of their ids, then of a hash of their texts, so that
every run gives the same sequences.

Tokens are words, as in ``mixing``.

Defined results
  null doc_id: packed, null in doc_ids; null or empty text: no tokens, not packed
  documents above the capacity: cut into full pieces, each a sequence, and a rest that is packed
  repeated rows: each is packed
  ties: of equal lengths the piece that comes last in the order of ids comes first, and one that was
    put back before all; of pairs that fill a gap alike the one with the shortest piece
  empty table: no rows; extra columns: ignored; very long texts: packed whole
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .mixing import Pieces, piece_fields, token_edges
from .textbatch import slices, words

CAPACITY, GROUP_DOCS, GROUP_BYTES = 2048, 8192, 32 << 20


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths`` (all from 1 to capacity)."""
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stock = [order[bounds[n] : bounds[n + 1]].tolist() for n in range(capacity + 1)]
    count = np.diff(bounds)
    size = np.arange(capacity + 1)
    fits = np.maximum.accumulate(np.where(count > 0, size, 0))  # the longest length in stock up to each
    left = len(lengths)
    bins = []

    def change(n: int, by: int) -> None:
        nonlocal fits
        count[n] += by
        if count[n] == 0 or (by > 0 and count[n] == 1):
            fits = np.maximum.accumulate(np.where(count > 0, size, 0))

    while left:
        chosen, gap = [], capacity
        while (n := int(fits[gap])) > 0:
            chosen.append(stock[n].pop())
            change(n, -1)
            gap -= n
        left -= len(chosen)
        if gap and left:
            small = int(lengths[chosen[-1]])  # greedy takes lengths in falling order
            room = gap + small
            a = np.flatnonzero(count[: room + 1])
            b = fits[np.maximum(room - a, 0)]
            twice = (b == a) & (count[a] < 2)
            b = np.where(twice, fits[np.maximum(np.minimum(room - a, a - 1), 0)], b)
            both = np.where(b > 0, a + b, 0)
            if len(both) and both.max() > small:
                k = int(both.argmax())
                back = chosen.pop()
                for n in (int(a[k]), int(b[k])):
                    chosen.append(stock[n].pop())
                    change(n, -1)
                stock[small].append(back)
                change(small, 1)
                left -= 1
        bins.append(chosen)
    return bins


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """pack_group, bin, used, doc_ids, first_tokens, lengths, texts: the sequences with their pieces."""
    many = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(docs["text"].cast("string"))).alias("bytes")).first()
    groups = max(1, -(-many["n"] // group_docs), -(-(many["bytes"] or 0) // GROUP_BYTES))
    arrow, spark_ = piece_fields(())
    schema = pa.schema([*[pa.field(n, pa.int64()) for n in ("pack_group", "bin", "used")], *arrow])
    out = T.StructType([*[T.StructField(n, T.LongType()) for n in ("pack_group", "bin", "used")], *spark_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None
        for batch in batches:
            for part in slices(batch, "text"):
                group = part.column(2)[0].as_py()
                w = words(part.column(1))
                ids, counts = part.column(0).to_pylist(), w.counts()
                for r in np.flatnonzero(counts).tolist():
                    edges = token_edges(w, r)
                    for at in range(0, int(counts[r]), capacity):
                        n = min(capacity, int(counts[r]) - at)
                        held.append((ids[r], at, n, w.data[edges[at] : edges[at + n]].tobytes()))
        rows = Pieces(())
        for k, chosen in enumerate(best_two_fit(np.array([h[2] for h in held], dtype=np.int64), capacity)):
            pieces = [held[c] for c in chosen]
            rows.add((group, k, sum(p[2] for p in pieces)), pieces)
            if rows.bytes > 4 << 20:
                yield rows.batch(schema)
        if rows.rows:
            yield rows.batch(schema)

    spread = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    spread = spread.repartitionById(groups, F.col("group")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return spread.mapInArrow(run, out)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
