"""Token counts with a byte-level BPE tokenizer; huge documents are encoded in overlapping chunks.

A tokenizer of this kind first splits the text into pieces with a pattern that looks ahead but
never back, then encodes each piece by itself.  So from a true piece boundary on, pieces and tokens
depend on the text after it alone.  The boundaries of a chunk are true from its own splice on, but
for those so near to its end that the pattern may have looked beyond.  A position that is a
boundary both in a chunk's tail and in the next one's head is therefore true for both, and the two
are spliced there.  Documents for which two chunks share none are encoded again with twice the
overlap, in the end in one chunk.

Defined results
  null or empty text: 0 tokens, in 1 chunk; null doc_id: counted, null in the result
  repeated rows: a result row for each; ties don't arise
  strings of special tokens: ordinary text
  empty table: no rows; extra columns: ignored; very long texts: every character is encoded once or
    twice, spread over tasks by chunk
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .textbatch import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk and of an overlap, and how far the pattern may look ahead of a piece's end.
CHUNK, OVERLAP, LOOK_AHEAD = 32768, 1024, 8


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray, regex.Pattern]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length, regex.compile(pattern)


def _summary(text: str, start: int, overlap: int, last: bool, path: str, pattern: str) -> tuple:
    """Tokens of a chunk, and piece boundaries in its head and tail with the tokens before each."""
    encoding, length, compiled = _tokenizer(path, pattern)
    ends = np.concatenate(([0], np.cumsum(length[np.array(encoding.encode_ordinary(text), dtype=np.int64)])))
    pieces = [m.end() for m in compiled.finditer(text)]
    chars = np.concatenate(([0], pieces)).astype(np.int64)
    width = np.fromiter(map(len, (text[a:b].encode() for a, b in zip(chars[:-1], chars[1:], strict=True))), dtype=np.int64, count=len(pieces))
    at = np.concatenate(([0], np.cumsum(width)))
    before = np.searchsorted(ends, at)
    exact = ends[np.minimum(before, len(ends) - 1)] == at
    head = exact & (chars <= overlap)
    tail = exact & (chars >= len(text) - overlap) & (chars <= len(text) - LOOK_AHEAD) & (not last)
    return len(ends) - 1, chars[head] + start, before[head], chars[tail] + start, before[tail]


def splice(chunks: list[tuple]) -> int | None:
    """Tokens of the document, from its chunks' summaries in order; None where two don't align."""
    total, begin = 0, 0
    for this, following in zip(chunks, chunks[1:], strict=False):
        place, left, right = np.intersect1d(this[3], following[1], return_indices=True)
        if not len(place):
            return None
        total += int(this[4][left[0]]) - begin
        begin = int(following[2][right[0]])
    return total + chunks[-1][0] - begin


def _once(docs: DataFrame, overlap: int, chunk: int, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_tokens, n_chunks of documents in one chunk, and of the others: null where chunks don't align."""
    chunk = max(chunk, 4 * overlap)
    schema = "key bigint, doc_id bigint, chunk int, start bigint, last boolean, n_tokens bigint, text string"
    names = ["key", "doc_id", "chunk", "start", "last", "n_tokens", "text"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _tokenizer(path, pattern)[0]
        for got in batches:
            for part in slices(got, "text"):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    key = xxhash.xxh64_intdigest(f"{doc}|{len(text)}") >> 1
                    if len(text) <= chunk:
                        rows.append((key, doc, None, 0, True, len(encoding.encode_ordinary(text)), None))
                        continue
                    key = xxhash.xxh64_intdigest(text, seed=key & 0xFFFFFFFF) >> 1
                    starts = range(0, len(text) - overlap, chunk - overlap)
                    for k, s in enumerate(starts):
                        rows.append((key, doc, k, s, k == len(starts) - 1, None, text[s : s + chunk]))
                        if len(rows) > 256:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for key, doc, k, start, last, n, text in zip(*[c.to_pylist() for c in got.columns], strict=True):
                if k is None:
                    rows.append((key, doc, None, n, [], [], [], []))
                else:
                    n, *lists = _summary(text, start, overlap, last, path, pattern)
                    rows.append((key, doc, k, n, *[x.tolist() for x in lists]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["key", "doc_id", "chunk", "n_tokens", "head", "head_n", "tail", "tail_n"])

    summary = "key bigint, doc_id bigint, chunk int, n_tokens bigint, head array<bigint>, head_n array<bigint>, tail array<bigint>, tail_n array<bigint>"

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        copies = int((rows["chunk"] == 0).sum())
        rows = rows.drop_duplicates("chunk").sort_values("chunk")
        n = splice([(r.n_tokens, *map(np.asarray, (r.head, r.head_n, r.tail, r.tail_n))) for r in rows.itertuples(index=False)])
        doc = rows["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)] * copies, "Int64"), "n_tokens": pd.array([n] * copies, "Int64"), "n_chunks": len(rows)})

    rows = cut(docs.mapInArrow(emit, schema).repartition(partitions(docs.sparkSession), "key", "chunk").mapInArrow(encode, summary))
    whole = rows.where("chunk is null").select("doc_id", "n_tokens", F.lit(1).cast("bigint").alias("n_chunks"))
    chunked = rows.where("chunk is not null").groupBy("key").applyInPandas(join, "doc_id bigint, n_tokens bigint, n_chunks bigint")
    return whole, cut(chunked)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and in how many chunks the document was encoded."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    first_chunk = max(chunk, 4 * overlap)
    done, chunked = _once(docs, overlap, chunk, vocabulary, pattern)
    while chunked.where("n_tokens is null").head(1):
        overlap *= 2
        open_ = chunked.where("n_tokens is null").select("doc_id").distinct()
        # rows that share an open row's id are done again with it
        done = done.union(chunked.alias("c").join(open_.alias("o"), F.expr("c.doc_id <=> o.doc_id"), "left_anti"))
        again = docs.alias("d").join(open_.alias("o"), F.expr("d.doc_id <=> o.doc_id"), "left_semi").where(F.length("text") > first_chunk)
        whole, chunked = _once(again, overlap, chunk, vocabulary, pattern)
        done = done.union(whole)
    return done.union(chunked)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
