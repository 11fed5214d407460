"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a slot is a bit mask with one bit a language, and
the AND of a byte n-gram's slots is the set of languages that contain it.  A document's popcount
for each language, corrected for the false positives that the language's fill implies, decides.

Defined results
  null or empty text, or text without letters: no n-grams, language ``und``
  null doc_id: kept, as any other row; repeated rows: each judged by itself
  equal corrected counts: the language that sorts first
  more than 64 languages: a mask for every 64
  no labelled rows, or an empty table: no languages are known, every row is ``und``
  very long texts: read whole, in slices that are cut between rows
  extra columns: ignored by ``identify``, passed through by ``keep_identified``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, table
from .textbatch import mix, raw, slices

UNKNOWN = "und"
#: Labelled rows a language that the filters are trained on, at most.
SAMPLE_ROWS = 1500
ORDER, SLOTS_LOG2, PROBES, LEAST_SHARE, LEAST_ROWS = 4, 21, 2, 0.3, 0.02

_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _CLASS[_c] = _c


@dataclass
class LanguageFilters:
    """The slots as one mask each for every 64 languages, and the probability that a foreign n-gram hits a language."""

    languages: list[str]
    masks: list[np.ndarray]
    false_positive: np.ndarray


def _ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows' n-grams, and the bounds of each row's.  Runs of non-letters are one space."""
    data, offsets = raw(pc.utf8_lower(text.fill_null("") if text.null_count else text))
    rows = len(offsets) - 1
    # a space before and after each row, so that short words have n-grams too
    padded = np.full(len(data) + 2 * rows, 32, dtype=np.uint8)
    where = np.arange(len(data)) + np.repeat(1 + 2 * np.arange(rows), np.diff(offsets))
    padded[where] = _CLASS[data]
    offsets = offsets + 2 * np.arange(rows + 1)
    keep = padded != 32
    keep[1:] |= padded[:-1] != 32
    keep[offsets[:-1]] = True
    if len(padded):
        # the space that opens a row stays, a second one right after it goes
        second = offsets[:-1] + 1
        keep[second[padded[second] == 32]] = False
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    letters = padded[keep].astype(np.uint64)
    m = len(letters) - ORDER + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    key = np.zeros(m, dtype=np.uint64)
    for k in range(ORDER):
        key |= letters[k : k + m] << np.uint64(8 * k)
    inside = np.ones(m, dtype=bool)
    for k in range(1, ORDER):
        edge = kept[1:-1] - k
        inside[edge[(edge >= 0) & (edge < m)]] = False
    # rows shorter than the order would let an n-gram reach past two edges; the loop above covers it,
    # as an n-gram crosses an edge exactly if it begins at most ORDER-1 before one
    bounds = np.concatenate(([0], np.cumsum(inside)))[np.minimum(kept, m)]
    return key[inside], bounds


def _slots(keys: np.ndarray, slots_log2: int) -> list[np.ndarray]:
    h = mix(keys)
    low = np.uint64((1 << slots_log2) - 1)
    return [((h >> np.uint64(k * slots_log2)) & low).astype(np.int32) for k in range(PROBES)]


def _plane(texts: pd.Series, slots_log2: int) -> bytes:
    """The bits of one language: n-grams in at least the share ``LEAST_ROWS`` of its rows.

    That leaves out n-grams of foreign passages within labelled rows, the more surely the more rows there are.
    """
    seen = []
    for text in texts:
        keys, _ = _ngrams(pa.array([text], pa.string()))
        seen.append(np.unique(keys))
    keys, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
    keys = keys[count >= LEAST_ROWS * len(seen)]
    bits = np.zeros(1 << slots_log2, dtype=bool)
    for slot in _slots(keys, slots_log2):
        bits[slot] = True
    return np.packbits(bits).tobytes()


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slots_log2: int = SLOTS_LOG2) -> LanguageFilters:
    """Filters from at most ``sample_rows`` labelled rows a language, chosen by a hash of doc_id."""
    labelled = columns(docs, "doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    # a hash leaves twice the sample, so that only so much is ranked
    counts = labelled.groupBy("lang").agg(F.count("*").alias("__rows"))
    share = (F.xxhash64("doc_id", F.lit("share")) / 2.0**64 + 0.5) * F.col("__rows") < 2 * sample_rows + 100
    few = labelled.select("lang", "doc_id").join(F.broadcast(counts), "lang").where(share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("lang", "doc_id")
    # bounded by the parameter times the languages, so it may be broadcast at every size
    sample = labelled.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "plane": [_plane(rows["text"], slots_log2)]})

    planes = {r.lang: r.plane for r in sample.groupBy("lang").applyInPandas(fit, "lang string, plane binary").collect()}
    languages = sorted(planes)
    masks, fill = [], []
    for at in range(0, len(languages), 64):
        some = languages[at : at + 64]
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(some) <= n)
        mask = np.zeros(1 << slots_log2, dtype=kind)
        for k, name in enumerate(some):
            bits = np.unpackbits(np.frombuffer(bytes(planes[name]), dtype=np.uint8)).astype(bool)
            mask[bits] |= kind(1 << k)
            fill.append(bits.mean() ** PROBES)
        masks.append(mask)
    return LanguageFilters(languages, masks, np.array(fill))


def _judge(text: pa.Array, model: LanguageFilters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language or -1, n-grams, and the shares of the best and the second."""
    keys, bounds = _ngrams(text)
    total = np.diff(bounds)
    n_languages = len(model.languages)
    if not n_languages:
        return np.full(len(total), -1), total, np.zeros(len(total)), np.zeros(len(total))
    slots = _slots(keys, int(len(model.masks[0])).bit_length() - 1)
    share = np.zeros((n_languages, len(total)))
    for k, wrong in enumerate(model.false_positive):
        if k % 64 == 0:
            mask = model.masks[k // 64]
            found = mask[slots[0]]
            for slot in slots[1:]:
                found = found & mask[slot]
        bit = ((found >> found.dtype.type(k % 64)) & found.dtype.type(1)).astype(np.uint8)
        count = np.diff(np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))[bounds])
        share[k] = np.maximum(0, (count - total * wrong) / max(1e-9, 1 - wrong)) / np.maximum(total, 1)
    best = share.argmax(axis=0)
    top = share.max(axis=0)
    second = np.sort(share, axis=0)[-2] if n_languages > 1 else np.zeros(len(total))
    best = np.where((total > 0) & (top >= LEAST_SHARE), best, -1)
    return best, total, top, second


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, language, n_grams, and the corrected shares of the best and second language."""
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, language string, n_grams bigint, share double, second_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                best, total, top, second = _judge(part.column(1), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best], pa.string()), pa.array(total, pa.int64()), pa.array(np.round(top, 6)), pa.array(np.round(second, 6))],
                    names=["doc_id", "language", "n_grams", "share", "second_share"],
                )

    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return ids.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """The rows whose language is known, with all their columns."""
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                yield part.filter(pa.array(_judge(part.column(at), model)[0] >= 0))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
