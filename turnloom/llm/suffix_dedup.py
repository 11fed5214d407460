"""Passages of at least ``least`` words that occur more than once, found with suffix arrays.

Every window of ``least`` words has an anchor, the n-gram of least hash in it, so equal windows
have equal anchors at equal places.  Windows with the same anchor occurrence form a segment.
Segments are compared by hash within each anchor's group first: a group whose segments are all
alike needs no sorting.  The distinct segments of the other groups are fetched, laid end to end
and suffix-sorted by grouping; neighbours in suffix order that agree on ``least`` words are one
class.  Of each class the occurrence of least (doc_id, position) is the original, the others are
duplicates.  Groups spread over tasks by anchor.  Copies of a passage are sorted once, but those of
its ends, which go on differently in each document, are distinct.  A group whose distinct segments
have more than ``SORT_WORDS`` words is therefore split further: its anchor grows to the whole window,
so that a group's segments are all alike and count as an aggregate, which tasks combine before the
shuffle.  What one task sorts is thus bounded however many documents share a passage.

Words are runs of bytes other than white space.

Defined results
  null doc_id, null or empty text, texts of fewer words: nothing found, kept as they are
  repeated rows (equal doc_id and text): one document, no duplicate of themselves
  equal doc_id, other text: documents of their own, told apart by a hash of the text
  ties: doc_id, then position, then the text's hash decide which occurrence is the original
  repeats within one document count; long texts are read whole
  empty table: no rows; extra columns: ignored, passed through by ``remove_duplicates``
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, Filter, Packer, cut, exchange, partitions, table
from .ngram_join import _groups
from .suffix_array import suffix_array
from .textbatch import Words, gram_positions, grams, mix, order_by_hash, ranges, runs, slices, words

#: Words of a passage, and of an anchor.
LEAST, ANCHOR = 50, 16
#: Words that are suffix-sorted at once; groups with more are split by window.
SORT_WORDS = 200_000
_OCCURRENCE = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("windows", "<u2")])
_OCC_SCHEMA = "anchor bigint, content bigint, doc bigint, text bigint, start bigint, windows int, first boolean, sort boolean"


def _text_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's words, in order."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        within = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        out[some] = np.add.reduceat(mix(h ^ mix(within.astype(np.uint64))), first[some])
    return mix(out) & np.uint64(0x7FFFFFFF)


def _anchors(w: Words, h: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor occurrence: its hash, its segment's hash, row, first word, number of windows."""
    window = gram_positions(w.first, least)
    if not len(window):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    gram = grams(h, anchor)
    # the least gram of each window, by doubling; the leftmost one of equals
    span = least - anchor + 1
    low, where, width = gram, np.arange(len(gram)), 1
    while width * 2 <= span:
        a, b = low[:-width], low[width:]
        right = b < a
        low, where, width = np.where(right, b, a), np.where(right, where[width:], where[:-width]), width * 2
    if width < span:
        shift = span - width
        a, b = low[:-shift], low[shift:]
        right = b < a
        low, where = np.where(right, b, a), np.where(right, where[shift:], where[:-shift])
    place = where[window]
    row = np.searchsorted(w.first, window, side="right") - 1
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    start = window[begin]
    # hash of the segment's words from differences of a running sum of position-weighted hashes
    length = count + least - 1
    at = ranges(start, length)
    within = np.arange(len(at)) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
    content = mix(np.add.reduceat(mix(h[at] ^ mix(within.astype(np.uint64))), np.concatenate(([0], np.cumsum(length)[:-1]))) + length.astype(np.uint64))
    return gram[place[begin]], content, row[begin], start - w.first[row[begin]], count


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")


def _occurrences(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """Segments whose anchor occurs more than once; ``first``: the least of its content, ``sort``: its group has several contents."""
    buckets = partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_OCCURRENCE, buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1))
                h = w.hashes()
                key, content, row, start, count = _anchors(w, h, least, anchor)
                record = np.empty(len(key), dtype=_OCCURRENCE)
                record["anchor"], record["content"], record["start"], record["windows"] = key, content, start, count
                record["doc"], record["text"] = np.asarray(part.column(0))[row], _text_hash(h, w.first)[row]
                yield from packer.add(mix(key), record)
        yield from packer.flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            parts += [np.frombuffer(b, dtype=_OCCURRENCE) for b in batch.column(1).to_pylist()]
        if not parts:
            return
        record = np.concatenate(parts)
        parts.clear()
        order = order_by_hash(record["anchor"])
        bounds = runs(record["anchor"][order])
        many = np.diff(bounds) > 1
        record = record[order[ranges(bounds[:-1][many], np.diff(bounds)[many])]]
        order = np.lexsort((record["text"], record["start"], record["doc"], record["content"], record["anchor"]))
        record = record[order]
        same = np.zeros(len(record), dtype=bool)
        same[1:] = record[1:] == record[:-1]  # repeated rows
        record = record[~same]
        bounds = runs(record["anchor"])
        group_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        first = np.ones(len(record), dtype=bool)
        first[1:] = (record["anchor"][1:] != record["anchor"][:-1]) | (record["content"][1:] != record["content"][:-1])
        contents = np.bincount(group_of, weights=first, minlength=len(bounds) - 1)[group_of] if len(record) else np.zeros(0)
        keep = np.diff(bounds)[group_of] > 1 if len(record) else np.zeros(0, bool)
        record, first, sort = record[keep], first[keep], (contents > 1)[keep]
        for k in range(0, len(record), 1 << 15):
            p = slice(k, k + (1 << 15))
            columns = [record["anchor"][p].view(np.int64), record["content"][p].view(np.int64), record["doc"][p], record["text"][p].astype(np.int64), record["start"][p].astype(np.int64), record["windows"][p].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(first[p]), pa.array(sort[p])], names=["anchor", "content", "doc", "text", "start", "windows", "first", "sort"])

    return cut(exchange(docs, emit, buckets).mapInArrow(group, _OCC_SCHEMA))


def _hot_anchors(occurrences: DataFrame, least: int, most: int) -> DataFrame:
    """Anchors whose distinct segments have more than ``most`` words."""
    size = occurrences.where("first and sort").groupBy("anchor").agg(F.sum(F.col("windows") + (least - 1)).alias("words"))
    return size.where(F.col("words") > most).select("anchor")


def _segments(docs: DataFrame, occurrences: DataFrame, hot: Broadcast, least: int) -> DataFrame:
    """The words, as hashes, of the first occurrence of each content that must be sorted.

    Of the anchors in ``hot`` they are the hashes of whole windows instead (``split``).  What the
    filter lets through besides is split without need, and with the same result.
    """
    wanted = occurrences.where("first and sort").groupBy("doc").agg(F.collect_list(F.struct("text", "start", "windows", "anchor", "content")).alias("wanted"))
    held = docs.sparkSession.sparkContext.broadcast(Filter(occurrences.where("first and sort").select("doc").distinct()))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.passes(np.asarray(batch.column(0)))))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1))
                h = w.hashes()
                own = _text_hash(h, w.first)
                lists = part.column(2)
                values = lists.flatten()
                size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), size)
                text, start, windows, anchor, content = [np.asarray(c) for c in values.flatten()]
                mine = np.flatnonzero(own[row].astype(np.int64) == text)
                if not len(mine):
                    continue
                at = w.first[row[mine]] + start[mine]
                split = hot.value.passes(anchor[mine])
                whole = grams(h, least) if split.any() else h
                bodies = [whole[a : a + n].tobytes() if s else h[a : a + n + least - 1].tobytes() for s, a, n in zip(split, at, windows[mine], strict=True)]
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[mine]), pa.array(content[mine]), part.column(0).take(pa.array(row[mine])), pa.array(start[mine]), pa.array(text[mine]), pa.array(bodies, pa.binary()), pa.array(split)],
                    names=["anchor", "content", "doc", "start", "text", "words", "split"],
                )

    narrowed = docs.mapInArrow(narrow, docs.schema)
    joined = narrowed.join(wanted, narrowed["doc_id"] == wanted["doc"]).select("doc_id", narrowed["text"], "wanted")
    return joined.mapInArrow(take, "anchor bigint, content bigint, doc bigint, start bigint, text bigint, words binary, split boolean").dropDuplicates(["anchor", "content"])


def _sorted_flags(segments: DataFrame, least: int) -> DataFrame:
    """Per segment a byte a window: 1 if another segment has it too, 3 if also an earlier one is the original."""

    def classes(rows: list[tuple]) -> pa.RecordBatch:
        body = [np.frombuffer(r[5], dtype=np.uint64) for r in rows]
        length = np.array([len(b) for b in body])
        value, symbol = np.unique(np.concatenate(body), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
        text = np.zeros(int((length + 1).sum()), dtype=np.int64)  # 0 ends a segment
        at = ranges(begin, length)
        text[at] = symbol + 1
        segment = np.repeat(np.arange(len(rows)), length + 1)
        within = np.arange(len(text)) - begin[segment]
        valid = within <= (length - least)[segment]
        order = suffix_array(text)
        order = order[valid[order]]
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for k in range(least):
            same &= text[order[1:] + k] == text[order[:-1] + k]
        kind = np.concatenate(([0], np.cumsum(~same)))
        doc, start, hashed = (np.array([r[c] for r in rows]) for c in (2, 3, 4))
        s = segment[order]
        best = np.lexsort((hashed[s], start[s] + within[order], doc[s], kind))
        flags = np.zeros(len(text), dtype=np.uint8)
        size = np.bincount(kind)
        original = np.zeros(len(order), dtype=bool)
        original[best[np.concatenate(([True], kind[best][1:] != kind[best][:-1]))]] = True
        flags[order] = np.where(size[kind] > 1, np.where(original, 1, 3), 0)
        out = [flags[b : b + n].tobytes() for b, n in zip(begin, length - least + 1, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(out, pa.binary())], names=["anchor", "content", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for group in _groups(batches, 1):
            part = list(zip(*[c.to_pylist() for c in group.columns], strict=True))
            rows += part
            held += sum(len(r[5]) // 8 for r in part)
            if held > SORT_WORDS:
                yield classes(rows)
                rows, held = [], 0
        if rows:
            yield classes(rows)

    ordered = segments.select("anchor", "content", "doc", "start", "text", "words").repartition(partitions(segments.sparkSession), "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "anchor bigint, content bigint, flags binary")


def _counted_flags(segments: DataFrame) -> DataFrame:
    """The flags of ``_sorted_flags`` for segments that are split by window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b, dtype=np.int64) for b in batch.column(5).to_pylist()]
            size = np.array([len(k) for k in keys], dtype=np.int64)
            if not size.sum():
                continue
            row = np.repeat(np.arange(len(keys)), size)
            at = ranges(np.zeros(len(keys), np.int64), size)
            anchor, content, doc, start, text = (batch.column(c).to_numpy()[row] for c in range(5))
            columns = [np.concatenate(keys), anchor, content, at, doc, start + at, text]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "anchor", "content", "at", "doc", "place", "text"])

    rows = segments.select("anchor", "content", "doc", "start", "text", "words").mapInArrow(windows, "window bigint, anchor bigint, content bigint, at bigint, doc bigint, place bigint, text bigint")
    place = F.struct("doc", "place", "text")
    shared = rows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("original")).where("n > 1").drop("n")
    # a window that many segments share makes one side of this join skewed; adaptive execution cuts it into several tasks
    flag = F.when(F.col("original").isNull(), "00").when(F.col("original") == place, "01").otherwise("03")
    flagged = rows.join(shared.hint("shuffle_merge"), "window", "left").select("anchor", "content", F.struct("at", flag.alias("flag")).alias("flag"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("flag")), lambda x: x["flag"]), "")
    return flagged.groupBy("anchor", "content").agg(F.unhex(body).alias("flags"))


def repeated_spans(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, sort_words: int = SORT_WORDS) -> DataFrame:
    """Word spans that repeat: doc_id, text_hash, start_word, n_words, duplicate (false for originals).

    ``sort_words`` bounds the words of a group that is sorted in one task; the result doesn't depend on it.
    """
    docs = _ids(docs)
    found = _occurrences(docs, least, anchor)
    hot = Filter(_hot_anchors(found, least, sort_words))
    segments = _segments(docs, found, docs.sparkSession.sparkContext.broadcast(hot), least)
    if hot.keys:
        segments = cut(segments)
        flags = _sorted_flags(segments.where("not split"), least).unionByName(_counted_flags(segments.where("split")))
    else:
        flags = _sorted_flags(segments, least)
    copies = found.where("sort and not first").select("anchor", "content").distinct().withColumn("copied", F.lit(True))
    rows = found.join(flags, ["anchor", "content"], "left").join(copies, ["anchor", "content"], "left")
    # without sorting, every segment of the group is a copy of every other
    copied = F.when(F.col("sort"), F.coalesce("copied", F.lit(False))).otherwise(F.lit(True))
    rows = rows.select("doc", "text", "start", "windows", F.col("first"), copied.alias("copied"), "flags")
    rows = rows.repartition(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc", "text", "start")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batches are sorted; what belongs to the last (doc, text) of a batch waits for the next one
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            doc, text = rows.column("doc").to_numpy(), rows.column("text").to_numpy()
            open_ = int(np.flatnonzero((doc == doc[-1]) & (text == text[-1]))[0]) if len(doc) else 0
            if open_:
                yield from merge(rows.slice(0, open_))
            rest = rows.slice(open_)
        if rest is not None and rest.num_rows:
            yield from merge(rest)

    def merge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, text, start, windows = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "text", "start", "windows"))
        first, copied = rows.column("first").to_numpy(), rows.column("copied").to_numpy()
        position = ranges(start, windows)
        row = np.repeat(np.arange(len(doc)), windows)
        bodies = [b if b is not None else bytes(n) for b, n in zip(rows.column("flags").to_pylist(), windows, strict=True)]
        flag = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        repeated = copied[row] | (flag > 0)
        duplicate = ~first[row] | (flag == 3)
        keep = repeated
        position, row, duplicate = position[keep], row[keep], duplicate[keep]
        if not len(position):
            return
        unit = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))))
        out = []
        for u, lo, hi in zip(*_unit_bounds(unit[row]), strict=True):
            place, dup = position[lo:hi], duplicate[lo:hi]
            base, width = place.min(), place.max() - place.min() + least
            cover = np.zeros((2, width + 1), dtype=np.int64)
            for k, chosen in ((0, place), (1, place[dup])):
                np.add.at(cover[k], chosen - base, 1)
                np.add.at(cover[k], chosen - base + least, -1)
            state = (np.cumsum(cover, axis=1)[:, :-1] > 0).sum(axis=0)
            edge = np.concatenate(([0], np.flatnonzero(np.diff(state)) + 1, [width]))
            kind = state[edge[:-1]]
            some = kind > 0
            r = row[lo]
            out.append(pd.DataFrame({"doc_id": doc[r], "text_hash": text[r], "start_word": edge[:-1][some] + base, "n_words": np.diff(edge)[some], "duplicate": kind[some] == 2}))
        yield pa.RecordBatch.from_pandas(pd.concat(out), schema=pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("duplicate", pa.bool_())]), preserve_index=False)

    return rows.mapInArrow(spans, "doc_id bigint, text_hash bigint, start_word bigint, n_words bigint, duplicate boolean")


def _unit_bounds(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = runs(unit)
    return unit[bounds[:-1]], bounds[:-1], bounds[1:]


def remove_duplicates(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """docs with duplicate passages cut out of the text, each with the white space after it.

    ``n_chars``, if there, is the new length.  Rows of which nothing but white space is left go.
    """
    gone = repeated_spans(docs, least, anchor).where("duplicate").groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "start_word", "n_words")).alias("__spans")).withColumnRenamed("doc_id", "__doc")
    joined = docs.join(gone, docs["doc_id"].cast("bigint") == gone["__doc"], "left").drop(gone["__doc"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part in slices(batch, "text"):
                spans = part.column(part.num_columns - 1).to_pylist()
                some = [r for r, s in enumerate(spans) if s]
                text = part.column(at)
                out = part.select(list(range(len(names))))
                if some:
                    subset = text.take(pa.array(some))
                    w = words(subset)
                    own = _text_hash(w.hashes(), w.first)
                    new = text.to_pylist()
                    for k, r in enumerate(some):
                        keep = np.ones(int(w.offsets[k + 1] - w.offsets[k]), dtype=bool)
                        lo, hi = w.first[k], w.first[k + 1]
                        edges = np.append(w.start[lo:hi], w.offsets[k + 1]) - w.offsets[k]
                        for s in spans[r]:
                            if s["text_hash"] == own[k]:
                                keep[edges[s["start_word"]] : edges[s["start_word"] + s["n_words"]]] = False
                        data = w.data[w.offsets[k] : w.offsets[k + 1]][keep]
                        new[r] = data.tobytes().decode("utf-8")
                    out = out.set_column(at, names[at], pa.array(new, text.type))
                    if "n_chars" in names:
                        k = names.index("n_chars")
                        length = out.column(k).to_pylist()
                        for r in some:
                            length[r] = len(new[r])
                        out = out.set_column(k, "n_chars", pa.array(length, out.column(k).type))
                    chosen = set(some)
                    out = out.filter(pa.array([r not in chosen or bool(new[r].strip()) for r in range(len(new))]))
                yield out

    return joined.mapInArrow(run, docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), rep AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS dup, count(*) OVER (PARTITION BY h) AS k FROM win
), word AS (
  SELECT doc_id, i + j - 1 AS p, bool_or(dup) AS dup
  FROM (SELECT * FROM rep WHERE k > 1), (SELECT unnest(range(0, 50)) AS j) GROUP BY 1, 2
), mark AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, dup ORDER BY p) AS island FROM word
)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, count(*) AS n_words, dup AS duplicate
FROM mark GROUP BY doc_id, dup, island
"""
