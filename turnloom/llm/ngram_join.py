"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets.

Jaccard distance is a metric.  The join works in pivot regions of that space:

0. Texts are cut into words once.  n-grams go to tasks by hash, which count the documents of each;
   back to a document come those that another one has too, with their rarity.  A document can have
   a partner only if ``ceil(t * size)`` of its n-grams came back; the others are settled by that.
   Equal sets are one set from here on.
1. A set takes part in the regions of its rarest n-grams: as many as a pair at or above the
   threshold must share one of (``size - ceil(t * size) + 1``).
2. The sets of an n-gram are tied to one of them, its pivot.  Regions with the same pivot are one,
   so a group of near copies meets in few regions, whatever n-grams it shares.  A pair that meets
   in several regions belongs to the least of their pivots.
3. Within a region pivots far from each other make Voronoi cells of a radius r of at most t/2, which
   are divided again until they are small.  By the triangle inequality a set can have a partner
   in a cell only if its distance to the cell's pivot lies within 1-t of those of the cell's own
   sets; such sets are replicated to the cell, and no other pair is compared.  As r + 1-t is below
   one, sets that share little with the pivot never enter the cell.
4. A region of more than ``REGION_ROWS`` sets is held in parts by several tasks; the sets of later
   parts stream past the cells of each part under the same bounds.

The result has one row a document: its class (the least id of all that similar documents connect
it with) and its links (how many documents it is similar to).  Copies are never expanded to pairs:
a region hands on one row a set, with the sum of its links and the set it is connected with.

Defined results
  null doc_id: no row; the filter keeps it
  null or empty text, or white space only: no n-grams; a class of its own, no links
  fewer words than n: the whole text is the one n-gram
  repeated rows: the same id and n-grams are one document; one id with several texts is a document
    for each; in the filter the rows of an id stay or go together
  ties (equal sets): links at distance 0
  empty table: no rows; extra columns: ignored here, passed through by the filter
  very long texts: whole sets, never prefixes or samples
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, Packer, cut, partitions, table, unpack
from .textbatch import Words, gram_positions, grams, mix, order_by_hash, ranges, runs, slices, words

N, THRESHOLD = 5, 0.5
#: Sets that a task holds of a region, the size up to which cells aren't divided, and pivots a division.
REGION_ROWS, CELL_ROWS, PIVOTS = 4096, 512, 8
_SIG = np.dtype([("gram", "<u8"), ("set", "<u8")])
_INFO = np.dtype([("doc", "<i8"), ("set", "<u8"), ("size", "<u4")])
#: n-grams of a batch of documents, roughly.
BATCH_GRAMS = 1 << 20
_LOW = np.uint64((1 << 40) - 1)


def _sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all rows, row after row, and the bounds of each row's."""
    h = w.hashes()
    counts = w.counts()
    position = gram_positions(w.first, n)
    row = np.searchsorted(w.first, position, side="right") - 1
    value = grams(h, n)[position] if len(position) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([grams(h[w.first[r] : w.first[r + 1]], int(counts[r]))[0] for r in short], dtype=np.uint64)
        row, value = np.concatenate((row, short)), np.concatenate((value, whole))
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    bounds = np.searchsorted(row, np.arange(w.rows + 1))
    out, size = [], np.zeros(w.rows, dtype=np.int64)
    for r in np.flatnonzero(np.diff(bounds)):
        part = np.unique(value[bounds[r] : bounds[r + 1]])
        size[r] = len(part)
        out.append(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))


def _set_hash(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each row's set; 0 for an empty one."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), bounds[some]) + np.diff(bounds)[some].astype(np.uint64)) | np.uint64(1)
    return out


def _least_shared(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null")


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The (bucket, kind, body) of each batch of documents, from rows sorted by batch."""
    name, held = None, []
    for got in batches:
        for bucket, batch, kind, body in zip(*[c.to_pylist() for c in got.columns], strict=True):
            if held and batch != name:
                yield name, held
                held = []
            name = batch
            held.append((bucket, kind, body))
    if held:
        yield name, held


def candidate_sets(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, set, size, take and grams of each document; grams is null where it can have no partner.

    grams are the n-grams that other documents have too, the rarest first, of which the first
    ``take`` tie the set to regions.  n-grams travel in batches of documents, 7 bytes each: 40 bits of
    hash besides those that choose the task, and the document's place in its batch.  One that a batch
    holds often (a passage of many copies) travels once with its count, and waits at the batch.
    """
    buckets = min(partitions(docs.sparkSession), 1 << 16)
    schema = "bucket int, batch bigint, kind int, body binary"
    often = 64

    def rows(bucket: list[int], batch: int, kind: int, body: list[bytes]) -> pa.RecordBatch:
        k = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([batch] * k, pa.int64()), pa.array([kind] * k, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "batch", "kind", "body"])

    def send(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, which, size, value = (np.concatenate([p[k] for p in parts]) for k in range(4))
        batch = int(mix(np.array([np.bitwise_xor.reduce(mix(which + np.arange(len(doc), dtype=np.uint64) + mix(doc.view(np.uint64))))], dtype=np.uint64)).view(np.int64)[0])
        info = np.empty(len(doc), dtype=_INFO)
        info["doc"], info["set"], info["size"] = doc, which, size
        home = abs(batch) % buckets
        yield rows([home], batch, 0, [info.tobytes()])
        place = np.repeat(np.arange(len(doc), dtype=np.uint16), size)
        # values that this batch holds often: a small table of counts finds what may be one
        slot = (value & np.uint64(0xFFFFF)).astype(np.int64)
        maybe = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= often)
        if len(maybe):
            found, where, count = np.unique(value[maybe], return_inverse=True, return_counts=True)
            hot = maybe[count[where] >= often]
            if len(hot):
                found, count = found[count >= often], count[count >= often]
                bucket = ((found >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    yield rows([b], batch, 2, [(found[mine] & _LOW).tobytes() + count[mine].astype(np.uint32).tobytes()])
                full = (value[hot] & _LOW) | ((value[hot] >> np.uint64(48)) % np.uint64(buckets)) << np.uint64(40)
                yield rows([home], batch, 3, [full.tobytes() + place[hot].tobytes()])
                rest = np.ones(len(value), bool)
                rest[hot] = False
                value, place = value[rest], place[rest]
        bucket = ((value >> np.uint64(48)) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        value, place = value[order], place[order]
        low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint8)
        some = np.flatnonzero(np.diff(bounds)).tolist()
        for k in range(0, len(some), 64):
            yield rows(some[k : k + 64], batch, 1, [b"".join(x[bounds[b] : bounds[b + 1]].tobytes() for x in (low, high, place)) for b in some[k : k + 64]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, grams_held, docs_held = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = _sets(words(part.column(1)), n)
                for lo in range(0, part.num_rows, 1 << 14):
                    hi = min(part.num_rows, lo + (1 << 14))
                    if parts and docs_held + hi - lo > 1 << 16:
                        yield from send(parts)
                        parts, grams_held, docs_held = [], 0, 0
                    b = bounds[lo : hi + 1]
                    parts.append((np.asarray(part.column(0))[lo:hi], _set_hash(value, b), np.diff(b), value[b[0] : b[-1]]))
                    grams_held, docs_held = grams_held + int(b[-1] - b[0]), docs_held + hi - lo
                if grams_held > BATCH_GRAMS:
                    yield from send(parts)
                    parts, grams_held, docs_held = [], 0, 0
        if parts:
            yield from send(parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, places, weights = [], [], [], []
        task = TaskContext.get().partitionId()
        for got in batches:
            for batch, kind, body in zip(got.column(1).to_pylist(), got.column(2).to_pylist(), got.column(3).to_pylist(), strict=True):
                if kind in (0, 3):
                    yield rows([0], batch, kind, [body])
                    continue
                names.append((batch, kind))
                if kind == 1:
                    k = len(body) // 7
                    values.append(np.frombuffer(body, np.uint32, k).astype(np.uint64) | (np.frombuffer(body, np.uint8, k, 4 * k).astype(np.uint64) << np.uint64(32)))
                    places.append(np.frombuffer(body, np.uint16, k, 5 * k))
                    weights.append(np.ones(k, np.uint32))
                else:
                    k = len(body) // 12
                    values.append(np.frombuffer(body, np.uint64, k))
                    places.append(np.zeros(k, np.uint16))
                    weights.append(np.frombuffer(body, np.uint32, k, 8 * k))
        if not names:
            return
        value = np.concatenate(values)
        order = order_by_hash(value << np.uint64(24))
        bounds = runs(value[order])
        count = np.add.reduceat(np.concatenate(weights)[order], bounds[:-1], dtype=np.int64)
        # eight steps of rarity a doubling
        rarity = np.empty(len(value), dtype=np.uint8)
        rarity[order] = np.repeat(np.minimum(255, np.round(8 * np.log2(count))).astype(np.uint8), np.diff(bounds))
        at = 0
        for (batch, kind), v, place in zip(names, values, places, strict=True):
            r = rarity[at : at + len(v)]
            at += len(v)
            if kind == 2:
                yield rows([task], batch, 2, [v.tobytes() + r.tobytes()])
            elif (shared := r > 0).any():
                v = v[shared]
                yield rows([task], batch, 1, [v.astype(np.uint32).tobytes() + (v >> np.uint64(32)).astype(np.uint8).tobytes() + place[shared].tobytes() + r[shared].tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, items in _by_batch(batches):
            info, often_value, often_rarity, waiting = None, [], [], []
            value, place, rarity = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
            for bucket, kind, body in items:
                # the whole hash, with the bits that chose the task
                task = np.uint64(bucket) << np.uint64(40)
                if kind == 0:
                    info = np.frombuffer(body, _INFO)
                elif kind == 1:
                    k = len(body) // 8
                    value.append(np.frombuffer(body, np.uint32, k).astype(np.uint64) | (np.frombuffer(body, np.uint8, k, 4 * k).astype(np.uint64) << np.uint64(32)) | task)
                    place.append(np.frombuffer(body, np.uint16, k, 5 * k))
                    rarity.append(np.frombuffer(body, np.uint8, k, 7 * k))
                elif kind == 2:
                    k = len(body) // 9
                    often_value.append(np.frombuffer(body, np.uint64, k) | task)
                    often_rarity.append(np.frombuffer(body, np.uint8, k, 8 * k))
                else:
                    waiting.append(body)
            if waiting:
                known, first = np.unique(np.concatenate(often_value), return_index=True)
                rare = np.concatenate(often_rarity)[first]
                for body in waiting:
                    k = len(body) // 10
                    v = np.frombuffer(body, np.uint64, k)
                    value.append(v)
                    place.append(np.frombuffer(body, np.uint16, k, 8 * k))
                    rarity.append(rare[np.searchsorted(known, v)])
            value, place, rarity = np.concatenate(value), np.concatenate(place), np.concatenate(rarity)
            order = np.lexsort((value, rarity, place))
            value, place = value[order], place[order]
            bounds = np.searchsorted(place, np.arange(len(info) + 1))
            size, shared = info["size"].astype(np.int64), np.diff(bounds)
            least = _least_shared(size, threshold)
            take = np.maximum(0, size - least + 1 - (size - shared))
            able = (size > 0) & (shared >= least)
            for lo in range(0, len(info), 2048):
                hi = min(len(info), lo + 2048)
                bodies = [value[bounds[r] : bounds[r + 1]].tobytes() if able[r] else None for r in range(lo, hi)]
                columns = (info["doc"], info["set"].view(np.int64), size, take)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c[lo:hi])) for c in columns], pa.array(bodies, pa.binary())], names=["doc_id", "set", "size", "take", "grams"])

    sent = _ids(docs).mapInArrow(emit, schema).repartitionById(buckets, F.col("bucket")).mapInArrow(meet, schema)
    back = sent.repartition(buckets, "batch").sortWithinPartitions("batch")
    return cut(back.mapInArrow(add, "doc_id bigint, set bigint, size bigint, take bigint, grams binary"))


def _ties(sets: DataFrame) -> DataFrame:
    """(set, pivot): the set takes part in the pivot's region; pivots in their own.  Copies give the same rows."""
    buckets = partitions(sets.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_SIG, buckets)
        for batch in batches:
            for one, take, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                record = np.empty(take, dtype=_SIG)
                record["gram"] = np.frombuffer(body, np.uint64, take)
                record["set"] = np.int64(one).view(np.uint64)
                yield from packer.add(mix(record["gram"]), record)
        yield from packer.flush()

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = unpack(batches, _SIG)
        gram, sets = record["gram"], record["set"].view(np.int64)
        order = np.lexsort((sets, gram))
        gram, sets = gram[order], sets[order]
        once = np.ones(len(gram), bool)  # copies hold an n-gram once
        once[1:] = (gram[1:] != gram[:-1]) | (sets[1:] != sets[:-1])
        gram, sets = gram[once], sets[once]
        bounds = runs(gram)
        size = np.diff(bounds)
        run = ranges(bounds[:-1][size > 1], size[size > 1])
        pivot = np.repeat(sets[bounds[:-1][size > 1]], size[size > 1])
        sets = sets[run]
        links = np.unique(np.stack((sets, pivot), axis=1), axis=0) if len(run) else np.zeros((0, 2), np.int64)
        for k in range(0, len(links), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[k : k + (1 << 16), c])) for c in (0, 1)], names=["set", "pivot"])

    blocks = sets.select("set", "take", "grams").mapInArrow(emit, BLOCK).repartitionById(buckets, F.col("bucket"))
    return blocks.mapInArrow(tie, "set bigint, pivot bigint").distinct()


class _Bags:
    """Lists of numbers a row, and how many numbers two rows share, as products of dense blocks."""

    def __init__(self, lists: list[np.ndarray], strangers: bool) -> None:
        """strangers: rows from outside will be compared too, so that numbers of a single row stay."""
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        value = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(lists)), self.size)
        self.known, column, count = np.unique(value, return_inverse=True, return_counts=True)
        if not strangers and len(value):
            keep = count > 1
            number = np.cumsum(keep) - 1
            owner, column = owner[keep[column]], number[column[keep[column]]]
            self.known = self.known[keep]
        self.column = column
        self.first = np.searchsorted(owner, np.arange(len(lists) + 1))

    def entries(self, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        count = self.first[rows + 1] - self.first[rows]
        return self._sorted(len(rows), np.repeat(np.arange(len(rows)), count), self.column[ranges(self.first[rows], count)])

    def outside(self, lists: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        value = np.concatenate(lists)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        if not len(self.known):
            return self._sorted(len(lists), row[:0], row[:0])
        column = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
        some = self.known[column] == value
        return self._sorted(len(lists), row[some], column[some])

    @staticmethod
    def _sorted(rows: int, row: np.ndarray, column: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        order = np.argsort(column, kind="stable")
        return rows, row[order], column[order]

    def common(self, a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
        """How many numbers each row of a shares with each of b."""
        out = np.zeros((a[0], b[0]), dtype=np.float32)
        if not len(a[1]) or not len(b[1]):
            return out
        # only columns that both have
        in_b = np.zeros(len(self.known), bool)
        in_b[b[2]] = True
        both = np.unique(a[2][in_b[a[2]]])
        number = np.full(len(self.known), -1)
        number[both] = np.arange(len(both))
        step = max(64, (16 << 20) // (a[0] + b[0]) // 4)
        pair = []
        for rows, row, column in (a, b):
            column = number[column]
            keep = column >= 0
            pair.append((rows, row[keep], column[keep]))
        for lo in range(0, len(both), step):
            width = min(step, len(both) - lo)
            dense = []
            for rows, row, column in pair:
                p, q = np.searchsorted(column, (lo, lo + width))
                x = np.zeros((rows, width), dtype=np.float32)
                x[row[p:q], column[p:q] - lo] = 1
                dense.append(x)
            out += dense[0] @ dense[1].T
        return out


def _union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Connect x[i] with y[i]; label is the least row that each row is connected with."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


class Region:
    """Sets of a region in Voronoi cells, their links, and the sets that they are connected with."""

    def __init__(self, grams_: list[np.ndarray], size: np.ndarray, weight: np.ndarray, smaller: list[np.ndarray], threshold: float, strangers: bool = False) -> None:
        """smaller: the pivots, less than this region's, in whose regions a set takes part too."""
        self.bags, self.others = _Bags(grams_, strangers), _Bags(smaller, strangers)
        self.size, self.weight, self.threshold, self.eps = size, weight, threshold, 1 - threshold
        self.links = np.zeros(len(size), dtype=np.int64)
        self.label = np.arange(len(size))
        self.tried = 0
        self.cells = self._cells()

    def _distance(self, a: tuple, size_a: np.ndarray, b: tuple, size_b: np.ndarray) -> np.ndarray:
        shared = self.bags.common(a, b).astype(float)
        return 1 - shared / np.maximum(size_a[:, None] + size_b[None, :] - shared, 1)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._distance(self.bags.entries(a), self.size[a], self.bags.entries(b), self.size[b])

    def _cells(self) -> list[tuple[int, float, float, np.ndarray]]:
        """(pivot, least and greatest distance to it, rows); every row is in one cell."""
        out: list[tuple[int, float, float, np.ndarray]] = []
        todo = [np.arange(len(self.size))]
        reach = self.threshold / 2

        def close(rows: np.ndarray, pivot: int) -> None:
            for k in range(0, len(rows), CELL_ROWS):
                part = rows[k : k + CELL_ROWS]
                if len(self.size) <= CELL_ROWS:
                    out.append((pivot, 0.0, 1.0, part))  # the only cell
                    continue
                d = self.distance(part, np.array([pivot]))[:, 0]
                out.append((pivot, float(d.min()), float(d.max()), part))

        while todo:
            rows = todo.pop()
            if len(rows) <= CELL_ROWS:
                close(rows, int(rows[0]))
                continue
            pivots = [int(rows[0])]
            d = self.distance(rows, np.array(pivots))
            while len(pivots) < PIVOTS and d.min(axis=1).max() > 0:
                pivots.append(int(rows[int(d.min(axis=1).argmax())]))
                d = np.concatenate((d, self.distance(rows, np.array(pivots[-1:]))), axis=1)
            home = np.where(d.min(axis=1) <= reach, d.argmin(axis=1), -1)
            for k in range(-1, len(pivots)):
                part = rows[home == k]
                if not len(part):
                    continue
                if len(part) > 0.9 * len(rows):
                    # it doesn't divide; the order of distance at least keeps cells narrow
                    near = d.min(axis=1)[home == k] if k < 0 else d[home == k, k]
                    part = part[np.argsort(near, kind="stable")]
                    for c in range(0, len(part), CELL_ROWS):
                        some = part[c : c + CELL_ROWS]
                        close(some, int(some[0]) if k < 0 else pivots[k])
                else:
                    todo.append(part)
        return out

    def _window(self, d: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.flatnonzero((d >= low - self.eps - 1e-6) & (d <= high + self.eps + 1e-6))

    def _similar(self, a: tuple, size_a: np.ndarray, other_a: tuple, b: tuple, size_b: np.ndarray, other_b: tuple) -> np.ndarray:
        """Which pairs are similar and belong to this region."""
        self.tried += a[0] * b[0]
        shared = self.bags.common(a, b).astype(float)
        near = shared >= (self.threshold - 1e-9) * (size_a[:, None] + size_b[None, :] - shared)
        if near.any():
            near &= self.others.common(other_a, other_b) == 0
        return near

    def _meet(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        near = self._similar(self.bags.entries(a), self.size[a], self.others.entries(a), self.bags.entries(b), self.size[b], self.others.entries(b))
        if same:
            near[np.arange(len(a)), np.arange(len(a))] = False
        self.links[a] += near @ self.weight[b]
        if not same:
            self.links[b] += near.T @ self.weight[a]
        x, y = np.nonzero(near)
        _union(self.label, a[x], b[y])

    def join(self) -> None:
        """All pairs of the region's own rows."""
        pivots = np.array([c[0] for c in self.cells])
        d = self.distance(np.arange(len(self.size)), pivots) if len(self.cells) > 1 else None
        for i, (_, low, high, rows) in enumerate(self.cells):
            self._meet(rows, rows, True)
            if len(later := [c[3] for c in self.cells[i + 1 :]]):
                other = np.concatenate(later)
                other = other[self._window(d[other, i], low, high)]
                for k in range(0, len(other), CELL_ROWS):
                    self._meet(rows, other[k : k + CELL_ROWS], False)

    def pass_by(self, grams_: list[np.ndarray], size: np.ndarray, weight: np.ndarray, smaller: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links of rows from outside with the region's own, and one of these for each (-1: none)."""
        all_, others = self.bags.outside(grams_), self.others.outside(smaller)
        pivots = np.array([c[0] for c in self.cells])
        d = self._distance(all_, size, self.bags.entries(pivots), self.size[pivots])
        links, first = np.zeros(len(size), dtype=np.int64), np.full(len(size), -1)

        def part(e: tuple, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            number = np.full(e[0], -1)
            number[rows] = np.arange(len(rows))
            keep = number[e[1]] >= 0
            return len(rows), number[e[1][keep]], e[2][keep]

        for i, (_, low, high, rows) in enumerate(self.cells):
            some = self._window(d[:, i], low, high)
            if not len(some):
                continue
            near = self._similar(self.bags.entries(rows), self.size[rows], self.others.entries(rows), part(all_, some), size[some], part(others, some))
            self.links[rows] += near @ weight[some]
            links[some] += near.T @ self.weight[rows]
            x, y = np.nonzero(near.T)
            at = some[x]
            lead = np.flatnonzero(np.diff(at, prepend=-1))
            fresh = lead[first[at[lead]] < 0]
            first[at[fresh]] = rows[y[fresh]]
            _union(self.label, first[at], rows[y])
        return links, first


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(k)) for k in range(keys)], axis=1)
        bounds = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and tuple(key[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _region_links(members: DataFrame, threshold: float) -> DataFrame:
    """set, root and links, from rows pivot, part, away, parts, set, weight, size, smaller, grams.

    Rows of a part come before those that only pass by (``away``), which are never held.
    """
    columns = ["set", "root", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, region, sets, passed = None, [], None, np.zeros(0, np.int64), []

        def lists(rows: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
            if name == "grams":
                return [np.frombuffer(x, np.uint64).view(np.int64) for x in rows.column(name).to_pylist()]
            return [np.array(x, np.int64) for x in rows.column(name).to_pylist()]

        def numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
            return rows.column(name).to_numpy()

        def start() -> None:
            nonlocal region, sets, held
            rows = pa.Table.from_batches(held).sort_by("set")
            held = []
            sets = numbers(rows, "set")
            if len(sets) > 1 or numbers(rows, "parts")[0] > 1:
                region = Region(lists(rows, "grams"), numbers(rows, "size"), numbers(rows, "weight"), lists(rows, "smaller"), threshold, bool(numbers(rows, "parts")[0] > 1))
                region.join()

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal region, passed
            if held:
                start()
            if region is not None:
                some = np.flatnonzero(region.links)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[some], sets[region.label[some]], region.links[some])], names=columns)
                for own, first, links in passed:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, sets[region.label[first]], links)], names=columns)
            region, passed = None, []

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1)
            bounds = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1), [True])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if tuple(k[a, :2]) != key:
                    yield from end()
                    key = tuple(k[a, :2])
                if not k[a, 2]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    start()
                if region is None:
                    continue  # a part without rows of its own
                for lo in range(a, b, CELL_ROWS):
                    rows = batch.slice(lo, min(CELL_ROWS, b - lo))
                    links, first = region.pass_by(lists(rows, "grams"), numbers(rows, "size"), numbers(rows, "weight"), lists(rows, "smaller"))
                    if (hit := np.flatnonzero(first >= 0)).size:
                        passed.append((numbers(rows, "set")[hit], first[hit], links[hit]))
        yield from end()

    return members.mapInArrow(run, "set bigint, root bigint, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, from edges (a, b).

    Alternating large and small stars; each round shortens all paths, so that few rounds do.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        state = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = state.groupBy("a").agg(F.min("b").alias("low"))
        small = state.join(low, "a")
        state = cut(small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b").distinct())


def _linked(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """All documents' sets, and (doc_id, class_id, links) of those that can have a partner."""
    spark = docs.sparkSession
    counted = candidate_sets(docs, threshold, n)
    able = counted.where("grams is not null")
    members = able.select("set", "doc_id").distinct()
    weight = cut(members.groupBy("set").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least")))
    body = able.groupBy("set").agg(F.min_by(F.struct("size", "grams"), "doc_id").alias("s"))
    ties = cut(_ties(able))
    parts = F.ceil(F.count("*") / REGION_ROWS).cast("int")
    regions = ties.groupBy("pivot").agg(parts.alias("parts")).where("parts > 1")
    smaller = ties.groupBy("set").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    own = F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1))).cast("int")
    # a part meets its own sets and those of later parts
    placed = (
        ties.join(F.broadcast(regions) if _few(regions) else regions, "pivot", "left")
        .select("pivot", "set", own.alias("own"), F.coalesce("parts", F.lit(1)).alias("parts"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("own"))))
        .select("pivot", "part", (F.col("part") < F.col("own")).cast("int").alias("away"), "parts", "set")
    )
    # n-grams of a set move twice: to one row a set, and from there to its regions
    rows = placed.join(smaller.join(weight, "set").join(body, "set"), "set")
    rows = rows.select("pivot", "part", "away", "parts", "set", "weight", "s.size", F.filter("pivots", lambda p: p < F.col("pivot")).alias("smaller"), "s.grams")
    rows = rows.repartition(partitions(spark), "pivot", "part").sortWithinPartitions("pivot", "part", "away")
    found = cut(_region_links(rows, threshold))
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))).toDF("set", "root")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    known = weight.join(links, "set", "left").join(roots, "set", "left")
    known = known.select("set", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "set").alias("root"))
    first = known.groupBy("root").agg(F.min("least").alias("class_id"))
    return counted, members.join(known.join(first, "root").select("set", "class_id", "links"), "set").select("doc_id", "class_id", "links")


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether the rows, of a few numbers each, may be sent to all tasks."""
    return df.limit(most + 1).count() <= most


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, class_id and links of every document."""
    counted, linked = _linked(docs, threshold, n)
    alone = counted.where("grams is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")).distinct()
    return linked.union(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of docs without all but the least document of each class, with all their columns."""
    gone = cut(_linked(docs, threshold, n)[1].where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct())
    # a million ids are 8 MB; beyond, the texts are joined by id
    gone = F.broadcast(gone) if _few(gone, 1_000_000) else gone
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
      ELSE [array_to_string(words, ' ')] END) AS gram
    FROM w WHERE len(words) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT doc_a, doc_b FROM shared JOIN size x ON x.doc_id = doc_a JOIN size y ON y.doc_id = doc_b
  WHERE k / (x.n + y.n - k) >= 0.5 - 1e-9
), reach(doc_id, other) AS (
  SELECT doc_a, doc_b FROM link
  UNION
  SELECT r.doc_id, l.doc_b FROM reach r JOIN link l ON l.doc_a = r.other
), class AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id),
links AS (SELECT doc_a AS doc_id, count(*) AS links FROM link GROUP BY doc_a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN class c USING (doc_id) LEFT JOIN links l USING (doc_id)
"""
