"""Katz backoff trigram model of a corpus, and scores of documents under it.

A document is its words between two begin marks and an end mark.  Counts are Good-Turing
discounted up to ``GT_MAX``.  The rest of a context's mass goes to the other words in proportion to
the shorter model, with the weight that makes the context's distribution sum to exactly one:

    P(w|u,v) = d3(c) c(u,v,w) / c(u,v)      if the trigram was counted, else alpha(u,v) P(w|v)
    P(w|v)   = d2(c) c(v,w) / c(v)          if the bigram was counted, else alpha(v) P(w)
    P(w)     = d1(c) c(w) / N               if the word was counted, else what is left: the mass of
                                            all unknown words, which count as one
    alpha(u,v) = (1 - sum of its P(w|u,v)) / (1 - sum of P(w|v) of the same words), alpha(v) likewise
    a context that wasn't counted has the weight one

``score`` counts one table and scores the same or another one, with all three orders in the plan:

    tokens       go to the task of their context (u, v), which counts trigrams
    bigrams      each such task asks the task of v for P(w|v) of its distinct (v, w), telling how
                 often it saw them; the sum over tasks counts the bigrams
    words        likewise each task of bigrams asks the task of w for the count of its distinct w
    back again   words' counts give P(w), alpha(v) and P(w|v), bigrams not counted being backed off;
                 these give alpha(u,v), and tokens whose trigram wasn't counted are backed off

Counts of counts ride along with the questions, so every task knows them without another pass.
Contexts of a word are spread over ``SPREAD`` tasks, so that frequent words make no task large, while
most bigrams are still asked for once.  Tokens travel once, as numbers in lists of their block's words;
sums per document travel back.  Documents that are counted themselves have all their trigrams
counted, so for them the weights are made and no token uses them.

``model`` stores the tables instead, and ``score_with`` looks up any documents in them by joins.

Defined results
  null or empty text, or white space only: 0 tokens, log_prob 0, no perplexity, not counted
  null doc_id: counted and scored, null in the result; repeated rows: each counts and is scored
    (``score_with`` gives rows that are equal in id and text once); documents that are only scored
    aren't counted, and those only counted give no row
  ties don't arise; very long texts: every word counts
  counts of counts that Good-Turing can't use (small corpora): absolute discounting, c - D with
    D = n1 / (n1 + 2 n2), or 0.5
  a context none of whose counts is discounted: its counts are divided by one more, so that mass
    is left to back off with
  empty table: no rows; extra columns: ignored
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .textbatch import mix, order_by_hash, runs, slices, words

GT_MAX = 5
#: Tokens that are sent as one block a table partition.
BATCH_TOKENS = 1 << 20
#: Tasks that share the contexts of one middle word.
SPREAD = 4
BEGIN, END = 1, 2
#: Kinds of blocks: documents, tokens by what they are for, counts of counts, and n-grams asked for or answered.
DOCS, BOTH, COUNTED, SCORED, COUNTS, GRAMS = range(6)
_BITS = np.uint64((1 << 40) - 1)
_INFO = np.dtype([("doc", "<i8"), ("known", "u1"), ("tokens", "<u4")])
_SUM = np.dtype([("place", "<u2"), ("sum", "<f8")])
_U, _W = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _hashes(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """40-bit word hashes, of which the two least values are marks, and the first word of each row."""
    w = words(part)
    return np.maximum(w.hashes() & _BITS, 3), w.first


def _home(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word) >> np.uint64(20)) % np.uint64(buckets)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, byte by byte, so that small ones compress to little."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(body: bytes, n: int, at: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, width * n, at).reshape(width, n).T
    return out.view("<u8").reshape(n)


def _five(x: np.ndarray) -> bytes:
    """Numbers of 5 bytes as differences, which are small where they are in order."""
    return _planes(np.diff(x, prepend=np.uint64(0)) & _BITS, 5)


def _numbers(body: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(_from_planes(body, n, at, 5)) & _BITS


def _runs_of(x: np.ndarray) -> bytes:
    """Numbers of 5 bytes that come in runs."""
    bounds = runs(x)
    return np.uint32(len(bounds) - 1).tobytes() + _five(x[bounds[:-1]]) + _planes(np.diff(bounds), 5)


def _from_runs(body: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and where they end."""
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    return np.repeat(_numbers(body, n, 4), _from_planes(body, n, 4 + 5 * n, 5).astype(np.int64)), 4 + 10 * n


def _pack(v: np.ndarray, u: np.ndarray, w: np.ndarray, place: np.ndarray) -> bytes:
    """Tokens by their words' numbers in a list of the block's words, frequent ones first; v in runs."""
    bounds = runs(v)
    words, number, times = np.unique(np.concatenate((v[bounds[:-1]], u, w)), return_inverse=True, return_counts=True)
    by = np.argsort(-times, kind="stable")
    rank = np.empty(len(words), np.uint64)
    rank[by] = np.arange(len(words), dtype=np.uint64)
    return np.array([len(words), len(bounds) - 1, len(v)], np.uint32).tobytes() + _five(words[by]) + _planes(np.diff(bounds), 4) + _planes(rank[number], 4) + _planes(place, 2)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """v, u, w and place."""
    some, r, n = np.frombuffer(body, np.uint32, 3).tolist()
    at = 12 + 5 * some
    line = _numbers(body, some, 12)[_from_planes(body, r + 2 * n, at + 4 * r, 4).astype(np.int64)]
    v = np.repeat(line[:r], _from_planes(body, r, at, 4).astype(np.int64))
    return v, line[r : r + n], line[r + n :], _from_planes(body, n, len(body) - 2 * n, 2).astype(np.uint16)


def _send(parts: list[tuple], key: int, buckets: int, kind: int, whole: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, batch, kind, body) of documents given as (info, word hashes, tokens a document).

    A token is u, v and w, 5 bytes each, if ``whole``; else these and its document's place in the batch, packed.
    """
    info = np.concatenate([p[0] for p in parts])
    body = info.tobytes()
    batch = int(mix(np.array([np.bitwise_xor.reduce(mix(np.frombuffer(body.ljust(-(-len(body) // 8) * 8, b"\0"), np.uint64) + np.arange(-(-len(body) // 8), dtype=np.uint64))) ^ np.uint64(key)], np.uint64)).view(np.int64)[0])
    if kind != COUNTED:
        yield batch % buckets, batch, DOCS, body
    count = info["tokens"].astype(np.int64)
    word = np.concatenate([p[1] for p in parts])
    live = count[count > 0]
    if not len(live):
        return
    # begin, begin, words, end: one line of all documents
    first = np.concatenate(([0], np.cumsum(live + 2)[:-1]))
    line = np.empty(int((live + 2).sum()), dtype=np.uint64)
    own = np.ones(len(line), dtype=bool)
    own[first] = own[first + 1] = False
    line[first] = line[first + 1] = BEGIN
    last = first + live + 1
    own[last] = False
    line[last] = END
    line[own] = word
    own[last] = True
    at = np.flatnonzero(own)
    place = np.repeat(np.flatnonzero(count > 0), live).astype(np.uint16)
    u, v, w = line[at - 2], line[at - 1], line[at]
    bucket = (_home(v, buckets) + (mix(mix(v) + u * _U) >> np.uint64(40)) % np.uint64(SPREAD)) % np.uint64(buckets)
    # a bucket's equal middle words together, and of these equal contexts, which compress well
    order = np.argsort((bucket << np.uint64(44)) | ((v & np.uint64(0xFFFFF)) << np.uint64(24)) | ((u & np.uint64(0x3FFF)) << np.uint64(10)) | (w & np.uint64(0x3FF)))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    u, v, w, place = u[order], v[order], w[order], place[order]
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        s = slice(bounds[b], bounds[b + 1])
        yield b, batch, kind, _five(u[s]) + _five(v[s]) + _five(w[s]) if whole else _pack(v[s], u[s], w[s], place[s])


_SENT = "bucket int, batch bigint, kind int, body binary"


def _rows(items: list[tuple]) -> pa.RecordBatch:
    items = [(*i[:3], len(i[3]).to_bytes(8, "little") + pa.compress(i[3], codec="zstd", asbytes=True)) for i in items]
    return pa.RecordBatch.from_arrays([pa.array([i[k] for i in items], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "batch", "kind", "body"])


def _blocks(docs: DataFrame, buckets: int, kind: int, whole: bool = False) -> DataFrame:
    """Blocks of tokens of the kind, with the context's bucket: bucket, batch, kind, body."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = docs_held = sent = 0
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held, docs_held, sent
            items = []
            for item in _send(parts, task << 20 | sent, buckets, kind, whole):
                items.append(item)
                if len(items) == 64:
                    yield _rows(items)
                    items = []
            if items:
                yield _rows(items)
            parts, held, docs_held, sent = [], 0, 0, sent + 1

        for batch in batches:
            for part in slices(batch, "text"):
                h, first = _hashes(part.column(1))
                counts = np.diff(first)
                info = np.zeros(part.num_rows, dtype=_INFO)
                ids = part.column(0)
                info["known"] = np.asarray(ids.is_valid())
                info["doc"] = np.asarray(ids.fill_null(0))
                info["tokens"] = np.where(counts > 0, counts + 1, 0)
                for lo in range(0, part.num_rows, 1 << 14):
                    hi = min(part.num_rows, lo + (1 << 14))
                    if parts and docs_held + hi - lo > 1 << 16:
                        yield from flush()
                    parts.append((info[lo:hi], h[first[lo] : first[hi]]))
                    held, docs_held = held + int(counts[lo:hi].sum()), docs_held + hi - lo
                if held > BATCH_TOKENS:
                    yield from flush()
        if parts:
            yield from flush()

    return _texts(docs).mapInArrow(emit, _SENT)


def _exchange(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket"))


def _count(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its key's number; of each number its count and a token that has it."""
    order = order_by_hash(key)
    bounds = runs(key[order])
    number = np.empty(len(key), dtype=np.int32)
    number[order] = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    return number, np.diff(bounds).astype(np.int64), order[bounds[:-1]]


class _Questions:
    """Distinct n-grams in an order that only depends on them, by the bucket of the word that answers."""

    def __init__(self, order: np.ndarray, word: np.ndarray, buckets: int) -> None:
        home = _home(word[order], buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        by = np.argsort(home, kind="stable")
        self.order, self.bounds = order[by], np.searchsorted(home[by], np.arange(buckets + 1))

    def asked(self) -> Iterator[tuple[int, np.ndarray]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield b, self.order[self.bounds[b] : self.bounds[b + 1]]

    def answered(self, bodies: dict[int, np.ndarray]) -> np.ndarray:
        """The answers in the n-grams' own order."""
        out = np.zeros(len(self.order))
        for b, some in self.asked():
            out[some] = bodies[b]
        return out


class _Trigrams:
    """The trigrams of a partition, of each token the number of its trigram, and the bigrams (v, w) in them."""

    def __init__(self, blocks: list[tuple[int, bytes]], buckets: int) -> None:
        empty = np.zeros(0, np.uint64)
        parts = [(empty, empty, empty, np.zeros(0, np.uint16))]
        kinds = np.array([k for k, _ in blocks], np.int64)
        while blocks:
            parts.append(_unpack(blocks.pop(0)[1]))
        self.size = [len(p[0]) for p in parts[1:]]
        v, u, w, self.place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        context = mix(mix(v) + u * _U)
        del u
        self.tri, self.count, first = _count(mix(context + w * _W))
        if (kinds == SCORED).any():
            self.count = np.bincount(self.tri, weights=np.repeat(kinds != SCORED, self.size)).astype(np.int64)
        context, v, w = context[first], v[first], w[first]
        self.context = _count(context)[0]
        del context
        self.pair, _, first = _count(mix(mix(v) + w * _W))
        self.v, self.w = v[first], w[first]
        self.asks = _Questions(np.lexsort((self.w, self.v)), self.v, buckets)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """Bigrams, and how often they were counted here."""
        count = np.bincount(self.pair, weights=self.count, minlength=len(self.v)).astype(np.int64)
        for b, some in self.asks.asked():
            yield b, _runs_of(self.v[some]) + _five(self.w[some]) + _planes(count[some], 5)

    def log_probs(self, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of each token, given P(w|v) of the bigrams."""
        return np.log(_backed_off(self.count, self.context, lower[self.pair], d))[self.tri]


class _Bigrams:
    """The bigrams of the words v of a partition, and the words w in them."""

    def __init__(self, asked: list[tuple[int, bytes]], buckets: int) -> None:
        empty = np.zeros(0, np.uint64)
        parts = [(empty, empty, empty)]
        self.sources = [s for s, _ in asked]
        for _, body in asked:
            v, at = _from_runs(body)
            parts.append((v, _numbers(body, len(v), at), _from_planes(body, len(v), at + 5 * len(v), 5)))
        self.size = [len(p[0]) for p in parts[1:]]
        v, w, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        self.pair, _, first = _count(mix(mix(v) + w * _W))
        self.count = np.bincount(self.pair, weights=count, minlength=len(first)).astype(np.int64)
        self.context = _count(mix(v[first]))[0]
        self.words, self.word = np.unique(w[first], return_inverse=True)
        self.asks = _Questions(np.arange(len(self.words)), self.words, buckets)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(self.word, weights=self.count, minlength=len(self.words)).astype(np.int64)
        for b, some in self.asks.asked():
            yield b, _five(self.words[some]) + _planes(count[some], 5)

    def answers(self, d: np.ndarray, lower: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """P(w|v) to those who asked, given P(w) of the words."""
        p = _backed_off(self.count, self.context, lower[self.word], d)[self.pair]
        at = 0
        for source, size in zip(self.sources, self.size, strict=True):
            yield source, p[at : at + size].tobytes()
            at += size


def _histogram(count: np.ndarray) -> np.ndarray:
    """How many n-grams occur once, twice and so on, and the number of all."""
    n = np.bincount(np.minimum(count, GT_MAX + 2), minlength=GT_MAX + 3).astype(np.int64)
    return np.array([0, *n[1 : GT_MAX + 2], count.sum()], np.int64)


def _backed_off(count: np.ndarray, context: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams within their contexts, given those of the shorter model."""
    counted = count > 0
    kept = d[np.minimum(count, GT_MAX + 1)] * count
    total = np.bincount(context, weights=count)
    p = kept / _whole(total, np.bincount(context, weights=kept))[context]
    alpha = (1 - np.bincount(context, weights=p)) / np.maximum(1 - np.bincount(context, weights=np.where(counted, lower, 0)), 1e-12)
    alpha[total == 0] = 1
    return np.where(counted, p, alpha[context] * lower)


def _words(count: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """P(w) of words that were counted so often; those that weren't are the unknown word."""
    n, total = histogram[: GT_MAX + 2], histogram[-1]
    d = discounts(n)
    used = total - ((1 - d) * np.arange(GT_MAX + 2) * n).sum()
    of = _whole(total, used)
    return np.where(count > 0, d[np.minimum(count, GT_MAX + 1).astype(np.int64)] * count / of, max(1 - used / of, 1e-12))


def _whole(count: np.ndarray, used: np.ndarray) -> np.ndarray:
    """What a context's counts are divided by: one more where nothing was discounted."""
    return count + (used > count - 1e-6)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(c) for c = 0 .. GT_MAX + 1 (the last for all above), from the counts of counts n[0..GT_MAX + 1]."""
    n = n.astype(float)
    c = np.arange(GT_MAX + 2)
    d = np.ones(GT_MAX + 2)
    usable = n[1 : GT_MAX + 2].min() > 0
    if usable:
        a = (GT_MAX + 1) * n[GT_MAX + 1] / n[1]
        inner = c[1 : GT_MAX + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            d[inner] = ((inner + 1) * n[inner + 1] / n[inner] / inner - a) / (1 - a)
        usable = np.isfinite(d).all() and d[1 : GT_MAX + 1].min() > 0 and d[1 : GT_MAX + 1].max() < 1
    if not usable:
        take = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = np.where(c > 0, (c - take) / np.maximum(c, 1), 1.0)
        d[GT_MAX + 1] = 1
    d[0] = 0
    return d


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for got in batches:
        for row in zip(*[got.column(c) for c in ("bucket", "batch", "kind", "body")], strict=True):
            *head, body = (x.as_py() for x in row)
            yield *head, pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def _table(items: Iterable[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(list(items))])


def _asked(batches: Iterable[pa.RecordBatch]) -> tuple[int, list[tuple[int, bytes]], np.ndarray]:
    """A partition's bucket, its blocks of n-grams by who sent them, and the counts of counts of all senders."""
    bucket, grams, counts = 0, [], np.zeros(GT_MAX + 3, np.int64)
    for bucket, source, kind, body in _items(batches):  # noqa: B007
        if kind == COUNTS:
            counts += np.frombuffer(body, np.int64)
        else:
            grams.append((source, body))
    return bucket, grams, counts


def _to_all(buckets: int, source: int, counts: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    return ((b, source, COUNTS, counts.tobytes()) for b in range(buckets))


def _open(batches: Iterable[pa.RecordBatch]) -> tuple[int, list[tuple], list[int], list[tuple[int, bytes]]]:
    """A partition's bucket, its documents, and the batches of its blocks of tokens and these."""
    bucket, info, names, blocks = 0, [], [], []
    for bucket, batch, kind, body in _items(batches):  # noqa: B007
        if kind == DOCS:
            info.append((bucket, batch, kind, body))
        else:
            names.append(batch)
            blocks.append((kind, body))
    return bucket, info, names, blocks


def score(docs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural, of all tokens and the end) and perplexity under the model of the ``counted`` documents, or their own."""
    buckets = partitions(docs.sparkSession)
    sent = _blocks(docs, buckets, BOTH) if counted is None else _blocks(docs, buckets, SCORED).union(_blocks(counted, buckets, COUNTED))
    tokens = _exchange(sent, buckets)

    def ask_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, _, _, blocks = _open(batches)
        if blocks:
            t = _Trigrams(blocks, buckets)
            yield _rows(list(_to_all(buckets, bucket, _histogram(t.count))))
            for b, body in t.questions():
                yield _rows([(b, bucket, GRAMS, body)])

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, asked, _ = _asked(batches)
        if asked:
            t = _Bigrams(asked, buckets)
            yield _rows(list(_to_all(buckets, bucket, _histogram(t.count))))
            for b, body in t.questions():
                yield _rows([(b, bucket, GRAMS, body)])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, asked, bigrams = _asked(batches)
        if asked:
            words, number = np.unique(np.concatenate([_numbers(x, len(x) // 10, 0) for _, x in asked]), return_inverse=True)
            count = np.bincount(number, weights=np.concatenate([_from_planes(x, len(x) // 10, 5 * (len(x) // 10), 5) for _, x in asked]), minlength=len(words)).astype(np.int64)
            # to every task of bigrams this task's part of the counts of counts of words, and those of bigrams to whom it answers
            yield _rows(list(_to_all(buckets, bucket, _histogram(count))))
            at = 0
            for source, x in asked:
                yield _rows([(source, bucket, GRAMS, bigrams.tobytes() + _planes(count[number[at : at + len(x) // 10]], 5))])
                at += len(x) // 10

    bigrams = _exchange(tokens.mapInArrow(ask_bigrams, _SENT), buckets)
    words = _exchange(bigrams.mapInArrow(ask_words, _SENT), buckets)
    word_counts = _exchange(words.mapInArrow(count_words, _SENT), buckets)

    def answer_bigrams(asked: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, asked, trigrams = _asked(asked.to_batches())
        _, got, histogram = _asked(answers.to_batches())
        if not asked:
            return _table([])
        t = _Bigrams(asked, buckets)
        head = 8 * (GT_MAX + 3)
        counts = t.asks.answered({b: _from_planes(x, (len(x) - head) // 5, head, 5) for b, x in got})
        d = discounts(np.frombuffer(got[0][1], np.int64, GT_MAX + 2))
        return _table((source, bucket, GRAMS, trigrams.tobytes() + body) for source, body in t.answers(d, _words(counts, histogram)))

    def evaluate(sent: pa.Table, answers: pa.Table) -> pa.Table:
        _, info, names, blocks = _open(sent.to_batches())
        _, got, _ = _asked(answers.to_batches())
        if not blocks:
            return _table(info)
        kinds = [k for k, _ in blocks]
        t = _Trigrams(blocks, buckets)
        d = discounts(np.frombuffer(got[0][1], np.int64, GT_MAX + 2))
        value = t.log_probs(d, t.asks.answered({b: np.frombuffer(x, np.float64, offset=8 * (GT_MAX + 3)) for b, x in got}))
        at = 0
        for batch, kind, size in zip(names, kinds, t.size, strict=True):
            if kind != COUNTED:
                total = np.bincount(t.place[at : at + size], weights=value[at : at + size])
                some = np.unique(t.place[at : at + size])
                out = np.empty(len(some), dtype=_SUM)
                out["place"], out["sum"] = some, total[some]
                info.append((0, batch, BOTH, out.tobytes()))
            at += size
        return _table(info)

    def zipped(a: DataFrame, b: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """Both tables' rows of each bucket; they lie in one partition already."""
        return a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(f, _SENT)

    lower = _exchange(zipped(bigrams, word_counts, answer_bigrams), buckets)
    sums = zipped(tokens, lower, evaluate)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: dict[int, np.ndarray] = {}
        total: dict[int, np.ndarray] = {}
        for _, batch, kind, body in _items(batches):
            if kind == DOCS:
                info[batch] = np.frombuffer(body, _INFO)
            else:
                part = np.frombuffer(body, _SUM)
                if batch not in total:
                    total[batch] = np.zeros(1 << 16)
                total[batch][part["place"]] += part["sum"]
        for batch, row in info.items():
            n = row["tokens"].astype(np.int64)
            value = total.get(batch, np.zeros(1 << 16))[: len(row)]
            perplexity = np.exp(-value / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(row["doc"]), mask=row["known"] == 0), pa.array(n), pa.array(np.round(value, 3)), pa.array(np.round(perplexity, 3), mask=n == 0)],
                names=["doc_id", "n_tokens", "log_prob", "perplexity"],
            )

    return sums.repartition(buckets, "batch").mapInArrow(add, "doc_id bigint, n_tokens bigint, log_prob double, perplexity double")


@dataclass
class Model:
    """Tables of a model: each order's probabilities, and the weights of contexts to back off with."""

    trigrams: DataFrame  # u, v, w, count, p
    contexts: DataFrame  # u, v, alpha
    bigrams: DataFrame  # v, w, count, p
    backoff: DataFrame  # v, alpha
    unigrams: DataFrame  # w, count, p
    unknown: float  # the mass of all words that weren't counted


def _trigram_counts(docs: DataFrame) -> DataFrame:
    """u, v, w and count, each trigram once."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [x for _, x in _open(batches)[3]]
        u, v, w = (np.concatenate([np.zeros(0, np.uint64), *[_numbers(x, len(x) // 15, c * (len(x) // 3)) for x in bodies]]) for c in range(3))
        _, count, first = _count(mix(mix(mix(v) + u * _U) + w * _W))
        for k in range(0, len(first), 1 << 16):
            some = first[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[some].view(np.int64)) for x in (u, v, w)], pa.array(count[k : k + (1 << 16)])], names=["u", "v", "w", "count"])

    buckets = partitions(docs.sparkSession)
    return _exchange(_blocks(docs, buckets, COUNTED, True), buckets).mapInArrow(distinct, "u bigint, v bigint, w bigint, count bigint")


def model(docs: DataFrame) -> Model:
    """The model of the documents, as tables in the cluster's shared folder."""
    tri = cut(_trigram_counts(docs))
    bi = cut(tri.groupBy("v", "w").agg(F.sum("count").alias("count")))
    uni = cut(bi.groupBy("w").agg(F.sum("count").alias("count")))

    def discounted(counts: DataFrame) -> Column:
        n = np.zeros(GT_MAX + 2, np.int64)
        for r in counts.where(F.col("count") <= GT_MAX + 1).groupBy("count").agg(F.count("*").alias("n")).collect():
            n[r["count"]] = r.n
        d = F.array(*[F.lit(float(x)) for x in discounts(n)])
        return F.get(d, F.least("count", F.lit(GT_MAX + 1)).cast("int")) * F.col("count")

    def shares(counts: DataFrame, *context: str) -> DataFrame:
        """p of each n-gram within its context."""
        some = counts.withColumn("kept", discounted(counts))
        total = some.groupBy(*context).agg(F.sum("count").alias("of"), F.sum("kept").alias("used"))
        total = total.select(*context, (F.col("of") + (F.col("used") > F.col("of") - 1e-6).cast("int")).alias("of"))
        joined = some.join(total, list(context)) if context else some.crossJoin(F.broadcast(total))
        return cut(joined.withColumn("p", F.col("kept") / F.col("of")).drop("kept", "of"))

    tri, bi, uni = shares(tri, "u", "v"), shares(bi, "v"), shares(uni)
    weight = (1 - F.sum("p")) / F.greatest(1 - F.sum("lower"), F.lit(1e-12))
    contexts = tri.join(bi.select("v", "w", F.col("p").alias("lower")), ["v", "w"]).groupBy("u", "v").agg(weight.alias("alpha"))
    backoff = bi.join(uni.select("w", F.col("p").alias("lower")), "w").groupBy("v").agg(weight.alias("alpha"))
    seen = uni.agg(F.sum("p")).first()[0]
    return Model(tri, cut(contexts), bi, cut(backoff), uni, 1.0 if seen is None else max(1 - seen, 1e-12))


def score_with(m: Model, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob and perplexity of any documents, each token evaluated down to the order that has it."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = _hashes(part.column(1))
                for k in range(part.num_rows):
                    own = h[first[k] : first[k + 1]]
                    if len(own):
                        line = np.concatenate(([BEGIN, BEGIN], own, [END])).astype(np.int64)
                        n = len(line) - 2
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.column(0)[k].as_py(), np.int64)), *[pa.array(line[c : c + n]) for c in range(3)]], names=["key", "u", "v", "w"])

    # the key of a row is a hash of its id and text
    rows = _texts(docs).distinct().select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"), "doc_id", "text")
    token = rows.select("key", "text").mapInArrow(tokens, "key bigint, u bigint, v bigint, w bigint")
    # equal trigrams of a document are looked up once
    token = token.groupBy("key", "u", "v", "w").agg(F.count("*").alias("times"))
    token = token.join(m.trigrams.select("u", "v", "w", F.col("p").alias("p3")), ["u", "v", "w"], "left")
    token = token.join(m.contexts.select("u", "v", F.col("alpha").alias("a3")), ["u", "v"], "left")
    token = token.join(m.bigrams.select("v", "w", F.col("p").alias("p2")), ["v", "w"], "left")
    token = token.join(m.backoff.select("v", F.col("alpha").alias("a2")), "v", "left")
    token = token.join(m.unigrams.select("w", F.col("p").alias("p1")), "w", "left")
    one = F.lit(1.0)
    p1 = F.coalesce("p1", F.lit(float(m.unknown)))
    p2 = F.coalesce("p2", F.coalesce("a2", one) * p1)
    p3 = F.coalesce("p3", F.coalesce("a3", one) * p2)
    sums = token.groupBy("key").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.log(p3)).alias("value"))
    n, value = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("value", F.lit(0.0))
    return rows.drop("text").join(sums, "key", "left").select(
        "doc_id", n.alias("n_tokens"), F.round(value, 3).alias("log_prob"), F.when(n > 0, F.round(F.exp(-value / n), 3)).alias("perplexity")
    )


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
