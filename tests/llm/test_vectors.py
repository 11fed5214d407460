from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from turnloom.llm import graph_search, pivot_search
from turnloom.llm.vectors import asked

from .helpers import vectors


def clustered(seed: int, n: int, dim: int = 16) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    v = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.3
    return [(int(k), [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def brute(rows: list[tuple], k: int) -> dict[int, list[tuple]]:
    out = {}
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows])
    for q in sorted(set(ids.tolist())):
        pairs = set()
        for x in v[ids == q]:
            d = np.round(np.sqrt(((v - x) ** 2).sum(axis=1)), 6)
            pairs |= {(float(a), int(b)) for a, b in zip(d, ids, strict=True) if b != q}
        out[q] = sorted(pairs)[:k]
    return out


def collected(df) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.distance, r.neighbour_id))
    return out


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_pivot_search_is_exact(spark, shard_rows):
    rows = clustered(1, 400)
    got = collected(pivot_search.top_k(vectors(spark, rows, extra=True), 10, 8, shard_rows))
    want = brute(rows, 10)
    assert {q: [n for _, n in x] for q, x in got.items()} == {q: [n for _, n in x] for q, x in want.items()}
    for q in want:
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-6)


def shard(v: np.ndarray, n_pivots: int = 16) -> tuple[pivot_search.Shard, np.ndarray]:
    pivots = pivot_search.choose_pivots(v, n_pivots)
    d = pivot_search.to_pivots(v, pivots)
    return pivot_search.Shard(np.arange(len(v)), v, d), d


def nearest(v: np.ndarray, q: int, k: int) -> list[int]:
    exact = np.round(np.sqrt(((v - v[q]) ** 2).sum(axis=1)), 6)
    exact[q] = np.inf
    return np.lexsort((np.arange(len(v)), exact))[:k].tolist()


def test_elimination_evaluates_few_candidates():
    """In few dimensions the bounds leave a small part of the pairs, in the order of which they are exact."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20000, 3))
    ready, d = shard(v)
    some = np.arange(0, 20000, 200)
    q, n, _ = ready.search(some, v[some], d[some], 4, np.full(len(some), np.inf))
    for k in some:
        assert n[q == k].tolist() == nearest(v, k, 4)
    assert ready.evaluated < 0.25 * len(some) * len(v)


@given(st.floats(-3, 6), st.floats(-3, 6), st.integers(0, 99), st.sampled_from([3, 8, 64]))
@settings(max_examples=60, deadline=None)
def test_exact_at_any_scale_and_offset(scale, offset, seed, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = (centres[rng.integers(0, 6, 900)] + 0.2 * rng.normal(size=(900, dim))) * 10.0**scale + 10.0**offset
    v[100:110] = v[:10]
    ready, d = shard(v)
    some = np.arange(0, 900, 20)
    for limit in (np.full(len(some), np.inf), np.array([np.round(np.sqrt(((v - v[i]) ** 2).sum(axis=1)), 6)[nearest(v, i, 7)[-1]] for i in some])):
        q, n, _ = ready.search(some, v[some], d[some], 5, limit)
        for k in some:
            assert n[q == k].tolist() == nearest(v, k, 5)


def test_only_the_rows_asked_for_are_queries(spark):
    rows = clustered(7, 300)
    want = {q: [n for _, n in x] for q, x in brute(rows, 10).items() if q % 20 == 0}
    got = collected(pivot_search.top_k(vectors(spark, rows), 10, 8, 64, choose=asked))
    assert {q: [n for _, n in x] for q, x in got.items()} == want
    got = collected(graph_search.search(vectors(spark, rows), 10, 64, choose=asked))
    assert set(got) == set(want)
    assert sum(len({n for _, n in got[q]} & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


AWKWARD = [
    (None, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, 2.0, 3.0]),
    (10, [0.0, 0.0]), (11, [0.0, 0.0]), (12, [3.0, 4.0]), (12, [3.0, 4.0]), (13, [0.0, 1.0]), (14, [1.0, 0.0]),
]


@pytest.mark.parametrize("search", [pivot_search.top_k, graph_search.search])
def test_awkward_rows(spark, search):
    want = brute([r for r in AWKWARD if r[0] is not None and r[0] >= 10], 3)
    assert collected(search(vectors(spark, AWKWARD, extra=True), k=3)) == want


@pytest.mark.parametrize("search", [pivot_search.top_k, graph_search.search])
def test_few_rows_and_none(spark, search):
    assert search(vectors(spark, [])).count() == 0
    assert search(vectors(spark, [(1, [1.0])])).count() == 0
    assert collected(search(vectors(spark, [(1, [1.0]), (2, [3.0])]))) == {1: [(2.0, 2)], 2: [(2.0, 1)]}


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_graph_recall(spark, shard_rows):
    rows = clustered(3, 1500, 24)
    got = collected(graph_search.search(vectors(spark, rows), 10, shard_rows))
    want = brute(rows, 10)
    hits = sum(len({n for _, n in got[q]} & {n for _, n in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9


def test_graph_recall_on_the_embeddings(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    got = collected(graph_search.search(e))
    want = brute(rows, 10)
    assert sum(len({n for _, n in got[q]} & {n for _, n in want[q]}) for q in want) / (10 * len(want)) >= 0.9


@pytest.mark.parametrize("copies", [20, 300])
def test_graph_recall_among_equal_vectors(spark, copies):
    """Members of groups of equal vectors find one another, and the others find what is nearest to them."""
    rng = np.random.default_rng(copies)
    v = rng.normal(size=(600 + 600 // copies, 64))
    v = np.concatenate((v[:600], np.repeat(v[600:], copies, axis=0)))
    v = (v / np.sqrt((v**2).sum(axis=1, keepdims=True))).astype(np.float32)
    order = rng.permutation(len(v))
    rows = [(int(k), [float(x) for x in v[i]]) for k, i in enumerate(order)]
    got = collected(graph_search.search(vectors(spark, rows)))
    want = brute(rows, 10)
    for group in (order < 600, order >= 600):
        members = np.flatnonzero(group).tolist()
        hits = sum(len({n for _, n in got[q]} & {n for _, n in want[q]}) for q in members)
        assert hits / (10 * len(members)) >= 0.95


def test_back_edges_beyond_four_lists_count():
    """Around a hub every vector's edge back is a candidate, however many there are in a batch."""
    rng = np.random.default_rng(4)
    v = np.concatenate((np.zeros((1, 300)), np.eye(300))).astype(np.float32)
    v[1:] *= rng.permutation(np.linspace(1, 1.2, 300))[:, None].astype(np.float32)
    graph, _ = graph_search.build(v, degree=4, beam=32)
    nearest = np.argsort((v[1:] ** 2).sum(axis=1))[:4] + 1
    assert set(graph[0].tolist()) == set(nearest.tolist())


def test_robust_prune_keeps_diverse_edges():
    """Of a tight cluster one edge is enough; a far point in another direction stays."""
    v = np.array([[0, 0], [1, 0], [1.05, 0], [1.1, 0.01], [0, 3]], dtype=np.float32)
    norm = (v**2).sum(axis=1)
    edges = graph_search.robust_prune(v, norm, np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)
    assert edges[0].tolist() == [1, 4, -1, -1]
