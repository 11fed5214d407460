from __future__ import annotations

import random
import re

import numpy as np
import pytest
from turnloom.llm import ngram_join

from .helpers import awkward, documents, prose


def grams(text: str | None, n: int = 5) -> frozenset:
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows: list[tuple], threshold: float = 0.5) -> dict:
    """Similar pairs of documents by id."""
    return {(a, b): j for (a, _), (b, _), j in linked(rows, threshold) if a != b}


def linked(rows: list[tuple], threshold: float = 0.5) -> list[tuple]:
    docs = sorted({(r[0], grams(r[1])) for r in rows if r[0] is not None and grams(r[1])}, key=lambda d: (d[0], sorted(d[1])))
    out = []
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            j = len(a[1] & b[1]) / len(a[1] | b[1])
            if j >= threshold - 1e-9:
                out.append((a, b, round(j, 6)))
    return out


def brute_rows(rows: list[tuple], threshold: float = 0.5) -> list[tuple]:
    """(doc_id, class_id, links) of each document, by union and find."""
    docs = {(r[0], grams(r[1])) for r in rows if r[0] is not None}
    root, links = {d: d for d in docs}, dict.fromkeys(docs, 0)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b, _ in linked(rows, threshold):
        links[a] += 1
        links[b] += 1
        root[find(a)] = find(b)
    least = {}
    for d in docs:
        least[find(d)] = min(least.get(find(d), d[0]), d[0])
    return sorted((d[0], least[find(d)], links[d]) for d in docs)


def found(df) -> list[tuple]:
    return sorted((r.doc_id, r.class_id, r.links) for r in df.collect())


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.5), (3, 0.8), (4, 0.35)])
def test_classes_and_links_equal_brute_force(spark, seed, threshold):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        text = prose(rng, rng.choice([6, 20, 60, 200]), 5000)
        rows += [(base * 100 + k, edited(rng, text, k % 7)) for k in range(rng.randrange(1, 12))]
    rows += [(9000 + k, rows[0][1]) for k in range(5)] + [(9000, rows[0][1]), (9001, prose(rng, 50))]
    rng.shuffle(rows)
    assert found(ngram_join.similar_documents(documents(spark, rows, extra=seed == 2), threshold)) == brute_rows(rows, threshold)


@pytest.mark.parametrize("cell", [512, 8])
def test_large_regions_are_held_in_parts(spark, monkeypatch, cell):
    """Parts and cells far smaller than the group, so that windows and rows that pass by take part."""
    monkeypatch.setattr(ngram_join, "REGION_ROWS", 40)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell)
    rng = random.Random(3)
    text = prose(rng, 90, 5000)
    rows = [(k, edited(rng, text, k % 9)) for k in range(150)]
    assert found(ngram_join.similar_documents(documents(spark, rows))) == brute_rows(rows)


def test_passages_held_by_most_of_a_batch(spark):
    """n-grams that a batch of documents holds often travel once, with their count."""
    rng = random.Random(8)
    passage = prose(rng, 30, 5000)
    rows = [(k, f"{prose(rng, 8 + k % 20, 5000)} {passage}") for k in range(200)]
    assert found(ngram_join.similar_documents(documents(spark, rows))) == brute_rows(rows)


def families(rng: random.Random, count: int, size: int) -> list[np.ndarray]:
    sets = []
    for _ in range(count):
        base = [rng.getrandbits(62) for _ in range(40)]
        sets += [np.unique(np.array(base[k * 3 % 24 :] + [rng.getrandbits(62) for _ in range(k % 5)])) for k in range(size)]
    rng.shuffle(sets)
    return sets


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
@pytest.mark.parametrize("strangers", [False, True])
def test_region_cells_are_exact(monkeypatch, threshold, strangers):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 8)
    rng = random.Random(4)
    sets = families(rng, 30, 6)
    some = 120 if strangers else len(sets)
    size, weight = np.array([len(s) for s in sets]), np.array([rng.randrange(1, 4) for _ in sets])
    none = [np.array([rng.randrange(40)]) for _ in sets]
    region = ngram_join.Region(sets[:some], size[:some], weight[:some], none[:some], threshold, strangers)
    region.join()
    links = np.zeros(len(sets), dtype=int)
    if strangers:
        links[some:], first = region.pass_by(sets[some:], size[some:], weight[some:], none[some:])
    links[:some] = region.links
    want = np.zeros(len(sets), dtype=int)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n / (size[i] + size[j] - n) >= threshold and none[i][0] != none[j][0] and i < some:
                want[i] += weight[j]
                want[j] += weight[i]
    assert links.tolist() == want.tolist()
    if strangers:
        assert ((first >= 0) == (want[some:] > 0)).all()


def test_windows_rule_out_most_pairs_of_unrelated_families():
    """1500 sets in 15 families at the registered threshold: few of the million pairs are compared."""
    sets = families(random.Random(5), 15, 100)
    region = ngram_join.Region(sets, np.array([len(s) for s in sets]), np.ones(len(sets), int), [np.zeros(0, int)] * len(sets), ngram_join.THRESHOLD)
    region.join()
    assert region.tried < 0.2 * len(sets) ** 2
    assert (region.links >= 1).all()


def test_awkward_rows(spark):
    rows = awkward(random.Random(5))
    got = found(ngram_join.similar_documents(documents(spark, rows, extra=True)))
    assert got == brute_rows(rows)
    assert [r for r in got if r[2]] == [(4, 4, 1), (5, 4, 1)] and brute(rows) == {(4, 5): 1.0}


def test_empty_table(spark):
    assert found(ngram_join.similar_documents(documents(spark, []))) == []
    assert ngram_join.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    text = prose(rng, 100, 5000)
    chain = [(k, " ".join(text.split(" ")[k * 8 :] + [f"y{j}" for j in range(k * 8)])) for k in range(6)]
    rows = chain + awkward(rng)[:5] + [(50, prose(rng, 60)), (51, prose(rng, 60))]
    rows = [(r[0] + 100 if r[0] is not None and i >= 6 else r[0], r[1]) for i, r in enumerate(rows)]
    pairs = brute(rows)
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = sorted((r[0] for r in rows if r[0] is None or find(r[0]) == r[0]), key=str)
    docs = documents(spark, rows, extra=True)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}
