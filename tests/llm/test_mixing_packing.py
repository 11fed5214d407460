from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from turnloom.llm import mixing, packing

from .helpers import awkward, documents, prose


def tokens(text: str | None) -> list[str]:
    """Words with the space behind them, the first also with that before."""
    found = re.findall("[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", text or "")
    if found:
        found[0] = text[: len(text) - sum(map(len, found))] + found[0]
    return found


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, prose(rng, rng.randrange(1, 90)), "en", rng.choice(["a", "a", "a", "b", "c"])) for k in range(120)]


@given(st.integers(1, 300), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_permutation(size, key):
    assert sorted(mixing.permute(np.arange(size), size, key).tolist()) == list(range(size))


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0}])
def test_slots_are_those_of_the_draws(spark, weights):
    """Counts a shard, permuted indexes and slots as drawn one by one; blocks hold every token once."""
    rows = corpus(1)
    text = {r[0]: tokens(r[1]) for r in rows}
    source = {r[0]: r[3] for r in rows}
    got = mixing.mix_sources(documents(spark, rows), weights, block=16, shard=40, epochs=1.5, seed=3).collect()
    blocks: dict[tuple, tuple] = {}
    for r in got:
        pieces = tuple(zip(r.doc_ids, r.first_tokens, r.lengths, r.texts, strict=True))
        assert blocks.setdefault((r.source, r.block_index), pieces) == pieces
        assert r.n_tokens == sum(r.lengths) <= 16
        for d, first, n, t in pieces:
            assert "".join(text[d][first : first + n]) == t and source[d] == r.source
    names = ["a", "b", "c"] if weights is None else ["a", "b"]
    held = {s: 1 + max(i for x, i in blocks if x == s) for s in names}
    total = len(got)
    p = np.ones(3) / 3 if weights is None else np.array([0.25, 0.75])
    have = {(r.shard, r.slot): (r.source, r.block_index, r.epoch) for r in got}
    assert len(have) == total
    start = Counter()
    for s in range(-(-total // 40)):
        slots = min(40, total - 40 * s)
        counts = np.random.default_rng([3, s]).multinomial(slots, p)
        order = np.random.default_rng([3, s, 1]).permutation(slots)
        at = 0
        for name, count in zip(names, counts, strict=True):
            for k in range(count):
                ordinal = start[name] + k
                n = held[name] if weights is None or name == "b" else None
                row = have[s, order[at + k]]
                assert row[0] == name
                if n is not None and ordinal >= n and all((name, i) in blocks for i in range(n)):
                    assert row[2] == ordinal // n
            start[name] += count
            at += count


def test_every_block_is_used_once_an_epoch(spark):
    """One source: a permutation of its blocks, so each token of each document comes exactly once."""
    rows = [(r[0], r[1], "en", "only") for r in corpus(2)]
    got = mixing.mix_sources(documents(spark, rows, extra=True), block=16, shard=10).collect()
    assert sorted(r.block_index for r in got) == list(range(len(got)))
    seen = Counter((d, first + k) for r in got for d, first, n in zip(r.doc_ids, r.first_tokens, r.lengths, strict=True) for k in range(n))
    assert seen == Counter((d, k) for d, t, *_ in rows for k in range(len(tokens(t))))
    # all but the last block of each group of left-overs are full
    assert sum(r.n_tokens < 16 for r in got) <= 1


def test_starts_of_slots_over_several_spans(spark, monkeypatch):
    """Counts of shards are summed span by span; each block still comes once an epoch."""
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [(r[0], r[1], "en", "only") for r in corpus(10)]
    got = mixing.mix_sources(documents(spark, rows), block=16, shard=10, epochs=2).collect()
    assert Counter(r.block_index for r in got) == Counter({i: 2 for i in range(len(got) // 2)})


def test_shares_follow_the_weights(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 60), "en", "hot" if k % 10 else "rare") for k in range(300)]
    got = mixing.mix_sources(documents(spark, rows), {"hot": 1, "rare": 1}, block=8, shard=64).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in got}
    assert abs(share["hot"] / sum(share.values()) - 0.5) < 0.06


def test_mixing_awkward_rows(spark):
    rows = [(r[0], r[1], "en", [None, "a", "a", "b"][k % 4]) for k, r in enumerate(awkward(random.Random(4)))]
    got = mixing.mix_sources(documents(spark, rows, extra=True), block=64).collect()
    used = {d for r in got for d in r.doc_ids}
    assert not used & {1, 2, 3}
    assert {r.source for r in got} <= {"", "a", "b"}
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    mixed = mixing.mixed_documents(documents(spark, rows, extra=True), block=64)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def slow_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The positions in each bin, step by step over plain lists, with the stated order of ties."""
    stock = list(range(len(lengths)))  # of equal lengths the last is taken first

    def longest(most: int, besides: int | None = None) -> int | None:
        fitting = [i for i in stock if lengths[i] <= most and i != besides]
        return max(reversed(fitting), key=lambda i: lengths[i], default=None)

    out = []
    while stock:
        chosen, gap = [], capacity
        while (i := longest(gap)) is not None:
            stock.remove(i)
            chosen.append(i)
            gap -= lengths[i]
        if gap and stock:
            room, best = gap + lengths[chosen[-1]], None
            for n in sorted({lengths[i] for i in stock if lengths[i] <= room}):
                a = next(i for i in reversed(stock) if lengths[i] == n)
                b = longest(room - n, a)
                if b is not None and (best is None or n + lengths[b] > lengths[best[0]] + lengths[best[1]]):
                    best = a, b
            if best and sum(lengths[i] for i in best) > lengths[chosen[-1]]:
                back = chosen.pop()
                for i in best:
                    stock.remove(i)
                chosen += best
                stock.append(back)
        out.append(chosen)
    return out


@given(st.lists(st.integers(1, 30), max_size=40))
@settings(max_examples=200, deadline=None)
def test_two_fit(lengths):
    bins = packing.best_two_fit(np.array(lengths, dtype=np.int64), 30)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert bins == slow_two_fit(lengths, 30)


def test_packing_is_the_same_in_any_order_and_partitioning(spark):
    rows = [*corpus(8), *corpus(8)[:20], (None, "a b c"), (None, "d e f")]
    bins = lambda r, n: sorted(repr(x) for x in packing.pack_documents(documents(spark, r).repartition(n), capacity=64, group_docs=60).collect())
    want = bins(rows, 1)
    random.Random(1).shuffle(rows)
    assert bins(rows, 7) == want


def test_groups_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 2000)
    got = packing.pack_documents(documents(spark, corpus(9)), capacity=64).collect()
    assert len({r.pack_group for r in got}) > 5
    assert sorted({d for r in got for d in r.doc_ids}) == list(range(120))


def test_packing_round_trip(spark):
    rows = [*corpus(5), (500, prose(random.Random(6), 900), "en", "a")]
    got = packing.pack_documents(documents(spark, rows, extra=True), capacity=64, group_docs=50).collect()
    text: dict[int, dict[int, str]] = {}
    for r in got:
        assert r.used == sum(r.lengths) <= 64
        for d, first, n, t in zip(r.doc_ids, r.first_tokens, r.lengths, r.texts, strict=True):
            assert len(tokens(t)) == n
            text.setdefault(d, {})[first] = t
    assert {d: "".join(t for _, t in sorted(p.items())) for d, p in text.items()} == {r[0]: r[1] for r in rows}
    assert sum(r.used for r in got) / (64 * len(got)) > 0.95


def test_packing_awkward_rows(spark):
    rows = awkward(random.Random(7))
    got = packing.pack_documents(documents(spark, rows, extra=True)).collect()
    seen = Counter(d for r in got for d, first in zip(r.doc_ids, r.first_tokens, strict=True) if first == 0)
    assert seen == Counter({None: 1, 4: 1, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1})
    assert packing.pack_documents(documents(spark, [])).count() == 0
