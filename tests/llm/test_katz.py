from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from turnloom.llm import katz

from .helpers import awkward, documents, prose


def lines(rows: list[tuple]) -> list[list[str]]:
    out = []
    for r in rows:
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", r[1] or "") if w]
        out.append(["<b>", "<b>", *words, "</e>"] if words else [])
    return out


class Textbook:
    """The model straight from its definition, order by order, with unknown words."""

    def __init__(self, rows: list[tuple]) -> None:
        self.counts = [Counter(), Counter(), Counter()]
        for line in lines(rows):
            for k in range(2, len(line)):
                for order in range(3):
                    self.counts[order][tuple(line[k - order : k + 1])] += 1
        hist = lambda c: np.array([0, *[sum(x == k for x in c.values()) for k in range(1, katz.GT_MAX + 2)]])
        self.d = [katz.discounts(hist(c)) for c in self.counts]
        self.context: list[dict] = [{}, {}, {}]
        for order, counts in enumerate(self.counts):
            for gram, c in counts.items():
                self.context[order].setdefault(gram[:-1], {})[gram[-1]] = c
        self.vocabulary = {g[0] for g in self.counts[0]}

    def kept(self, order: int, context: tuple) -> dict[str, float]:
        """Discounted probabilities of the words counted after a context."""
        words = self.context[order].get(context, {})
        share = {w: self.d[order][min(c, katz.GT_MAX + 1)] * c for w, c in words.items()}
        total = sum(words.values())
        return {w: s / (total + (sum(share.values()) > total - 1e-6)) for w, s in share.items()}

    def p(self, context: tuple, word: str) -> float:
        order = len(context)
        kept = self.kept(order, context)
        if word in kept:
            return kept[word]
        if order == 0:
            return 1 - sum(kept.values())
        if not kept:
            return self.p(context[1:], word)
        alpha = (1 - sum(kept.values())) / (1 - sum(self.p(context[1:], w) for w in kept))
        return alpha * self.p(context[1:], word)

    def score(self, rows: list[tuple]) -> list[float]:
        return [sum(math.log(self.p((u, v), w)) for u, v, w in zip(line, line[1:], line[2:], strict=False)) for line in lines(rows)]


def brute(rows: list[tuple]) -> list[float]:
    return Textbook(rows).score(rows)


@pytest.mark.parametrize("vocabulary", [12, 60, 3000])
def test_scores_equal_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    rows = [(k, " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randrange(1, 80)))) for k in range(150)]
    want = brute(rows)
    got = {r.doc_id: r for r in katz.score(documents(spark, rows, extra=vocabulary == 12)).collect()}
    assert len(got) == len(rows)
    for (k, text), w in zip(rows, want, strict=True):
        assert got[k].n_tokens == len(text.split()) + 1
        assert got[k].log_prob == pytest.approx(w, abs=0.01, rel=1e-5)
        assert got[k].perplexity == pytest.approx(math.exp(-w / got[k].n_tokens), rel=1e-3)


def corpus(seed: int, vocabulary: int, n: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(rng.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("vocabulary", [8, 60])
def test_other_documents_back_off_to_every_order(spark, vocabulary):
    """Unseen trigrams, bigrams, words and contexts of the scored documents, against the textbook."""
    rows, other = corpus(1, vocabulary), corpus(2, vocabulary, 30)
    other += [(100, "new words only here"), (101, f"w1 new w2 w1 {'w3 ' * 20}"), (102, ""), (103, None), (None, "w1 w2"), (104, "w1"), (104, "w1")]
    book = Textbook(rows)
    m = katz.model(documents(spark, rows, extra=True))
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in katz.score_with(m, documents(spark, other, extra=True)).collect()), key=repr)
    want = sorted({(r[0], max(0, len(line) - 2), s) for r, line, s in zip(other, lines(other), book.score(other), strict=True)}, key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


def test_counted_documents_score_alike_both_ways(spark):
    rows = corpus(4, 40)
    docs = documents(spark, rows)
    want = {r.doc_id: r.log_prob for r in katz.score(docs).collect()}
    got = {r.doc_id: r.log_prob for r in katz.score_with(katz.model(docs), docs).collect()}
    assert got == pytest.approx(want, abs=2e-3)


def test_distributions_sum_to_one_over_the_whole_vocabulary(spark):
    """Of every context of two words, one and none, with all unknown words as one more word."""
    rows = corpus(5, 12)
    m = katz.model(documents(spark, rows))
    p1 = {r.w: r.p for r in m.unigrams.collect()}
    assert sum(p1.values()) + m.unknown == pytest.approx(1, abs=1e-9)
    p2, a2 = {(r.v, r.w): r.p for r in m.bigrams.collect()}, {r.v: r.alpha for r in m.backoff.collect()}
    low = lambda v, w: p2.get((v, w), a2[v] * p1.get(w, m.unknown))
    for v in a2:
        assert sum(low(v, w) for w in [*p1, None]) == pytest.approx(1, abs=1e-9)
    p3 = {(r.u, r.v, r.w): r.p for r in m.trigrams.collect()}
    for r in m.contexts.collect():
        assert sum(p3.get((r.u, r.v, w), r.alpha * low(r.v, w)) for w in [*p1, None]) == pytest.approx(1, abs=1e-9)
    book = Textbook(rows)
    assert sum(book.p(("w0", "w1"), w) for w in [*book.vocabulary, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_trigrams_that_occur_once_are_discounted_and_used(spark):
    m = katz.model(documents(spark, corpus(3, 60)))
    table = m.trigrams.collect()
    d = katz.discounts(np.bincount([min(r["count"], katz.GT_MAX + 2) for r in table], minlength=katz.GT_MAX + 3)[: katz.GT_MAX + 2])
    context = Counter()
    for r in table:
        context[r.u, r.v] += r["count"]
    once = [r for r in table if r["count"] == 1]
    assert len(once) > 100 and 0 < d[1] < 1
    assert all(r.p == pytest.approx(d[1] / context[r.u, r.v]) for r in once)


def test_model_of_an_empty_table(spark):
    m = katz.model(documents(spark, [(1, None), (2, " ")]))
    got = katz.score_with(m, documents(spark, [(1, "a b"), (2, "")])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.log_prob) for r in got) == [(1, 3, 0.0), (2, 0, 0.0)]


def test_awkward_rows(spark):
    rows = awkward(random.Random(2))
    got = katz.score(documents(spark, rows, extra=True)).collect()
    want = sorted(((r[0], len((r[1] or "").split()) + 1 if (r[1] or "").split() else 0) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == want
    assert all(r.log_prob == 0 and r.perplexity is None for r in got if r.n_tokens == 0)
    assert len({r.log_prob for r in got if r.doc_id in (4, 5)}) == 1
    for r, w in zip(sorted((x for x in got if x.doc_id is not None and x.doc_id > 5), key=lambda x: x.doc_id), [b for x, b in sorted(zip([x[0] for x in rows], brute(rows), strict=True), key=lambda t: t[0] or 0) if x is not None and x > 5], strict=True):
        assert r.log_prob == pytest.approx(w, abs=0.05, rel=1e-4)
    assert katz.score(documents(spark, [])).count() == 0


def test_good_turing_discounts():
    d = katz.discounts(np.array([0, 1000, 400, 200, 120, 80, 56]))
    a = 6 * 56 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - a) / (1 - a))
    assert d[6] == 1 and all(0 < x < 1 for x in d[1:6])
    assert prose(random.Random(1), 3).count(" ") == 2


@pytest.mark.parametrize("vocabulary", [8, 60])
def test_score_backs_off_through_all_orders(spark, vocabulary):
    """Documents scored under another table's model: trigrams, bigrams, words and contexts that it doesn't have, and counted ones."""
    rows, other = corpus(1, vocabulary), corpus(2, vocabulary, 30)
    other += [(100, "new words only here"), (101, f"w1 new w2 w1 {'w3 ' * 20}"), (102, ""), (103, None), (None, "w1 w2"), (104, "w1"), (104, "w1"), rows[3]]
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in katz.score(documents(spark, other, extra=True), documents(spark, rows)).collect()), key=repr)
    want = sorted(((r[0], max(0, len(line) - 2), s) for r, line, s in zip(other, lines(other), Textbook(rows).score(other), strict=True)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


def test_score_under_an_empty_model(spark):
    got = katz.score(documents(spark, [(1, "a b"), (2, "")]), documents(spark, [(1, None), (2, " ")])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.log_prob) for r in got) == [(1, 3, 0.0), (2, 0, 0.0)]
