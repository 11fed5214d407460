from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from turnloom.llm import suffix_dedup
from turnloom.llm.suffix_array import suffix_array

from .helpers import awkward, documents, prose

LEAST = 12


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_long_repeats():
    rng = random.Random(1)
    for text in ([0] * 500, [0, 1] * 300, list(range(300)), [1, 0, 0] * 200 + [0], [rng.randrange(2) for _ in range(2000)]):
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def split(text: str | None) -> list[str]:
    return [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]


def brute(rows: list[tuple], least: int) -> list[tuple]:
    """(doc_id, start, words, duplicate) spans of repeated windows."""
    units = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None})
    seen: dict[tuple, list[tuple]] = {}
    for d, t in units:
        w = split(t)
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i, t))
    cover: dict[tuple, dict[int, bool]] = {}
    for places in seen.values():
        if len(places) > 1:
            original = min(places)
            for d, i, t in places:
                for p in range(i, i + least):
                    marks = cover.setdefault((d, t), {})
                    marks[p] = marks.get(p, False) or (d, i, t) != original
    out = []
    for (d, t), marks in cover.items():
        run: list[int] = []
        for p in [*sorted(marks), None]:
            if run and (p != run[-1] + 1 or marks[p] != marks[run[-1]]):
                out.append((d, run[0], len(run), marks[run[0]]))
                run = []
            run.append(p)
    return out


def spans(df) -> list[tuple]:
    return sorted((r.doc_id, r.start_word, r.n_words, r.duplicate) for r in df.collect())


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [prose(rng, rng.randrange(LEAST - 3, 60)) for _ in range(6)]
    rows = []
    for d in range(40):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared).split(" ")
            lo = rng.randrange(max(1, len(s) - LEAST))
            parts += [" ".join(s[lo:]), prose(rng, rng.randrange(0, 30))]
        rows.append((d, " ".join(p for p in parts if p)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = spans(suffix_dedup.repeated_spans(documents(spark, rows, extra=seed == 1), LEAST, 5))
    assert got == sorted(brute(rows, LEAST))


@pytest.mark.parametrize("sort_words", [0, 150])
def test_hot_groups_are_split(spark, sort_words):
    # a third of the documents share a passage and go on differently; some groups or all are split by window
    rng = random.Random(8)
    passage = prose(rng, 40)
    rows = [*corpus(9), *[(100 + d, f"{prose(rng, 5)} {passage} {prose(rng, rng.randrange(1, 9))}") for d in range(20)], (200, "a b " * 40), (201, "a b " * 30 + "c")]
    docs = documents(spark, rows)
    found = suffix_dedup._occurrences(suffix_dedup._ids(docs), LEAST, 5)
    assert suffix_dedup._hot_anchors(found, LEAST, sort_words).count() > 0
    got = spans(suffix_dedup.repeated_spans(docs, LEAST, 5, sort_words))
    assert got == sorted(brute(rows, LEAST))


def test_periodic_text(spark):
    rows = [(1, "a b " * 60), (2, "a b " * 20 + "c"), (3, "z " * 200)]
    assert spans(suffix_dedup.repeated_spans(documents(spark, rows), LEAST, 5)) == sorted(brute(rows, LEAST))


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [*awkward(rng), (20, prose(rng, 60, 5))]
    docs = documents(spark, rows, extra=True)
    assert spans(suffix_dedup.repeated_spans(docs, LEAST, 5)) == sorted(brute(rows, LEAST))
    kept = suffix_dedup.remove_duplicates(docs, LEAST, 5)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert (4, rows[5][1]) in texts
    assert not [t for t in texts if t[0] == 5]
    assert [t for t in texts if t[0] in (None, 1, 2, 3)] == sorted([(r[0], r[1]) for r in rows if r[0] in (None, 1, 2, 3)], key=repr)


def test_same_id_other_text(spark):
    rng = random.Random(5)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (1, b + " " + a), (2, b)]
    assert spans(suffix_dedup.repeated_spans(documents(spark, rows), LEAST, 5)) == sorted(brute(rows, LEAST))


def test_removed_text_is_the_rest(spark):
    rows = corpus(7)
    got = {r.doc_id: r for r in suffix_dedup.remove_duplicates(documents(spark, rows), LEAST, 5).collect()}
    gone: dict[int, set[int]] = {}
    for d, s, n, dup in brute(rows, LEAST):
        if dup:
            gone.setdefault(d, set()).update(range(s, s + n))
    for d, text in rows:
        left = [w for i, w in enumerate(split(text)) if i not in gone.get(d, ())]
        if d in gone and not left:
            assert d not in got
        else:
            assert split(got[d].text) == left
            assert got[d].n_chars == len(got[d].text)


def test_empty_table(spark):
    assert suffix_dedup.repeated_spans(documents(spark, [])).count() == 0
    assert suffix_dedup.remove_duplicates(documents(spark, [])).count() == 0


def test_anchors_cover_every_window():
    import pyarrow as pa
    from turnloom.llm.textbatch import words

    w = words(pa.array(["a b c d e f g h i j k l m n", "x", "", "a b c d e f g h"]))
    _, _, row, start, count = suffix_dedup._anchors(w, w.hashes(), 8, 3)
    windows = sorted((r, p) for r, s, c in zip(row, start, count, strict=True) for p in range(s, s + c))
    assert windows == [(0, p) for p in range(7)] + [(3, 0)]
    assert np.all(count > 0)
