from __future__ import annotations

import random

import corpus_pipeline
from turnloom.llm import language_id, ngram_join, suffix_dedup

from .helpers import documents, prose
from .test_ngram_join import brute as brute_pairs
from .test_suffix_dedup import brute as brute_spans
from .test_suffix_dedup import split

SYLLABLES = {"en": ["ba", "do", "ri", "ne", "so", "ta"], "fr": ["oua", "eux", "igne", "tion", "elle"]}


def word(rng: random.Random, lang: str) -> str:
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5)))


def corpus(rng: random.Random) -> list[tuple]:
    """Clean texts, junk, copies, near copies, and a passage of 60 words in several."""
    text = lambda n, lang="en": " ".join(word(rng, lang) for _ in range(n))
    passage = text(60)
    rows = [(k, text(rng.randrange(60, 150), "en" if k % 2 else "fr"), "en" if k % 2 else "fr", f"src{k % 3}") for k in range(60)]
    rows += [(100 + k, f"{text(70)} {passage} {text(70)}", "en", "src0") for k in range(4)]
    rows += [(200 + k, rows[k][1], rows[k][2], "src1") for k in range(5)]
    rows += [(300 + k, rows[k + 10][1] + " " + text(4), rows[k + 10][2], "src2") for k in range(5)]
    rows += [(400 + k, "#### 1234 %%%% 98 ==== 000" * 5, "en", "src0") for k in range(4)]
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus(random.Random(1))
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"]

    kept = stages["language ID"](spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in rows if r[0] < 400}

    rows = [r for r in rows if r[0] in ids]
    kept = stages["n-gram Jaccard join"](spark, documents(spark, rows), "")
    gone = {b for _, b in brute_pairs([r[:2] for r in rows])}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in rows} - gone and not ids & {200, 204, 300, 304}

    rows = [r for r in rows if r[0] in ids]
    kept = stages["suffix-array dedup"](spark, documents(spark, rows), "")
    cut: dict[int, set[int]] = {}
    for d, s, n, dup in brute_spans([r[:2] for r in rows], suffix_dedup.LEAST):
        if dup:
            cut.setdefault(d, set()).update(range(s, s + n))
    assert set(cut) == {101, 102, 103}
    left = {r.doc_id: r for r in kept.collect()}
    for d, t, *_ in rows:
        assert split(left[d].text) == [w for i, w in enumerate(split(t)) if i not in cut.get(d, ())]

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in left.values()]
    mixed = stages["mixing sources to target weights"](spark, documents(spark, rows), "")
    assert mixed.columns == docs.columns
    pieces = mixed.collect()
    text = {r[0]: r[1] for r in rows}
    assert all(p.text in text[p.doc_id] for p in pieces)

    bins = stages["best-fit packing"](spark, mixed, "").collect()
    assert sum(r.used for r in bins) == sum(len(split(p.text)) for p in pieces)
    assert all(r.used <= 2048 for r in bins)


def test_run_over_the_small_table(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.used == sum(r.lengths) for r in rows)


def test_stages_take_empty_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_modules_are_those_of_the_queries():
    assert language_id.UNKNOWN == "und" and ngram_join.N == 5 and prose(random.Random(1), 2).count(" ") == 1
