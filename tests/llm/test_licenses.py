from __future__ import annotations

import random

import pytest
from turnloom.llm import licenses as L

from .helpers import awkward, documents, prose


def planted(seed: int) -> tuple[list[tuple], dict[int, tuple[str, int]]]:
    """Texts with one notice each at a random place, and half as many without."""
    rng = random.Random(seed)
    rows, where = [], {}
    for k, (name, notice, _) in enumerate(L.TEMPLATES):
        before, after = prose(rng, rng.randrange(50)), prose(rng, rng.randrange(50))
        rows.append((k, f"{before} {notice}. {after}"))
        where[k] = (name, len(before.split()))
    return rows + [(1000 + k, prose(rng, 60) + " license version permission granted software") for k in range(10)], where


def test_planted_notices_are_found_in_place(spark):
    rows, where = planted(1)
    got = {r.doc_id: r for r in L.scan(documents(spark, rows, extra=True)).collect()}
    assert {d: (r.license, r.first_word) for d, r in got.items()} == where
    assert all(r.share == 1 for r in got.values())


def test_case_punctuation_and_line_breaks_do_not_matter(spark):
    text = "/*\n * Released   under\n * the MIT\n * license!\n */"
    assert [r.license for r in L.scan(documents(spark, [(1, text)])).collect()] == ["MIT"]


def test_mandatory_phrases_decide(spark):
    rows = [(1, "licensed under the GNU General Public License, version 2"), (2, "licensed under the GNU General Public License, version 3"), (3, "licensed under the Apache License, Version 1.1"), (4, "GNU Lesser General Public License, version 3")]
    assert sorted((r.doc_id, r.license) for r in L.scan(documents(spark, rows)).collect()) == [(2, "GPL-3.0"), (4, "LGPL-3.0")]


def test_inserted_words_within_the_slack(spark):
    rows = [(1, "licensed under the terms of the Apache License, Version 2.0")]
    assert [r.license for r in L.scan(documents(spark, rows)).collect()] == ["Apache-2.0"]


def test_several_notices_and_repeated_rows(spark):
    both = "Released under the MIT License. " + "filler " * 30 + "Licensed under CC BY-SA 4.0."
    got = L.scan(documents(spark, [(1, both), (1, both), (None, both)])).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == sorted([("1", "MIT"), ("1", "CC-BY-SA-4.0")] * 2 + [("None", "MIT"), ("None", "CC-BY-SA-4.0")])


def test_awkward_rows(spark):
    assert L.scan(documents(spark, awkward(random.Random(2)), extra=True)).count() == 0
    assert L.scan(documents(spark, [])).count() == 0


def test_equal_to_a_search_of_every_start(spark, small):
    """Brute force: every template at every word of every document, without an index."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    compiled = L.compile_templates()
    want = set()
    for r in docs.collect():
        words = L.split(r.text or "")
        found = []
        anchors = {t.phrases[0][1][0] for t in compiled}
        if not anchors & set(words):
            continue
        for t in compiled:
            at, phrase = t.phrases[0]
            for i in range(len(words)):
                if words[i : i + len(phrase)] == phrase:
                    for start in range(i - at - L.SLACK, i - at + L.SLACK + 1):
                        if (v := L.verify(words, t, start)) is not None:
                            found.append((t.license, v[1], v[2], v[0], round(v[0] / len(t.words), 6)))
        want |= {(r.doc_id, f[0]) for f in L.resolve(found)}
    got = {(r.doc_id, r.license) for r in L.scan(docs).collect()}
    assert got == want and got


def test_frequency_and_postings(spark):
    rows = [(1, "mit mit license"), (2, "license"), (3, None)]
    assert L.document_frequency(documents(spark, rows), ["license", "mit", "zlib"]) == {"license": 2, "mit": 1, "zlib": 0}
    with pytest.raises(ValueError):
        L.compile_templates([("X", "a b c", ("c b",))])


def test_planted_notices_are_found_where_they_stand(spark):
    """Each notice, whole, at a known word among words of no licence; the expected rows come from the planting alone."""
    rng = random.Random(12)
    rows, want = [], []
    for k, (license_, notice, _) in enumerate(L.TEMPLATES):
        for n in (0, 3, 400):
            before, after = " ".join(f"zz{rng.randrange(999)}" for _ in range(n)), " ".join(f"zz{rng.randrange(999)}" for _ in range(n))
            doc = 10 * k + len(str(n))
            rows.append((doc, f"{before} {notice} {after}"))
            size = len("".join(c if c.isalnum() else " " for c in notice).split())
            want.append((doc, license_, n, size, size, 1.0))
    got = [(r.doc_id, r.license, r.first_word, r.n_words, r.matched_words, r.share) for r in L.scan(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_notices_without_a_mandatory_phrase_are_none(spark):
    rows = [(k, " ".join(w for w in L.split(notice) if w not in L.split(phrases[0])[:1])) for k, (_, notice, phrases) in enumerate(L.TEMPLATES)]
    found = {r.doc_id for r in L.scan(documents(spark, rows)).collect()}
    assert not found & {k for k, (_, notice, phrases) in enumerate(L.TEMPLATES) if len(L.split(notice)) > 3 and " ".join(L.split(phrases[0])) not in rows[k][1]}


def test_whole_licenses_are_told_from_their_beginnings(spark):
    """A whole text is one row; one cut short, or with another third clause, is what its words still prove."""
    text = {name: t for name, t, _ in reversed(L.TEXTS)}
    rows = [(1, text["MIT"]), (2, text["MIT"][:150]), (3, text["BSD-3-Clause"]), (4, text["BSD-2-Clause"]), (5, text["BSD-2-Clause"][:200]), (6, text["GPL-2.0"]), (7, text["GPL-3.0"]), (8, text["LGPL-2.1"]), (9, text["Apache-2.0"] + " filler" * 50 + " " + text["ISC"])]
    got = sorted((r.doc_id, r.license, r.n_words) for r in L.scan(documents(spark, rows)).collect())
    size = {name: len(L.split(t)) for name, t in text.items()}
    assert [(d, name) for d, name, _ in got] == [(1, "MIT"), (2, "MIT"), (3, "BSD-3-Clause"), (4, "BSD-2-Clause"), (5, "BSD"), (6, "GPL-2.0"), (7, "GPL-3.0"), (8, "LGPL-2.1"), (9, "Apache-2.0"), (9, "ISC")]
    assert {d: n for d, _, n in got if d in (1, 3, 4, 6)} == {1: size["MIT"], 3: size["BSD-3-Clause"], 4: size["BSD-2-Clause"], 6: size["GPL-2.0"]}
