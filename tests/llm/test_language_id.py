from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from turnloom.llm import language_id as L

from .helpers import awkward, documents

SYLLABLES = {"aa": ["ba", "do", "ri", "ne"], "bb": ["ück", "schl", "ach", "ent"], "cc": ["oua", "eux", "igne", "tion"]}


def corpus(rng: random.Random, n: int) -> list[tuple]:
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(5, 60)))
        rows.append((k, text, lang, "web"))
    return rows


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    model = L.train(documents(spark, corpus(rng, 150)))
    fresh = corpus(rng, 200)
    got = {r.doc_id: r.language for r in L.identify(documents(spark, fresh, extra=True), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, _ in fresh]) > 0.98


def test_popcounts_equal_brute_force(spark):
    """With exact sets instead of filters the corrected shares differ by the false positives' noise only."""
    rng = random.Random(2)
    rows = corpus(rng, 60)
    model = L.train(documents(spark, rows))
    sets: dict[str, dict[bytes, int]] = {}
    size: dict[str, int] = {}
    for _, text, lang, _ in rows:
        keys, _ = L._ngrams(pa.array([text]))
        size[lang] = size.get(lang, 0) + 1
        for k in set(keys.tolist()):
            sets.setdefault(lang, {})[k] = sets.setdefault(lang, {}).get(k, 0) + 1
    for r in L.identify(documents(spark, rows), model).collect():
        keys = L._ngrams(pa.array([rows[r.doc_id][1]]))[0].tolist()
        share = {}
        for lang in sets:
            least = L.LEAST_ROWS * size[lang]
            share[lang] = sum(sets[lang].get(k, 0) >= least for k in keys) / len(keys)
        assert abs(max(share.values()) - r.share) < 0.05
        assert r.n_grams == len(keys)


def test_ngrams_are_those_of_the_padded_text():
    got, bounds = L._ngrams(pa.array(["Ab, c", "", None, "x"]))
    text = [int.from_bytes(w, "little") for w in (b" ab ", b"ab c", b"b c ")]
    assert got.tolist() == text
    assert bounds.tolist() == [0, 3, 3, 3, 3]


def test_awkward_rows(spark):
    rng = random.Random(3)
    model = L.train(documents(spark, corpus(rng, 60)))
    rows = awkward(rng)
    docs = documents(spark, rows, extra=True)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.language for r in got if r.doc_id in (1, 2, 3)} == {L.UNKNOWN}
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("text is null or trim(text) = ''").count() == 0


def test_no_labels_and_empty_table(spark):
    assert L.identify(documents(spark, []), L.train(documents(spark, []))).count() == 0
    rows = [(1, "some text here", None, None), (2, None, None, None)]
    model = L.train(documents(spark, rows))
    assert [r.language for r in L.identify(documents(spark, rows), model).collect()] == [L.UNKNOWN] * 2


def test_filter_keeps_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = L.keep_identified(docs, L.train(docs))
    assert kept.count() >= 0.9 * docs.count()


def test_tie_goes_to_the_first_language(spark):
    rows = [(k, "same words here again", lang, "web") for k, lang in enumerate(["bb", "aa"])]
    model = L.train(documents(spark, rows))
    assert {r.language for r in L.identify(documents(spark, rows), model).collect()} == {"aa"}


def test_more_languages_than_a_mask_has_bits(spark):
    rng = random.Random(9)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(70)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    model = L.train(documents(spark, [(k, text(lang), lang, "web") for k, lang in enumerate(sorted(words) * 3)]))
    assert len(model.languages) == 70 and len(model.masks) == 2
    fresh = [(k, text(lang), lang, "web") for k, lang in enumerate(sorted(words))]
    got = {r.doc_id: r.language for r in L.identify(documents(spark, fresh), model).collect()}
    assert [got[k] for k, *_ in fresh] == sorted(words)


def test_one_more_labelled_row_changes_little(spark):
    """Short texts of a language of 19, 20 and 21 labelled rows are told as well each time."""
    rng = random.Random(10)
    text = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, text("bb", 5), "bb", "web") for k in range(21)] + [(100 + k, text("aa", 30), "aa", "web") for k in range(60)]
    fresh = documents(spark, [(k, text("bb", 5)) for k in range(100)])
    for n in (19, 20, 21):
        model = L.train(documents(spark, [r for r in rows if r[0] < n or r[0] >= 100]))
        assert L.identify(fresh, model).where("language = 'bb'").count() >= 97

