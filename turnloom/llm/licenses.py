"""License scans with a positional index of rare words.

Templates are notices and whole short licenses, as runs of words.  The inverse document frequency of every template
word comes from all documents.  A template's postings are its rarest words, the rarest of each
mandatory phrase among them, with their positions.  A file's own rare words are looked up, and
postings that put a template at the same place, give or take inserted words, are one candidate;
a candidate counts if all mandatory phrases stand where the template has them, and enough of its
words do.  Files without rare licence words, nearly all, cost one look-up a word.

Words are runs of ASCII letters and digits, in lower case.

Defined results
  null or empty text: no match; null doc_id: scanned, null in the result
  repeated rows: each reported; several notices in a file: each reported
  ties: of overlapping candidates the one with more matched words stays, then the higher share,
    then the license that sorts first
  empty table: no rows; extra columns: ignored; very long texts: scanned whole
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEXTS
from .textbatch import alnum_words, slices

#: (license, notice, mandatory phrases)
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "released under the MIT License", ("mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "obtaining a copy of this software")),
    ("MIT", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3 0",)),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms", "with or without modification")),
    ("BSD", "released under the BSD License", ("bsd license",)),
    ("BSD", "SPDX-License-Identifier: BSD", ("spdx license identifier bsd",)),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose", "with or without fee")),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("CC-BY-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    *TEXTS,
)
#: Rare words of a template in the index, words that may be inserted, and the share of words needed.
POSTING_WORDS, SLACK, LEAST_SHARE = 4, 4, 0.6


def split(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"[^\x00-\x7f]", " ", text).lower())


@dataclass
class Template:
    license: str
    words: list[str]
    phrases: list[tuple[int, list[str]]]


def compile_templates(templates: Sequence[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> list[Template]:
    out = []
    for license_, notice, phrases in templates:
        words = split(notice)
        placed = []
        for p in map(split, phrases):
            at = next((i for i in range(len(words)) if words[i : i + len(p)] == p), None)
            if at is None:
                raise ValueError(f"{' '.join(p)!r} is no phrase of the notice")
            placed.append((at, p))
        out.append(Template(license_, words, placed))
    return out


def _word_table(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words, and the words' places."""
    h = np.concatenate([alnum_words(pa.array([w])).hashes() for w in words]) if words else np.zeros(0, np.uint64)
    order = np.argsort(h)
    return h[order], order


def _find(h: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted table, or -1."""
    if not len(table_) or not len(h):
        return np.full(len(h), -1)
    # a bit for each low 16 bits rules most words out
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(table_ & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(h), -1)
    some = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.uint16)])
    at = np.minimum(np.searchsorted(table_, h[some]), len(table_) - 1)
    hit = table_[at] == h[some]
    out[some[hit]] = at[hit]
    return out


def document_frequency(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many of all documents each word occurs."""
    table_, order = _word_table(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = alnum_words(part.column(0))
                place = _find(w.hashes(), table_)
                hit = np.flatnonzero(place >= 0)
                pair = np.unique(w.row_of()[hit] * len(vocabulary) + order[place[hit]])
                total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int64()), pa.array(total)], names=["word", "n"])

    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {vocabulary[r.word]: int(r.n) for r in rows}
    return {w: found.get(w, 0) for w in vocabulary}


def rare_postings(templates: list[Template], frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word: (template, position) of each template's rarest words."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        rarest = sorted(set(t.words), key=lambda w: (frequency[w], w))[:POSTING_WORDS]
        chosen = set(rarest) | {min(p, key=lambda w: (frequency[w], w)) for _, p in t.phrases}
        for i, w in enumerate(t.words):
            if w in chosen:
                out.setdefault(w, []).append((k, i))
    return out


def verify(words: list[str], t: Template, start: int) -> tuple[int, int, int] | None:
    """(matched words, first, last) of the template put at ``start``, or None without a phrase."""
    first, last = None, None
    for at, p in t.phrases:
        near = sorted(range(max(0, start + at - SLACK), start + at + SLACK + 1), key=lambda i: (abs(i - start - at), i))
        place = next((i for i in near if words[i : i + len(p)] == p), None)
        if place is None:
            return None
        first = place if first is None else min(first, place)
        last = place + len(p) if last is None else max(last, place + len(p))
    matched, at = 0, max(0, start - SLACK)
    for k, w in enumerate(t.words):
        window = range(at, max(at, start + k + SLACK + 1))
        place = next((i for i in window if i < len(words) and words[i] == w), None)
        if place is not None:
            matched, at = matched + 1, place + 1
            first, last = min(first, place), max(last, place + 1)
    return (matched, first, last) if matched >= LEAST_SHARE * len(t.words) else None


def resolve(found: list[tuple]) -> list[tuple]:
    """Of (license, first, last, matched, share) those that no better one overlaps."""
    kept: list[tuple] = []
    for f in sorted(set(found), key=lambda f: (-f[3], -f[4], f[0], f[1], f[2])):
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """doc_id, license, first_word, n_words, matched_words and share of each notice found."""
    compiled = compile_templates(templates)
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    frequency = document_frequency(docs, sorted({w for t in compiled for w in t.words}))
    postings = rare_postings(compiled, frequency)
    rare = sorted(postings)
    table_, order = _word_table(rare)
    names = ["doc_id", "license", "first_word", "n_words", "matched_words", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = alnum_words(part.column(1))
                place = _find(w.hashes(), table_)
                hit = np.flatnonzero(place >= 0)
                row = np.searchsorted(w.first, hit, side="right") - 1
                out = []
                for r in np.unique(row).tolist():
                    mine = row == r
                    votes: dict[tuple[int, int], set[int]] = {}
                    for at, p in zip((hit[mine] - w.first[r]).tolist(), order[place[hit[mine]]].tolist(), strict=True):
                        for k, i in postings[rare[p]]:
                            votes.setdefault((k, at - i), set()).add(p)
                    words = None
                    found = []
                    for (k, start), have in votes.items():
                        t = compiled[k]
                        # the rarest word of each phrase must be near, here or at a start within the slack
                        near = set().union(*(votes.get((k, s), ()) for s in range(start - SLACK, start + SLACK + 1))) | have
                        if len(near) < len({min(p, key=lambda x: (frequency[x], x)) for _, p in t.phrases}):
                            continue
                        words = words or split(part.column(1)[r].as_py())
                        if (v := verify(words, t, start)) is not None:
                            found.append((t.license, v[1], v[2], v[0], round(v[0] / len(t.words), 6)))
                    out += [(part.column(0)[r].as_py(), f[0], f[1], f[2] - f[1], f[3], f[4]) for f in resolve(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    return docs.mapInArrow(run, "doc_id bigint, license string, first_word bigint, n_words bigint, matched_words bigint, share double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
