from __future__ import annotations

import os
import random

import pytest
from turnloom.llm import token_counts as T

from .helpers import awkward, documents, prose

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="the vocabulary isn't there")


def whole(text: str | None) -> int:
    return len(T._tokenizer(T.VOCABULARY, T.PATTERN)[0].encode_ordinary(text or ""))


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    return [
        prose(rng, 3000),
        "don't stop  \n\n now, I'll see 12345 cats! " * 200,
        " " * 5000 + "end",
        "a" * 4000 + " " + "b" * 3000,
        "漢字かな交じり文。" * 500,
        "🙂🙃 é́ ".join(prose(rng, 5) for _ in range(300)),
        "\n".join("\t" * rng.randrange(6) + prose(rng, 3) for _ in range(800)),
    ]


@pytest.mark.parametrize("overlap", [16, 64])
def test_spliced_counts_equal_whole_encodings(spark, overlap):
    rows = [(k, t) for k, t in enumerate(texts(overlap))]
    got = {r.doc_id: (r.n_tokens, r.n_chunks) for r in T.count_tokens(documents(spark, rows), chunk=512, overlap=overlap).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: whole(t) for k, t in rows}
    assert max(c for _, c in got.values()) > 5


def test_overlaps_widen_where_chunks_do_not_align(spark):
    """One word far longer than the overlap has no boundary to splice at."""
    text = "x" * 3000 + " and more"
    r = T.count_tokens(documents(spark, [(1, text)]), chunk=256, overlap=32).collect()
    assert [(x.n_tokens) for x in r] == [whole(text)]


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    got = T.count_tokens(documents(spark, rows, extra=True), chunk=1024, overlap=64).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, whole(t)) for d, t in rows), key=repr)
    assert T.count_tokens(documents(spark, [])).count() == 0


def test_repeated_long_rows_and_shared_ids(spark):
    long, other = prose(random.Random(2), 2000), prose(random.Random(3), 1500)
    rows = [(1, long), (1, long), (1, other), (None, long), (2, "short")]
    got = T.count_tokens(documents(spark, rows), chunk=512, overlap=64).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, whole(t)) for d, t in rows), key=repr)
