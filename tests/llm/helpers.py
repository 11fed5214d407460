"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that documents don't have, with names that the operators use inside.
CLASHING = "rank int, set bigint, rep bigint, bucket int, body binary, pivot bigint, part bigint, local bigint, key bigint, chunk int, shard int, slot bigint, doc bigint, wanted string, flags binary, __gone bigint, group int, n_tokens bigint"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows: (doc_id, text), with lang and source if given; ``extra`` adds columns with clashing names."""
    full = [(*r, *("en", "web", None)[len(r) - 2 :]) for r in rows]
    full = [(r[0], r[1], r[2], r[3], len(r[1]) if r[1] is not None else None) for r in full]
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    names = CLASHING.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * names) for r in full], f"{SCHEMA}, {CLASHING}")


def vectors(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    schema = "vec_id bigint, embedding array<float>, label int"
    if not extra:
        return spark.createDataFrame([(*r, 0) for r in rows], schema)
    return spark.createDataFrame([(*r, 0, None, None, None, None, None) for r in rows], f"{schema}, v array<double>, shard int, cell int, extra binary, rank int")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls in both columns, empty and blank texts, ties, repeated rows, one very long text."""
    tied = prose(rng, 80)
    return [
        (None, prose(rng, 70)),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, None),
        (4, tied),
        (5, tied),
        (5, tied),
        (6, "one"),
        (7, prose(rng, 30000)),
        (8, "ünïcödé 漢字 " * 40),
        (9, prose(rng, 120)),
    ]
