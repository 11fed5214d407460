"""Keyed draws: the same key gives the same number, in any partitioning and on any run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column | str) -> Column:
    """A number strictly between 0 and 1 from the seed and the key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + 0.5) / float(1 << 32)


def uniform_sql(seed: int, *key: str) -> str:
    """The same number as DuckDB SQL."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"((CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8)) AS UBIGINT) + 0.5) / 4294967296.0)"


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * float(high - low)


def exponential(u: Column, beta: float) -> Column:
    """An exponential draw of mean beta."""
    return F.log(u) * -float(beta)


def pick(u: Column, n: Column) -> Column:
    """An index from 0 to n-1."""
    return F.least(F.floor(u * n), n - 1).cast("bigint")


def categorical(u: Column, probabilities: list[float]) -> Column:
    """Index of the first class whose cumulative probability exceeds u."""
    total, out = 0.0, F.lit(0)
    for p in probabilities[:-1]:
        total = round(total + p, 12)
        out = out + (u >= total).cast("int")
    return out
