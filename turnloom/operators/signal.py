"""Signals as arrays of doubles, with the array functions of the JVM; chunk longer ones first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def dc_remove(x: Column) -> Column:
    # an array of one keeps the mean from being computed for each sample
    return F.flatten(F.transform(F.array(total(x) / F.size(x)), lambda m: F.transform(x, lambda v: v - m)))


def scale(x: Column, gain: Column) -> Column:
    return F.flatten(F.transform(F.array(gain), lambda g: F.transform(x, lambda v: v * g)))


def gain_to(x: Column, level_db: Column | float) -> Column:
    """Gain that brings the signal to a level; 1e-8 for silence, which stays as it is."""
    level = level_db if isinstance(level_db, Column) else F.lit(float(level_db))
    return F.when(rms(x) > 0, F.pow(F.lit(10.0), level / 20) / rms(x)).otherwise(1e-8)


def normalize(x: Column, level_db: Column | float) -> Column:
    return F.when(rms(x) > 0, scale(x, gain_to(x, level_db))).otherwise(x)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def peak_guard(x: Column, limit: float = 0.99) -> Column:
    return F.when(peak(x) > limit, scale(x, F.lit(limit) / peak(x))).otherwise(x)


def fir_highpass(cutoff_hz: float = 40.0, taps: int = 63, rate: int = 16000) -> list[float]:
    """Windowed-sinc low pass with a Hamming window, unit gain at zero, inverted to a high pass."""
    fc, mid = cutoff_hz / (rate / 2), (taps - 1) / 2
    low = []
    for n in range(taps):
        k = n - mid
        sinc = fc if k == 0 else math.sin(math.pi * fc * k) / (math.pi * k)
        low.append(sinc * (0.54 - 0.46 * math.cos(2 * math.pi * n / (taps - 1))))
    gain = sum(low)
    high = [-v / gain for v in low]
    high[int(mid)] += 1.0
    return high


def convolve(x: Column, taps: list[float]) -> Column:
    """Full convolution: size(x) + len(taps) - 1 samples."""
    zeros = F.array_repeat(F.lit(0.0), len(taps) - 1)
    padded = F.concat(zeros, x, zeros)
    h = F.array(*[F.lit(float(t)) for t in reversed(taps)])
    window = lambda i: F.aggregate(F.zip_with(F.slice(padded, i, len(taps)), h, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(1), F.size(x) + len(taps) - 1), window)


def trim_to_direct_path(h: Column) -> Column:
    """An impulse response from its largest absolute value on."""
    at = F.array_position(F.transform(h, lambda v: F.abs(v)), peak(h)).cast("int")
    return F.slice(h, at, F.size(h) - at + 1)


def fit_length(x: Column, n: Column | int) -> Column:
    """Cut or padded with zeros to n samples."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n)


def fade(k: Column, n: Column, rising: bool) -> Column:
    c = F.cos(F.lit(math.pi) * k / n)
    return (1 - c) / 2 if rising else (1 + c) / 2


def crossfade(a: Column, b: Column, samples: int) -> Column:
    """a then b with a cosine cross-fade of at most ``samples``, a quarter of b, and a; complete at every length."""
    k = F.least(F.lit(samples), F.floor(F.size(b) / 4).cast("int"), F.size(a))
    head = F.slice(a, F.lit(1), F.size(a) - k)
    left = F.transform(F.slice(a, F.size(a) - k + 1, k), lambda v, i: v * fade(i, k, False))
    right = F.transform(F.slice(b, F.lit(1), k), lambda v, i: v * fade(i, k, True))
    return F.when(k > 0, F.concat(head, F.zip_with(left, right, lambda p, q: p + q), F.slice(b, k + 1, F.size(b) - k))).otherwise(F.concat(a, b))


def repeat_to(x: Column, length: int, samples: int, repeats: int) -> Column:
    """x repeated with cross-fades, as ``crossfade`` makes them, up to a length; ``repeats`` copies must suffice.

    A sample's place within its copy says what it is made of, so that no copy is built on the one before.
    """
    k = F.least(F.lit(samples), F.floor(F.size(x) / 4).cast("int"))
    period = F.size(x) - k

    def sample(i: Column) -> Column:
        copy, r = F.floor(i / period), F.pmod(i, period).cast("int")
        here, tail = F.get(x, r), F.get(x, (period + r).cast("int"))
        both = tail * fade(r, k, False) + here * fade(r, k, True)
        return F.when(copy >= repeats, tail).when((copy == 0) | (r >= k), here).otherwise(both)

    n = F.least(F.lit(length), (period * repeats + k).cast("int"))
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(x)


def mix(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of signals (keys, offset, x) shifted by their offsets: keys, n_samples, mix.

    Samples meet in a hash aggregation by (keys, sample), which combines before the shuffle.
    """
    at = pieces.select(*keys, "offset", F.posexplode("x").alias("k", "v")).groupBy(*keys, (F.col("offset") + F.col("k")).alias("sample")).agg(F.sum("v").alias("v"))
    got = at.groupBy(*keys).agg(F.max("sample").alias("last"), F.map_from_entries(F.collect_list(F.struct("sample", "v"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return got.select(*keys, (F.col("last") + 1).alias("n_samples"), x.alias("mix"))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.transform(x, lambda v: F.round(v, digits) + 0.0)
