"""Mixtures of whole meetings and their stems, in chunks of samples.

An utterance is cut at chunk borders before it travels, so a task holds chunks and never a
meeting.  All draws are keyed by the meeting, the utterance or the chunk.
"""

from __future__ import annotations

import os
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import between, pick, uniform
from . import sampling, signal
from .audio import lists

CHUNK = 160_000
#: Samples of chunks that leave a task together, besides the last chunk.
SAMPLES = 1 << 20
MIX = "mix"


@dataclass
class RenderConfig:
    """How timelines become sound."""

    seed: int = 7
    rate: int = 16000
    base_gain: tuple[float, float] = (-35.0, -8.0)
    rel_gain: tuple[float, float] = (-12.0, 5.0)
    fir: bool = False
    reverb_prob: float = 0.0
    noise_prob: float = 0.0
    #: Of noise files and of Gaussian noise, against the least level of a meeting's utterances.
    noise_gain: tuple[float, float] = (-20.0, -3.0)
    gauss_gain: tuple[float, float] = (-30.0, 3.0)
    fade_s: float = 0.5
    speakers: bool = False
    anechoic: bool = False
    chunk: int = CHUNK


def pieces(timeline: DataFrame, signals: DataFrame, rate: int = 16000) -> DataFrame:
    """meeting, speaker, offset (samples) and x at its level, from utterances (cut_id, start_us, level_db) and signals (cut_id, x)."""
    offset = F.floor(F.col("start_us") * rate / 1_000_000)
    return timeline.join(signals, "cut_id").select("meeting", "speaker", offset.alias("offset"), signal.normalize(signal.dc_remove(F.col("x")), F.col("level_db")).alias("x"))


def mix_chunks(parts: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """keys, chunk, x: the sum of the pieces in each chunk that any of them touches."""
    last = F.floor((F.col("offset") + F.size("x") - 1) / chunk)
    at = parts.where("size(x) > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("offset") / chunk), last)))
    low = F.greatest(F.col("chunk") * chunk - F.col("offset"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * chunk - F.col("offset"), F.size("x"))
    cut = at.select(*keys, "chunk", (F.greatest("offset", F.col("chunk") * chunk) - F.col("chunk") * chunk).alias("place"), F.slice("x", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, whole, size = None, np.zeros(0), [], 0
        kinds: list[pa.DataType] = []

        def take() -> pa.RecordBatch:
            names = [pa.array(c, k) for c, k in zip(zip(*(k for k, _ in whole), strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*names, lists([x for _, x in whole])], names=[*keys, "chunk", "x"])

        for b in batches:
            kinds = [b.schema.field(k).type for k in (*keys, "chunk")]
            column = b.column(b.schema.get_field_index("x"))
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            own = zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in (*keys, "chunk")), strict=True)
            for k, place, a, z in zip(own, b.column(b.schema.get_field_index("place")).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if k != key:
                    if key is not None:
                        whole.append((key, out))
                        size += len(out)
                        if size >= SAMPLES:
                            yield take()
                            whole, size = [], 0
                    key, out = k, np.zeros(0)
                if place + z - a > len(out):
                    out = np.concatenate((out, np.zeros(place + z - a - len(out))))
                out[place : place + z - a] += values[a:z]
        if key is not None:
            whole.append((key, out))
            yield take()

    fields = ", ".join(f"{k} {dict(parts.dtypes)[k]}" for k in keys)
    # one chunk after another, in batches of many
    return cut.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "place").mapInArrow(add, f"{fields}, chunk bigint, x array<double>")


def guard(chunks: DataFrame, key: str, limit: float = 0.99) -> DataFrame:
    """Chunks scaled so that no meeting's peak is above the limit; meetings below it stay."""
    peaks = chunks.groupBy(key).agg(F.max(signal.peak(F.col("x"))).alias("peak"))
    gain = F.when(F.col("peak") > limit, limit / F.col("peak")).otherwise(1.0)
    return chunks.join(peaks, key).withColumn("x", signal.scale(F.col("x"), gain)).drop("peak")


def loudness(chunks: DataFrame, key: str) -> DataFrame:
    """Samples, peak and RMS of each meeting, from its chunks."""
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    g = chunks.groupBy(key).agg(F.sum(F.size("x")).alias("n"), F.max(signal.peak(F.col("x"))).alias("peak"), F.sum(square).alias("square"))
    return g.select(key, "n", "peak", F.sqrt(F.col("square") / F.col("n")).alias("rms"))


def _level(x: np.ndarray, level_db: float) -> float:
    r = float(np.sqrt(np.mean(x**2))) if len(x) else 0.0
    return 10 ** (level_db / 20) / r if r else 1.0


def voices(timeline: DataFrame, signals: DataFrame, c: RenderConfig, responses: DataFrame | None = None) -> DataFrame:
    """meeting, stem, offset and x: each utterance at its level, for the mixture and for the stems asked for.

    A reverberated meeting has one room, and each utterance one of its positions (room_id, position,
    ir, anechoic); responses begin with their direct path.  Anechoic stems take the gain of the wet
    signal and its length.
    """
    offset = F.floor(F.col("start_us") * c.rate / 1_000_000)
    level = sampling.level(c.seed, c.base_gain, c.rel_gain).alias("level_db")
    u = timeline.where("meeting IS NOT NULL AND step IS NOT NULL").select("meeting", "step", F.col("speaker").cast("string").alias("speaker"), "cut_id", offset.alias("offset"), level)
    u = u.join(signals.select("cut_id", "x"), "cut_id")
    if responses is not None and c.reverb_prob > 0:
        # rooms and positions by their place in order, so that the draws don't depend on the names
        place = F.row_number().over(Window.partitionBy("room_id").orderBy("position")) - 1
        placed = responses.select("room_id", place.alias("place"), "ir", "anechoic")
        rooms = responses.select("room_id").distinct().withColumn("room", F.row_number().over(Window.orderBy("room_id")) - 1)
        rooms = rooms.join(responses.groupBy("room_id").agg(F.count("*").alias("places")), "room_id")
        n = rooms.count()
        wet = uniform(c.seed, "meeting", F.lit("reverb")) < c.reverb_prob
        u = u.withColumn("room", F.when(wet, pick(uniform(c.seed, "meeting", F.lit("room")), F.lit(n)))).join(rooms, "room", "left")
        u = u.withColumn("place", pick(uniform(c.seed, "meeting", "step", F.lit("position")), F.col("places"))).join(placed, ["room_id", "place"], "left")
    else:
        u = u.withColumn("ir", F.lit(None).cast("array<double>")).withColumn("anechoic", F.lit(None).cast("array<double>"))
    taps = np.array(signal.fir_highpass(rate=c.rate)) if c.fir else None

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                x = np.asarray(r.x, dtype=float)
                if not len(x):
                    continue
                x = x - x.mean()
                x = x if taps is None else np.convolve(x, taps)
                dry = x
                if r.ir is not None:
                    h, direct = np.asarray(r.ir), np.asarray(r.anechoic)
                    x = _convolve(x, h[int(np.abs(h).argmax()) :])
                    dry = _convolve(dry, direct[int(np.abs(direct).argmax()) :])[: len(x)]
                    dry = np.pad(dry, (0, len(x) - len(dry)))
                gain = _level(x, r.level_db)
                rows.append((r.meeting, MIX, r.offset, x * gain))
                if c.speakers:
                    rows.append((r.meeting, f"spk-{r.speaker}", r.offset, x * gain))
                    if c.anechoic:
                        rows.append((r.meeting, f"spk-{r.speaker}-anechoic", r.offset, dry * gain))
                if len(rows) >= 64:
                    yield pd.DataFrame(rows, columns=["meeting", "stem", "offset", "x"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["meeting", "stem", "offset", "x"])

    columns = ["meeting", "speaker", "offset", "level_db", "x", "ir", "anechoic"]
    return u.select(*columns).mapInPandas(sound, "meeting bigint, stem string, offset bigint, x array<double>")


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution; by Fourier transforms where both are long."""
    n = len(x) + len(h) - 1
    if min(len(x), len(h)) < 64:
        return np.convolve(x, h)
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def noisy(chunks: DataFrame, timeline: DataFrame, c: RenderConfig, files: DataFrame | None = None) -> DataFrame:
    """The mixture's chunks with noise in as many meetings as ``noise_prob`` says: of files (noise_id, x), or Gaussian.

    Its level is a draw from the range of gains above the least level of the meeting's utterances.
    Files are drawn one after another until they fill the meeting, each at one level, with a fade
    into the next.
    """
    least = sampling.levels(timeline, c.seed, c.base_gain, c.rel_gain).groupBy("meeting").agg(F.min("level_db").alias("least"))
    gains = c.gauss_gain if files is None else c.noise_gain
    level = F.col("least") + between(uniform(c.seed, "meeting", F.lit("noise_gain")), *gains)
    chosen = least.select("meeting", level.alias("noise_db")).where(uniform(c.seed, "meeting", F.lit("noise")) < c.noise_prob)
    if files is None:
        def hiss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = [
                    np.asarray(x) if np.isnan(db) else np.asarray(x) + np.random.default_rng([c.seed, m, k]).normal(0, 10 ** (db / 20), len(x))
                    for m, k, x, db in zip(b["meeting"], b["chunk"], b["x"], b["noise_db"], strict=True)
                ]
                yield pd.DataFrame({"meeting": b["meeting"], "stem": b["stem"], "chunk": b["chunk"], "x": x})

        mixed = chunks.where(F.col("stem") == MIX).join(chosen, "meeting", "left")
        return mixed.mapInPandas(hiss, CHUNKS).union(chunks.where(F.col("stem") != MIX).select("meeting", "stem", "chunk", "x"))
    fade = int(c.fade_s * c.rate)
    length = chunks.where(F.col("stem") == MIX).groupBy("meeting").agg(F.max(F.col("chunk") * c.chunk + F.size("x")).alias("n"))
    sizes = [(r.noise_id, r.n) for r in files.where("size(x) > 0").select("noise_id", F.size("x").alias("n")).orderBy("noise_id").collect()]
    if not sizes:
        return chunks

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which part of which file goes where."""
        for b in batches:
            rows = []
            for m, n in zip(b["meeting"], b["n"], strict=True):
                at = k = 0
                while at < n:
                    u = lambda what: sampling._draw(c.seed, m, k, what)  # noqa: B023, E731
                    name, size = sizes[min(int(u("noise_file") * len(sizes)), len(sizes) - 1)]
                    take = min(size, n - at)
                    low = min(int(u("noise_crop") * (size - take + 1)), size - take)
                    into = min(fade, take // 4) if at else 0
                    rows.append((m, name, at - into, low, take, into))
                    at, k = at - into + take, k + 1
            # a part fades out where the next one fades in
            out = pd.DataFrame(rows, columns=["meeting", "noise_id", "offset", "low", "take", "rise"])
            out["fall"] = out.groupby("meeting")["rise"].shift(-1).fillna(0).astype(int)
            yield out

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                x = np.asarray(r.x, dtype=float)[r.low : r.low + r.take]
                x = x * _level(x, 0.0)
                ramp = lambda n: 0.5 * (1 - np.cos(np.pi * np.arange(n) / n))
                if r.rise:
                    x[: r.rise] *= ramp(r.rise)
                if r.fall:
                    x[len(x) - r.fall :] *= 1 - ramp(r.fall)
                rows.append((r.meeting, r.offset, x))
                if len(rows) == 16:
                    yield pd.DataFrame(rows, columns=["meeting", "offset", "x"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["meeting", "offset", "x"])

    planned = length.join(chosen, "meeting").mapInPandas(plan, "meeting bigint, noise_id string, offset bigint, low bigint, take bigint, rise bigint, fall bigint")
    beds = mix_chunks(planned.join(files.select("noise_id", "x"), "noise_id").mapInPandas(part, "meeting bigint, offset bigint, x array<double>"), ["meeting"], c.chunk)
    gain = loudness(beds, "meeting").join(chosen, "meeting").select("meeting", (F.pow(F.lit(10.0), F.col("noise_db") / 20) / F.col("rms")).alias("gain"))
    levelled = beds.join(gain, "meeting").select("meeting", F.lit(MIX).alias("stem"), (F.col("chunk") * c.chunk).alias("offset"), signal.scale(F.col("x"), F.col("gain")).alias("x"))
    own = chunks.where(F.col("stem") == MIX).select("meeting", "stem", (F.col("chunk") * c.chunk).alias("offset"), "x")
    return mix_chunks(own.union(levelled), ["meeting", "stem"], c.chunk).union(chunks.where(F.col("stem") != MIX).select("meeting", "stem", "chunk", "x"))


CHUNKS = "meeting bigint, stem string, chunk bigint, x array<double>"


def meetings(timeline: DataFrame, signals: DataFrame, c: RenderConfig, responses: DataFrame | None = None, noise: DataFrame | None = None) -> DataFrame:
    """meeting, stem, chunk, x: the mixture (stem ``mix``) and stems of each meeting.

    Where the mixture's peak is above 0.99, it and its stems are scaled alike.
    """
    chunks = mix_chunks(voices(timeline, signals, c, responses), ["meeting", "stem"], c.chunk)
    if c.noise_prob > 0:
        chunks = noisy(chunks, timeline, c, noise)
    peaks = chunks.where(F.col("stem") == MIX).groupBy("meeting").agg(F.max(signal.peak(F.col("x"))).alias("peak"))
    gain = F.when(F.col("peak") > 0.99, 0.99 / F.col("peak")).otherwise(1.0)
    return chunks.join(peaks, "meeting").select("meeting", "stem", "chunk", signal.scale(F.col("x"), gain).alias("x"))


def write_meetings(chunks: DataFrame, folder: str, rate: int = 16000, chunk: int = CHUNK) -> DataFrame:
    """meeting, stem, path and n_samples of the WAV files written to a folder that all executors share.

    A file is written chunk after chunk, so that no task holds it, and gets its name when it is whole.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        key = out = path = None
        n = 0

        def close() -> pd.DataFrame:
            out.close()
            os.replace(path + ".part", path)
            return pd.DataFrame([(*key, path, n)], columns=["meeting", "stem", "path", "n_samples"])

        for b in batches:
            for m, stem, k, x in zip(b["meeting"], b["stem"], b["chunk"], b["x"], strict=True):
                if (m, stem) != key:
                    if key is not None:
                        yield close()
                    key, n = (m, stem), 0
                    path = os.path.join(folder, f"meeting_{m}.wav" if stem == MIX else f"meeting_{m}-{stem}.wav")
                    out = wave.open(path + ".part", "wb")
                    out.setnchannels(1)
                    out.setsampwidth(2)
                    out.setframerate(rate)
                # chunks that nothing touches are silent
                x = np.pad(np.asarray(x), (k * chunk - n, 0)) if k * chunk > n else np.asarray(x)
                out.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
                n += len(x)
        if key is not None:
            yield close()

    rows = chunks.select("meeting", "stem", "chunk", "x").repartition("meeting", "stem").sortWithinPartitions("meeting", "stem", "chunk")
    return rows.mapInPandas(write, "meeting bigint, stem string, path string, n_samples bigint")
