"""Keyed sampling: speakers, cuts, transitions, levels and rooms.  No draw depends on the partitioning."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import between, categorical, exponential, pick, uniform
from .turns import HOLD, SWITCH

SOUND = 343.0


def n_speakers(seed: int, low: int, high: int, key: str = "meeting") -> Column:
    """How many speakers a meeting has, from low to high."""
    return (pick(uniform(seed, key, F.lit("n")), F.lit(high - low + 1)) + low).cast("bigint")


def speakers(meetings: DataFrame, library: DataFrame, seed: int, low: int, high: int) -> DataFrame:
    """meeting, speaker, rank: speakers without replacement.

    All speakers are one array, sorted by draw within each meeting's row, so nothing is shuffled by meeting.
    """
    every = library.select("speaker").distinct().agg(F.array_sort(F.collect_list("speaker")).alias("every"))
    drawn = F.array_sort(F.transform("every", lambda s: F.struct(uniform(seed, "meeting", s, F.lit("rank")).alias("u"), s.alias("speaker"))))
    n = F.least(n_speakers(seed, low, high), F.size("every").cast("bigint")).cast("int")
    rows = meetings.crossJoin(every).select("meeting", F.posexplode(F.slice(drawn, F.lit(1), n)).alias("rank", "s"))
    return rows.select("meeting", F.col("s.speaker").alias("speaker"), "rank")


def transition(u: Column, prev_type: Column | None, p_ind: list[float], p_markov: list[list[float]] | None = None) -> Column:
    """Type of the next transition; the first one of a meeting (no type before) from p_ind."""
    first = categorical(u, p_ind)
    if p_markov is None or prev_type is None:
        return first
    out = first
    for k, row in enumerate(p_markov):
        out = F.when(prev_type == k, categorical(u, row)).otherwise(out)
    return out


def gap_us(u: Column, kind: Column, betas: tuple[float, ...]) -> Column:
    """Pause of a hold or switch."""
    return F.when(kind == HOLD, F.floor(exponential(u, betas[HOLD]) * 1e6)).when(kind == SWITCH, F.floor(exponential(u, betas[SWITCH]) * 1e6))


def overlap_share(u: Column, beta: float, epsilon: float = 0.03) -> Column:
    """Share of the utterance before that an interruption or backchannel overlaps."""
    return F.least(F.greatest(exponential(u, beta), F.lit(epsilon)), F.lit(1 - epsilon))


def next_speaker(u: Column, chosen: Column, previous: Column) -> Column:
    """One of the chosen but the previous speaker, who goes on if alone."""
    others = F.array_except(chosen, F.array(previous))
    return F.when(F.size(others) > 0, F.element_at(others, (pick(u, F.size(others)) + 1).cast("int"))).otherwise(previous)


def sample_cuts(draws: DataFrame, index: DataFrame, seed: int) -> DataFrame:
    """A cut for each draw (id, speaker) out of a library's cut_index, by position."""
    count = index.groupBy("speaker").agg(F.count("*").alias("n"))
    at = draws.join(count, "speaker").withColumn("pos", pick(uniform(seed, "id", F.lit("cut")), F.col("n")))
    return at.join(index, ["speaker", "pos"]).select("id", "speaker", "pos", "cut_id", "dur_us")


def level(seed: int, base: tuple[float, float], relative: tuple[float, float]) -> Column:
    """Of an utterance (meeting, step): a level a meeting plus one an utterance."""
    b = between(uniform(seed, "meeting", F.lit("base")), *base)
    r = between(uniform(seed, "meeting", "step", F.lit("rel")), *relative)
    return F.round(b + r, 6)


def levels(utterances: DataFrame, seed: int, base: tuple[float, float], relative: tuple[float, float]) -> DataFrame:
    """meeting, step, level_db of utterances."""
    return utterances.select("meeting", "step", level(seed, base, relative).alias("level_db"))


def flags(meetings: DataFrame, seed: int, reverb: float, noise: float) -> DataFrame:
    return meetings.select("meeting", (uniform(seed, "meeting", F.lit("reverb")) < reverb).alias("reverb"), (uniform(seed, "meeting", F.lit("noise")) < noise).alias("noise"))


def perturbed(cuts: DataFrame, seed: int, low: float, high: float) -> DataFrame:
    """cut_id, factor, dur_us and words at another speed; times shrink by the factor."""
    f = F.round(between(uniform(seed, "cut_id", F.lit("speed")), low, high), 6)
    c = cuts.withColumn("factor", f)
    slower = lambda t: F.floor(t / F.col("factor")).cast("bigint")
    words = F.transform("words", lambda w: w.withField("start_us", slower(w["start_us"])).withField("dur_us", slower(w["dur_us"])))
    return c.select("cut_id", "speaker", "factor", slower(F.col("dur_us")).alias("dur_us"), words.alias("words"))


def _absorption(l: float, w: float, z: float, rt60: float) -> float:  # noqa: E741
    """Above one, so short a reverberation isn't possible."""
    return 24 * 2.302585092994046 / SOUND * (l * w * z) / (2 * (l * w + l * z + w * z) * rt60)


def _draw(seed: int, *key: object) -> float:
    """The number that ``uniform`` gives for the key."""
    text = "|".join(str(k) for k in (seed, *key) if k is not None)
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / float(1 << 32)


def rooms(ids: DataFrame, seed: int, size: tuple[float, float] = (5, 10), ceiling: tuple[float, float] = (3, 5), rt60: tuple[float, float] = (0.1, 0.7), delta: float = 0.5, positions: int = 1) -> DataFrame:
    """room_id, position, l, w, z, rt60, absorption, microphone and source: the first feasible attempt of each, with as many sources.

    A source is the first of its draws that is more than a metre from the microphone.
    """
    if _absorption(size[0], size[0] / 2, ceiling[0], rt60[1]) >= 1:
        raise ValueError("no room of this size has so short a reverberation")

    def inside(u: float, high: float) -> float:
        return float(delta) + u * (high - 2 * float(delta))

    def room(key: str | None) -> list[tuple]:
        for a in itertools.count():
            u = lambda what: _draw(seed, key, a, what)  # noqa: B023, E731
            l, z, r = (low + u(k) * float(high - low) for k, (low, high) in (("l", size), ("z", ceiling), ("rt60", rt60)))  # noqa: E741
            w = l / 2 + u("w") * (float(size[1]) - l / 2)
            if _absorption(l, w, z, r) <= 1:
                break
        mic = inside(_draw(seed, key, "mx"), l), inside(_draw(seed, key, "my"), w), 0.5 + _draw(seed, key, "mz") * (z - delta - 0.5)
        corner = zip(mic, (delta, delta, 0.5), (l - delta, w - delta, 2.0), strict=True)
        if sum(max(abs(low - m), abs(high - m)) ** 2 for m, low, high in corner) <= 1:
            raise ValueError("no place in the room is a metre from the microphone")
        out = []
        for p in range(positions):
            for t in itertools.count():
                # the first position's key is the attempt alone
                own = (key, t) if p == 0 else (key, p, t)
                src = inside(_draw(seed, *own, "sx"), l), inside(_draw(seed, *own, "sy"), w), 0.5 + _draw(seed, *own, "sz") * 1.5
                distance = math.sqrt(sum((s - m) ** 2 for s, m in zip(src, mic, strict=True)))
                if distance > 1:
                    out.append((p, a, l, w, z, r, _absorption(l, w, z, r), *mic, *src, distance))
                    break
        return out

    names = ["l", "w", "z", "rt60", "absorption", "mic_x", "mic_y", "mic_z", "src_x", "src_y", "src_z", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*[r for k in b.column(1).to_pylist() for r in room(k)], strict=True)) or [[]] * 14
            ids_ = b.column(0).take(pa.array([k for k in range(b.num_rows) for _ in range(positions)], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=["room_id", "position", "attempt", *names])

    keyed = ids.select("room_id", F.col("room_id").cast("string").alias("key"))
    return keyed.mapInArrow(run, f"room_id {ids.schema['room_id'].dataType.simpleString()}, position int, attempt int, " + ", ".join(f"{c} double" for c in names))


def direct_path_delay(distance: Column, rate: int = 16000) -> Column:
    """Samples that sound takes from source to microphone."""
    return F.floor(distance * rate / SOUND + 0.5).cast("bigint")


def weighted_mix(rows: DataFrame, corpus: str, weights: dict, seed: int, key: str) -> DataFrame:
    """Rows of several corpora in proportion to their weights: those of the greatest weight all stay."""
    top = max(weights.values())
    chance = F.lit(0.0)
    for name, weight in weights.items():
        chance = F.when(F.col(corpus) == name, weight / top).otherwise(chance)
    return rows.where(uniform(seed, key, F.lit("mix")) < chance)
