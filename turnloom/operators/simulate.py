"""Meetings as sequences of utterances under turn-taking rules.

A meeting is a row of draws that depend on each other, so it is one group's state; meetings are
independent and spread over tasks.  Draws are keyed by (seed, meeting, step, purpose), and times
are integer microseconds, so the result doesn't depend on the partitioning.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import library as L
from .turns import BACKCHANNEL, HOLD, INTERRUPTION, SWITCH

#: Cuts of a library that is broadcast, at most.
BROADCAST_CUTS = 12_000_000
#: Utterances of a meeting that are joined with a larger library at first; meetings that go on get twice as many, and so on.
JOINED_STEPS = 16
SCHEMA = "meeting bigint, step int, speaker bigint, cut_id string, type int, start_us bigint, dur_us bigint"


@dataclass
class SimConfig:
    """What a simulation draws from; the defaults are those of a flat two-to-four speaker run."""

    seed: int = 7
    n_meetings: int = 1000
    duration_us: int = 60_000_000
    min_max_spk: tuple[int, int] = (2, 4)
    max_concurrent_speakers: int | None = 4
    betas: tuple[float, float, float, float] = (0.57, 0.40, 0.44, 0.67)
    p_ind: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)
    p_markov: tuple[tuple[float, ...], ...] | None = None
    start_offset: float = 0.0
    epsilon: float = 0.03
    split_fa_factor: float | None = 0.2
    min_utt_duration: float = 0.0
    max_utt_duration: float = 20.0
    min_spk_utt: int = 5
    exclude_speakers: tuple[str, ...] = ()
    base_gain: tuple[float, float] = (-35.0, -8.0)
    rel_gain: tuple[float, float] = (-12.0, 5.0)
    speed_perturb: bool = False
    speed_perturb_range: tuple[float, float] = (0.95, 1.05)
    boost_overlap_factor: float | None = None
    samplerate: int = 16000
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.boost_overlap_factor is not None:
            if self.boost_overlap_factor < 0:
                raise ValueError("the boost factor can't be negative")
            self.p_ind = _boosted(self.p_ind, self.boost_overlap_factor)
            if self.p_markov is not None:
                self.p_markov = tuple(_boosted(r, self.boost_overlap_factor) for r in self.p_markov)


def _boosted(p: tuple[float, ...], factor: float) -> tuple[float, ...]:
    raised = [x * factor if k >= INTERRUPTION else x for k, x in enumerate(p)]
    total = sum(raised)
    return tuple(x / total for x in raised) if total else (1.0, 0.0, 0.0, 0.0)


def draw(seed: int, *key: object) -> float:
    text = "|".join(map(str, (seed, *key)))
    return (int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") + 0.5) / 4294967296.0


def peak_speakers(start: int, end: int, speaker: int, said: list[tuple[int, int, int]]) -> int:
    """Most speakers at once in [start, end), the new one included."""
    near = [(max(a, start), min(b, end), s) for s, a, b in said if a < end and b > start and b > a]
    edges = sorted({t for a, b, _ in near for t in (a, b)})
    most = 1
    for t in edges[:-1]:
        active = {s for a, b, s in near if a <= t < b}
        most = max(most, len(active | {speaker}))
    return most


def place_utterance(proposed: int, dur: int, speaker: int, said: list[tuple[int, int, int]], limit: int | None) -> int:
    """The earliest allowed start, as in ``intervals.place``."""
    if not limit or limit <= 0:
        return proposed
    for at in [proposed, *sorted({b for _, _, b in said if b > proposed})]:
        if peak_speakers(at, at + dur, speaker, said) <= limit:
            return at
    return max(said[-1][2], proposed) if said else proposed


def meeting_plan(meeting: int, sizes: dict[int, int], c: SimConfig) -> Iterator[int | tuple[int, int, int]]:
    """How many speakers a meeting has, then (kind, speaker, place of the cut among the speaker's) of one utterance after another, without end.

    What is said, by whom and how doesn't depend on how long the cuts are.
    """
    ranked = sorted(sizes, key=lambda s: (draw(c.seed, meeting, s, "rank"), s))
    low, high = c.min_max_spk
    n = min(len(ranked), low + min(int(draw(c.seed, meeting, "n") * (high - low + 1)), high - low))
    chosen = ranked[:n]
    yield n
    ends = lambda p: list(itertools.accumulate(p[:-1], lambda total, q: round(total + q, 12)))
    first, after = ends(c.p_ind), None if c.p_markov is None else [ends(p) for p in c.p_markov]
    before = kind = None
    for step in itertools.count():
        x = draw(c.seed, meeting, step, "type")
        kind = sum(x >= total for total in (first if after is None or kind is None else after[kind]))
        u = draw(c.seed, meeting, step, "spk")
        if before is None:
            speaker = chosen[min(int(u * n), n - 1)]
        elif kind == HOLD or n == 1:
            speaker = before
        else:
            others = [s for s in chosen if s != before]
            speaker = others[min(int(u * len(others)), len(others) - 1)]
        before = speaker
        yield kind, speaker, min(int(draw(c.seed, meeting, step, "cut") * sizes[speaker]), sizes[speaker] - 1)


def meeting_rows(meeting: int, sizes: dict[int, int], length: Callable[[int, int, int], int], c: SimConfig) -> Iterator[tuple]:
    """(meeting, step, speaker, place of the cut, type, start_us, dur_us); type -1 for the first utterance.  ``length`` is that of (step, speaker, place)."""
    plan = meeting_plan(meeting, sizes, c)
    n = next(plan)
    free: dict[int, int] = {}
    said: list[tuple[int, int, int]] = []
    before = None
    step = now = 0
    while now < c.duration_us or len(free) < n:
        u = lambda what: draw(c.seed, meeting, step, what)  # noqa: B023, E731
        kind, speaker, place = next(plan)
        dur = length(step, speaker, place)
        if before is None:
            start = int(math.floor((c.start_offset + u("start") * (1.0 - c.start_offset)) * 1e6))
        else:
            beta, x = c.betas[kind], u("gap")
            end = before[1] + before[2]
            if kind in (HOLD, SWITCH) or n == 1:
                start = end + int(math.floor(-c.betas[kind if kind in (HOLD, SWITCH) else HOLD] * math.log(x) * 1e6))
            else:
                share = min(max(-beta * math.log(x), c.epsilon), 1 - c.epsilon)
                start = end - int(math.floor(share * before[2]))
            start = max(start, free.get(speaker, 0))
            start = place_utterance(start, dur, speaker, said, c.max_concurrent_speakers)
        yield meeting, step, speaker, place, (-1 if before is None else kind), start, dur
        end = start + dur
        free[speaker] = end if speaker not in free else max(end + 10_000, free[speaker])
        said.append((speaker, start, end))
        before, now, step = (speaker, start, dur), end, step + 1


def simulate(meetings: DataFrame, library: DataFrame, config: SimConfig) -> DataFrame:
    """Timelines of the meetings from the cuts (speaker, cut_id, dur_us) of a library.

    Meetings are spread over tasks first, as a file of their ids is small and each is much work.
    A library of up to BROADCAST_CUTS cuts, some 20 bytes each, goes to all tasks as two arrays.  A
    larger one is joined with the utterances.  The result is the same.
    """
    spark = meetings.sparkSession
    ids = meetings.select("meeting").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "meeting")
    cuts = library.select("speaker", "cut_id", "dur_us").where("speaker is not null")
    sizes = {int(r["speaker"]): int(r["n"]) for r in cuts.groupBy("speaker").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) > BROADCAST_CUTS:
        return _simulate_joined(ids, cuts, sizes, config)
    rows = cuts.orderBy("speaker", "cut_id").select(F.col("cut_id").cast("string").alias("cut_id"), F.col("dur_us").cast("bigint").alias("dur_us")).toArrow()
    order = sorted(sizes)
    first = dict(zip(order, itertools.accumulate((sizes[s] for s in order), initial=0), strict=False))
    held = spark.sparkContext.broadcast((rows["dur_us"].to_numpy(), rows["cut_id"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        durations, names = held.value
        length = lambda step, speaker, place: int(durations[first[speaker] + place])
        for batch in batches:
            said = batch.column(0).to_pylist()
            for at in range(0, len(said), 1024):
                columns = list(zip(*(r for m in said[at : at + 1024] for r in meeting_rows(int(m), sizes, length, config)), strict=True)) or [[]] * 7
                places = pa.array((first[s] + k for s, k in zip(columns[2], columns[3], strict=True)), pa.int64())
                yield _batch([*columns[:3], names.take(places), *columns[4:]])

    return ids.mapInArrow(run, SCHEMA)


def _batch(columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    arrays = [c.cast(k) if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["meeting", "step", "speaker", "cut_id", "type", "start_us", "dur_us"])


def _simulate_joined(ids: DataFrame, cuts: DataFrame, sizes: dict[int, int], config: SimConfig) -> DataFrame:
    """Utterances are planned, then joined with their cuts by place, then put in time; a meeting that isn't over by then is planned further."""
    index = L.cut_index(cuts).withColumn("cut_id", F.col("cut_id").cast("string"))
    steps, done = JOINED_STEPS, None
    while True:
        def plan(batches: Iterator[pd.DataFrame], steps: int = steps) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 1024):
                    rows = [(m, k, *r[1:]) for m in b["meeting"][at : at + 1024] for k, r in enumerate(itertools.islice(meeting_plan(int(m), sizes, config), 1, steps + 1))]
                    yield pd.DataFrame(rows, columns=["meeting", "step", "speaker", "pos"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    out = []
                    for m, own in zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True):
                        try:
                            out += [(*r[:3], own[r[1]]["cut_id"], *r[4:]) for r in meeting_rows(m, sizes, lambda step, *_: own[step]["dur_us"], config)]  # noqa: B023
                        except IndexError:
                            out.append((m, -1, None, None, None, None, None))
                    yield _batch(list(zip(*out, strict=True)) or [[]] * 7)

        planned = ids.mapInPandas(plan, "meeting bigint, step int, speaker bigint, pos bigint")
        own = planned.join(index, ["speaker", "pos"]).groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("step", "cut_id", "dur_us"))).alias("own"))
        rows = own.mapInArrow(run, SCHEMA).persist(StorageLevel.DISK_ONLY)
        whole = rows.where("step >= 0")
        done = whole if done is None else done.union(whole)
        ids = rows.where("step < 0").select("meeting")
        if ids.isEmpty():
            return done
        steps *= 2
