"""Turns of live conversations with Structured Streaming.

The same functions take a static table or a stream; on a stream, give the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_US = 200_000


def _timed(segments: DataFrame, watermark: str | None) -> DataFrame:
    s = segments.withColumn("at", F.timestamp_micros("start_us"))
    return s.withWatermark("at", watermark) if watermark else s


def merge_live(segments: DataFrame, gap_us: int = GAP_US, watermark: str | None = None) -> DataFrame:
    """Segments of a speaker at most ``gap_us`` apart as one: rec, speaker, channel, start_us, end_us, parts.

    A session's gap is the segment's own duration plus ``gap_us`` and one microsecond, as sessions
    that only touch stay apart; merged rows come out once the watermark has passed them.
    """
    s = _timed(segments.where("dur_us >= 0"), watermark)
    gap = F.concat(((F.col("dur_us") + gap_us + 1) / 1_000_000).cast("decimal(30,6)").cast("string"), F.lit(" seconds"))
    g = s.groupBy("rec", "speaker", "channel", F.session_window("at", gap).alias("w"))
    merged = g.agg(F.min("start_us").alias("start_us"), F.max(F.col("start_us") + F.col("dur_us")).alias("end_us"), F.count("*").alias("parts"))
    return merged.select("rec", "speaker", "channel", "start_us", "end_us", "parts")


def talk_time(segments: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """speaker, from_us, segments, talk_us in tumbling windows of the segments' starts."""
    g = _timed(segments, watermark).groupBy("speaker", F.window("at", window).alias("w"))
    return g.agg(F.count("*").alias("segments"), F.sum("dur_us").alias("talk_us")).select("speaker", F.unix_micros("w.start").alias("from_us"), "segments", "talk_us")


def turn_types_live(segments: DataFrame, threshold_us: int = 1_000_000, watermark: str = "10 seconds") -> DataFrame:
    """rec, id, gap_us, type of each segment against the one before it, for a stream in order of start within a recording.

    The state of a recording is its last segment's speaker and end, 16 bytes; it goes when the
    watermark is a minute past it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["start_us", "id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if before is not None:
                gap = int(r.start_us) - before[1]
                kind = 0 if r.speaker == before[0] else 1 if gap >= 0 else 3 if r.dur_us <= threshold_us else 2
                out.append((key[0], int(r.id), gap, kind))
            before = (int(r.speaker), int(r.start_us) + int(r.dur_us))
        state.update(before)
        state.setTimeoutTimestamp(max(before[1] // 1000, state.getCurrentWatermarkMs() + 1) + 60_000)
        yield pd.DataFrame(out, columns=["rec", "id", "gap_us", "type"])

    s = _timed(segments, watermark)
    return s.groupBy("rec").applyInPandasWithState(step, "rec date, id bigint, gap_us bigint, type int", "speaker bigint, end_us bigint", "append", GroupStateTimeout.EventTimeTimeout)
