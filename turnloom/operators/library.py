"""Cuts of a library: filters, counts of what they drop, and joins of manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(dur_us: str, low_s: float, high_s: float) -> Column:
    """Durations from low to high seconds, both included."""
    return F.col(dur_us).between(int(round(low_s * 1e6)), int(round(high_s * 1e6)))


def exclude_speakers(cuts: DataFrame, speakers: Sequence[str]) -> DataFrame:
    """Cuts (supervisions: structs with a speaker) none of whose speakers is in the list."""
    return cuts.where(~F.exists("supervisions", lambda s: F.coalesce(s["speaker"].cast("string").isin(list(speakers)), F.lit(False))))


def single_speaker(cuts: DataFrame) -> DataFrame:
    """Cuts whose supervisions are of one speaker, who becomes the column ``speaker``."""
    who = F.array_distinct(F.transform("supervisions", lambda s: s["speaker"]))
    return cuts.withColumn("who", who).where("size(who) = 1").withColumn("speaker", F.col("who")[0]).drop("who")


def frequent_speakers(cuts: DataFrame, least: int) -> DataFrame:
    """Cuts of speakers with at least ``least`` of them; the counts combine before they are shuffled."""
    kept = cuts.groupBy("speaker").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("speaker")
    return cuts.join(kept, "speaker", "left_semi")


def drop_report(cuts: DataFrame, low_s: float, high_s: float, least: int) -> DataFrame:
    """One row: what the duration, alignment and speaker filters drop, in this order.

    cuts: speaker, dur_us, aligned (boolean).
    """
    ok = within("dur_us", low_s, high_s)
    by = cuts.groupBy("speaker").agg(
        F.count("*").alias("n"),
        F.count_if(~ok).alias("length"),
        F.count_if(ok & ~F.col("aligned")).alias("unaligned"),
        F.count_if(ok & F.col("aligned")).alias("left"),
    )
    few = F.col("left") < least
    zero = F.lit(0).cast("bigint")
    return by.agg(
        F.coalesce(F.sum("n"), zero).alias("cuts"),
        F.coalesce(F.sum("length"), zero).alias("dropped_duration"),
        F.coalesce(F.sum("unaligned"), zero).alias("dropped_alignment"),
        F.coalesce(F.sum(F.when(few, F.col("left")).otherwise(0)), zero).alias("dropped_few"),
        F.coalesce(F.sum(F.when(~few, F.col("left")).otherwise(0)), zero).alias("kept"),
        F.count("*").alias("speakers_before"),
        F.count_if(~few).alias("speakers_after"),
    )


def cut_index(library: DataFrame) -> DataFrame:
    """speaker, pos, cut_id, dur_us: cuts of a speaker numbered from 0 by id, to draw from by position."""
    pos = F.row_number().over(Window.partitionBy("speaker").orderBy("cut_id")) - 1
    return library.select("speaker", pos.cast("bigint").alias("pos"), "cut_id", "dur_us")


def split_channels(recordings: DataFrame) -> DataFrame:
    """A cut a channel: id, rec, channel."""
    each = recordings.select("rec", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("channel"))
    return each.select(F.concat_ws("_ch", F.date_format("rec", "yyyy-MM-dd"), "channel").alias("id"), "rec", "channel")


def orphans(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """rec and side: recordings without segments, and recordings that only segments know."""
    silent = recordings.select("rec").distinct().join(segments, "rec", "left_anti").withColumn("side", F.lit("recording"))
    unknown = segments.select("rec").distinct().join(recordings, "rec", "left_anti").withColumn("side", F.lit("segment"))
    return silent.union(unknown)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def path_parts(files: DataFrame) -> DataFrame:
    """page_id, name, stem, parent, and the path with the ending .wav."""
    name = basename(F.col("path"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return files.select("page_id", name.alias("name"), stem.alias("stem"), parent.alias("parent"), F.concat_ws("/", parent, F.concat(stem, F.lit(".wav"))).alias("wav"))


def named_like(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name (not folder) the pattern is found in."""
    return files.where(basename(F.col("path")).rlike(pattern))


def longer_than(files: DataFrame, seconds: float, rate: int = 16000) -> DataFrame:
    return files.where(F.col("n_samples") / rate > seconds)


def with_ending(files: DataFrame, endings: Sequence[str]) -> DataFrame:
    """Files whose path ends in one of the endings, in any case."""
    lower = F.lower("path")
    hit = F.lit(False)
    for e in endings:
        hit = hit | lower.endswith(e.lower())
    return files.where(hit)


def resampled(files: DataFrame, target: int) -> DataFrame:
    """n_samples, sampling_rate and duration (three decimals) at the target rate; equal rates stay."""
    n = F.floor((F.col("n_samples") * (2 * target) + F.col("sampling_rate")) / (2 * F.col("sampling_rate")))
    n = F.when(F.col("sampling_rate") == target, F.col("n_samples")).otherwise(n)
    ms = F.floor((n * 2000 + target) / (2 * target))
    return files.select("page_id", n.cast("bigint").alias("n_samples"), F.lit(target).alias("sampling_rate"), (ms / 1000.0).alias("duration"))
