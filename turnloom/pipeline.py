"""Stages that are run once: each writes a table and a later run reads it instead.

A stage's table counts as done only with Spark's own marker, so one that an error cut short is
written again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intervals, render, sampling
from .operators import library as L
from .operators import words as W
from .operators.simulate import SimConfig, simulate
from .sources import rttm

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def is_done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def run_stages(spark: SparkSession, folder: str, stages: Sequence[tuple[str, Stage]], first: int = 1, overwrite: bool = False) -> dict[str, DataFrame]:
    """Tables by stage name.  Stages before ``first`` must be done; later ones are skipped if done."""
    tables: dict[str, DataFrame] = {}
    for k, (name, stage) in enumerate(stages, 1):
        path = f"{folder.rstrip('/')}/{name}"
        done = is_done(spark, path)
        if k < first and not done:
            raise ValueError(f"stage {name} isn't done, but the run is to begin after it")
        if k >= first and (overwrite or not done):
            stage(spark, tables).write.mode("overwrite").parquet(path)
        tables[name] = spark.read.parquet(path)
    return tables


def _seconds(us: Column) -> Column:
    return F.round(us / 1e6, 6)


def meeting_stages(cuts: DataFrame, config: SimConfig) -> list[tuple[str, Stage]]:
    """Library, timelines, RTTM lines, statistics and supervisions of simulated meetings from aligned cuts (views.cuts, or those of manifests)."""

    def library(spark: SparkSession, _: dict[str, DataFrame]) -> DataFrame:
        c = cuts.where(~F.coalesce(F.col("speaker").cast("string").isin(list(config.exclude_speakers)), F.lit(False)))
        for name, kind in (("source", "string"), ("source_us", "bigint")):
            c = c if name in c.columns else c.withColumn(name, F.lit(None).cast(kind))
        factor = config.split_fa_factor
        parts = W.split_at_pauses(c, None if factor is None else int(round(factor * 1e6))).drop("words", "speaker")
        inside = lambda w: (F.trim(w["symbol"]) != "") & (w["start_us"] >= F.col("start_us")) & (w["start_us"] + w["dur_us"] <= F.col("end_us"))
        words = F.transform(F.filter("words", inside), lambda w: F.struct(w["symbol"].alias("symbol"), (w["start_us"] - F.col("start_us")).alias("start_us"), w["dur_us"].alias("dur_us")))
        s = parts.join(c.select("cut_id", "speaker", "words", "source", "source_us"), "cut_id").select(
            F.col("speaker").cast("string").alias("name"), F.concat_ws("-", "cut_id", F.lpad(F.col("part").cast("string"), 3, "0")).alias("cut_id"), (F.col("end_us") - F.col("start_us")).alias("dur_us"),
            "text", words.alias("words"), "source", (F.col("source_us") + F.col("start_us")).alias("source_us"),
        )
        s = s.where(L.within("dur_us", config.min_utt_duration, config.max_utt_duration)).withColumn("speaker", F.pmod(F.xxhash64("name"), F.lit((1 << 53) - 1)))
        return L.frequent_speakers(s, config.min_spk_utt).select("speaker", "name", "cut_id", "dur_us", "text", "words", "source", "source_us")

    def timelines(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return simulate(spark.range(config.n_meetings).withColumnRenamed("id", "meeting"), t["library"], config)

    def lines(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        """Words of a speaker that are at most 200 ms apart are one interval; an utterance without words is one."""
        said = t["timelines"].join(t["library"].select("cut_id", "name", "words"), "cut_id")
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start_us"), F.col("dur_us").alias("dur_us")))
        entry = F.explode(F.when(F.size("words") > 0, F.transform("words", lambda w: F.struct(w["start_us"].alias("start_us"), w["dur_us"].alias("dur_us")))).otherwise(whole))
        e = said.select("meeting", "name", "start_us", entry.alias("e")).select(F.col("meeting").alias("rec"), F.col("name").alias("speaker"), F.lit(0).alias("channel"), (F.col("start_us") + F.col("e.start_us")).alias("start_us"), "e.dur_us")
        merged = intervals.merge(e)
        start, dur = rttm.seconds(F.col("start_us")), rttm.seconds(F.col("end_us") - F.col("start_us"))
        text = F.format_string("SPEAKER meeting_%d 0 %.4f %.4f <NA> <NA> %s <NA> <NA>", "rec", start, dur, F.coalesce("speaker", F.lit("unknown")))
        return merged.select(F.col("rec").alias("meeting"), "start_us", text.alias("line"))

    def statistics(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        end = F.max(F.col("start_us") + F.col("dur_us"))
        return t["timelines"].groupBy("meeting").agg(F.count("*").alias("utterances"), F.countDistinct("speaker").alias("speakers"), F.sum("dur_us").alias("talk_us"), end.alias("end_us"))

    def supervisions(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        """A row an utterance as manifests have it, with its text, its words in the meeting's time, its level and where it comes from."""
        level = sampling.levels(t["timelines"], config.seed, config.base_gain, config.rel_gain)
        said = t["timelines"].join(t["library"].select("cut_id", "name", "text", "words"), "cut_id").join(level, ["meeting", "step"])
        rec = F.concat(F.lit("meeting_"), "meeting")
        word = F.transform("words", lambda w: F.struct(w["symbol"].alias("symbol"), _seconds(w["start_us"] + F.col("start_us")).alias("start"), _seconds(w["dur_us"]).alias("duration")))
        kind = F.element_at(F.array(*map(F.lit, ("FIRST", "TH", "TS", "IR", "BC"))), F.col("type") + 2)
        custom = F.create_map(F.lit("transition_type"), kind, F.lit("speech_level_db"), F.col("level_db").cast("string"), F.lit("original_cut_id"), F.col("cut_id"))
        return said.select(
            F.concat(rec, F.lit("_"), F.lpad(F.col("step").cast("string"), 4, "0")).alias("id"), rec.alias("recording_id"), _seconds(F.col("start_us")).alias("start"), _seconds(F.col("dur_us")).alias("duration"),
            F.lit(0).alias("channel"), F.col("name").alias("speaker"), "text", F.create_map(F.lit("word"), word).alias("alignment"), custom.alias("custom"),
        )

    return [("library", library), ("timelines", timelines), ("rttm", lines), ("statistics", statistics), ("supervisions", supervisions)]


def recordings(written: DataFrame, rate: int) -> DataFrame:
    """Manifest rows of the mixtures among written WAV files."""
    source = F.array(F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.col("path").alias("source")))
    mixed = written.where(F.col("stem") == render.MIX)
    return mixed.select(F.concat(F.lit("meeting_"), "meeting").alias("id"), source.alias("sources"), F.lit(rate).alias("sampling_rate"), "n_samples", F.round(F.col("n_samples") / rate, 6).alias("duration")).withColumnRenamed("n_samples", "num_samples")


def cut_manifest(recordings_: DataFrame, supervisions: DataFrame) -> DataFrame:
    """A cut a recording, with all its supervisions in order."""
    s = supervisions.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("id", "recording_id", "start", "duration", "channel", "speaker", "text", F.map_entries("alignment").alias("a"), F.map_entries("custom").alias("c")))).alias("s"))
    own = F.transform("s", lambda x: F.struct(*[x[n].alias(n) for n in ("id", "recording_id", "start", "duration", "channel", "speaker", "text")], F.map_from_entries(x["a"]).alias("alignment"), F.map_from_entries(x["c"]).alias("custom")))
    joined = recordings_.withColumn("recording", F.struct(*recordings_.columns)).join(s, recordings_["id"] == s["recording_id"])
    return joined.select("id", F.lit(0.0).alias("start"), "duration", F.lit(0).alias("channel"), own.alias("supervisions"), "recording")


def nemo_manifest(statistics: DataFrame, folder: str) -> DataFrame:
    name = F.concat(F.lit("meeting_"), "meeting")
    return statistics.select(
        F.concat(F.lit(f"{folder}/wav/"), name, F.lit(".wav")).alias("audio_filepath"), F.lit(0.0).alias("offset"), _seconds(F.col("end_us")).alias("duration"),
        F.col("speakers").alias("num_speakers"), F.concat(F.lit(f"{folder}/rttm_files/"), name, F.lit(".rttm")).alias("rttm_filepath"),
    )
