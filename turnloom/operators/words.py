"""Word alignments: pause splitting, segment texts, shifting, and what goes into RTTM lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_at_pauses(cuts: DataFrame, threshold_us: int | None = 200_000) -> DataFrame:
    """Segments of a cut between pauses of the threshold or more: cut_id, part, speaker, start_us, end_us, text, words.

    A pause is divided at its middle; silence of that length before the first and after the last
    word is cut off at its middle as well.  Blank words don't count.  A cut of blank words only, or
    without a threshold, stays whole; one without alignments goes.
    """
    aligned = cuts.where("words is not null and size(words) > 0")
    real = aligned.withColumn("real", F.filter("words", lambda w: F.trim(w["symbol"]) != ""))
    if threshold_us is None:
        whole, split = real, None
    else:
        whole, split = real.where("size(real) = 0"), real.where("size(real) > 0")
    text = F.array_join(F.transform("words", lambda w: w["symbol"]), " ")
    kept = whole.select("cut_id", F.lit(0).cast("bigint").alias("part"), "speaker", F.lit(0).cast("bigint").alias("start_us"), F.col("dur_us").alias("end_us"), text.alias("text"), F.size("words").cast("bigint").alias("words"))
    if split is None:
        return kept
    w = split.select("cut_id", "speaker", F.col("dur_us").alias("cut_us"), F.posexplode("real").alias("idx", "w")).select("cut_id", "speaker", "cut_us", "idx", F.col("w.symbol").alias("symbol"), F.col("w.start_us").alias("a"), (F.col("w.start_us") + F.col("w.dur_us")).alias("b"))
    own = Window.partitionBy("cut_id").orderBy("idx")
    w = w.withColumn("before", F.col("a") - F.coalesce(F.lag("b").over(own), F.lit(0))).withColumn("after", F.coalesce(F.lead("a").over(own), F.col("cut_us")) - F.col("b"))
    w = w.withColumn("first", F.lag("b").over(own).isNull()).withColumn("last", F.lead("a").over(own).isNull())
    part = F.sum(F.when(~F.col("first") & (F.col("before") >= threshold_us), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = lambda c: F.floor(F.col(c) / 2)
    begin = F.when(F.col("before") >= threshold_us, F.col("a") - half("before")).when(F.col("first"), F.lit(0)).otherwise(F.col("a"))
    end = F.when(F.col("after") >= threshold_us, F.col("b") + F.col("after") - half("after")).when(F.col("last"), F.col("cut_us")).otherwise(F.col("b"))
    g = w.withColumn("part", part).withColumn("begin", begin).withColumn("end", end).groupBy("cut_id", "speaker", "part")
    parts = g.agg(F.min("begin").alias("start_us"), F.max("end").alias("end_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "symbol"))), lambda x: x["symbol"]), " ").alias("text"), F.count("*").alias("words"))
    return parts.select("cut_id", "part", "speaker", "start_us", "end_us", "text", "words").union(kept)


def shift(cuts: DataFrame, offset_us: int) -> DataFrame:
    """Alignments later by the offset; durations stay."""
    return cuts.withColumn("words", F.transform("words", lambda w: w.withField("start_us", w["start_us"] + offset_us)))


def rttm_entries(cuts: DataFrame) -> DataFrame:
    """An entry a non-blank word, or the whole cut where it has no words: cut_id, speaker, start_us, dur_us."""
    real = F.filter("words", lambda w: F.trim(w["symbol"]) != "")
    items = F.transform(real, lambda w: F.struct(w["start_us"].alias("start_us"), w["dur_us"].alias("dur_us")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start_us"), F.col("dur_us").alias("dur_us")))
    entry = F.explode(F.when(F.size(F.coalesce("words", F.array().cast("array<struct<idx:int,symbol:string,start_us:bigint,dur_us:bigint>>"))) > 0, items).otherwise(whole))
    return cuts.select("cut_id", F.coalesce(F.col("speaker").cast("string"), F.lit("unknown")).alias("speaker"), entry.alias("e")).select("cut_id", "speaker", "e.start_us", "e.dur_us")


def chunk(segments: DataFrame, length_us: int = 30_000_000) -> DataFrame:
    """Segments of a recording by windows of their start times; a chunk outlasts its window by what its last segments do."""
    origin = F.min("start_us").over(Window.partitionBy("rec"))
    return segments.withColumn("chunk", F.floor((F.col("start_us") - origin) / length_us))
