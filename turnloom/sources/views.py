"""Conversation tables derived from the star-schema tables; times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_FIELDS = "id bigint, rec date, speaker bigint, channel int, start_us bigint, dur_us bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: one an event, a recording a day, four speakers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.to_date("ts").alias("rec"),
        (F.col("user_id") % 4).alias("speaker"),
        F.lit(0).alias("channel"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("dur_us"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a day, without those of Mondays' segments; a few have none at all."""
    return spark.range(0, 34).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("rec"), F.lit(16000).alias("sampling_rate"), (F.col("id") % 2 + 1).cast("int").alias("channels"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word alignments of utterances (conv_id, turn): idx, symbol, start_us and dur_us from the utterance's start."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    w = c.select("conv_id", "turn", "role", F.posexplode(F.split(text, " ")).alias("idx", "symbol")).where("symbol <> ''")
    dur = (F.length("symbol") * 60000).cast("bigint")
    pause = F.when(F.substring("symbol", -1, 1).isin(".", ",", "!", "?"), 350000).otherwise(50000)
    own = Window.partitionBy("conv_id", "turn").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_us") + F.col("pause")).over(own), F.lit(0)) + 100000
    return w.withColumn("dur_us", dur).withColumn("pause", pause.cast("bigint")).withColumn("start_us", start).drop("pause")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with their words in order: cut_id, speaker, dur_us, words, and 100 ms of silence around."""
    w = words(spark, sf_dir)
    item = F.struct("idx", "symbol", "start_us", "dur_us")
    g = w.groupBy("conv_id", "turn", F.col("role").alias("speaker")).agg(F.array_sort(F.collect_list(item)).alias("words"), (F.max(F.col("start_us") + F.col("dur_us")) + 100000).alias("dur_us"))
    return g.select(F.concat_ws("_", "conv_id", "turn").alias("cut_id"), "conv_id", "turn", "speaker", "dur_us", "words")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short mono signals: sig_id, speaker, x (doubles)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sig_id"), F.col("label").alias("speaker"), F.col("embedding").cast("array<double>").alias("x"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise files: path and length in samples at 16 kHz."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), (F.length("html") * 16).cast("bigint").alias("n_samples"))


def meetings(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n).withColumnRenamed("id", "meeting")
