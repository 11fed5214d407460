"""Cut manifests, file lists and statistics: readers and writers.

Manifests are JSON lines, gzipped or not.  A gzipped file is read by one task, so the rows are
spread again when there are fewer files than tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<symbol:string,start:double,duration:double,score:double>"
SUPERVISION = f"struct<id:string,recording_id:string,start:double,duration:double,channel:int,speaker:string,text:string,language:string,gender:string,alignment:map<string,array<{ITEM}>>,custom:map<string,string>>"
RECORDING = "struct<id:string,sources:array<struct<type:string,channels:array<int>,source:string>>,sampling_rate:int,num_samples:bigint,duration:double>"
CUT = f"id string, start double, duration double, channel int, supervisions array<{SUPERVISION}>, recording {RECORDING}"


def us(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1e6).cast("bigint")


def read_cuts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Cuts of one or several manifests, their splits one after another."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(CUT).json(paths).repartition(spark.sparkContext.defaultParallelism)


def split_paths(folder: str, prefix: str, splits: Sequence[str]) -> list[str]:
    return [f"{folder.rstrip('/')}/{prefix}_{s}.jsonl.gz" for s in splits]


def to_cuts(manifest: DataFrame) -> DataFrame:
    """The engine's cuts (cut_id, speaker, dur_us, words): each cut's first supervision, times from its start.

    source and source_us: its sound file, and where it begins in that.
    """
    s = F.get("supervisions", 0)
    word = s["alignment"]["word"]
    start = F.coalesce(s["start"], F.lit(0.0))
    micro = lambda x: F.round(x * 1e6).cast("bigint")
    words = F.transform(word, lambda w, i: F.struct(i.alias("idx"), w["symbol"].alias("symbol"), micro(w["start"] - start).alias("start_us"), micro(w["duration"]).alias("dur_us")))
    source = F.get(F.col("recording")["sources"], 0)["source"]
    # supervisions count from their cut's start
    begin = micro(F.coalesce(F.col("start"), F.lit(0.0)) + start)
    return manifest.select(F.col("id").alias("cut_id"), s["speaker"].alias("speaker"), micro(s["duration"]).alias("dur_us"), words.alias("words"), source.alias("source"), begin.alias("source_us"))


def to_segments(supervisions: DataFrame) -> DataFrame:
    """Segments for fitting from rows recording_id, speaker, start, duration."""
    s = supervisions.select(F.col("recording_id").alias("rec"), "speaker", F.lit(0).alias("channel"), us("start").alias("start_us"), us("duration").alias("dur_us"))
    return s.withColumn("id", F.xxhash64("rec", "speaker", "start_us", "dur_us"))


def write_json(rows: DataFrame, path: str) -> None:
    """Gzipped JSON lines; a file a task."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_rooms(responses: DataFrame, path: str) -> None:
    """A list of rooms, each the list of its responses' paths in order of position; from rows room_id, position, path."""
    by = responses.groupBy("room_id").agg(F.array_sort(F.collect_list(F.struct("position", "path"))).alias("p"))
    by.select(F.to_json(F.transform("p", lambda x: x["path"])).alias("value"), "room_id").repartition(1).sortWithinPartitions("room_id").select("value").write.mode("overwrite").text(path)


def read_rooms(spark: SparkSession, path: str) -> DataFrame:
    """room_id (the line's place among all) and paths of a list of rooms: a JSON list a line, or one list of lists."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    lists = "array<array<string>>"
    whole = F.from_json("value", lists)
    lines = F.from_json(F.concat(F.lit("["), F.regexp_replace("value", r"\n+", ","), F.lit("]")), lists)
    nested = F.col("value").rlike(r"^\[\s*\[")
    return text.select(F.posexplode(F.when(nested, whole).otherwise(lines)).alias("room_id", "paths")).select(F.col("room_id").cast("bigint").alias("room_id"), "paths")


def audio_files(spark: SparkSession, folders: str | Sequence[str]) -> DataFrame:
    """path and length in bytes of sound files below the folders; contents aren't read."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,flac,mp3}").load(folders)
    return files.select("path", "length")


def write_list(paths: DataFrame, folder: str) -> None:
    paths.select(F.col("path").alias("value")).write.mode("overwrite").text(folder)


def read_list(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).where(F.trim("value") != "").select(F.col("value").alias("path"))


def write_report(report: DataFrame, folder: str) -> None:
    """A one-row report as text, a line a column."""
    names = report.columns
    lines = F.array(*[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in names])
    report.limit(1).select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
