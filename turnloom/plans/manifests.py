"""Queries over manifests: filters of cuts and files, joins, paths, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library as L
from ..sources import views
from .registry import CUTS, FILES, RECORDINGS, SEGMENTS, query

#: Ten-minute windows of a recording, with the segments that begin in them.
WINDOWED = SEGMENTS + ", cuts AS (SELECT rec, start_us // 600000000 AS cut, list(speaker) AS who, count(*) AS segments FROM v_segments GROUP BY 1, 2)"


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d)
    return s.groupBy("rec", F.floor(F.col("start_us") / 600_000_000).alias("cut")).agg(F.collect_list(F.struct("id", "speaker")).alias("supervisions"))


@query("exclude_speakers", f"WITH {WINDOWED} SELECT rec, cut, segments FROM cuts WHERE NOT list_contains(who, 2)")
def exclude_speakers(spark: SparkSession, d: str) -> DataFrame:
    return L.exclude_speakers(_windowed(spark, d), ["2"]).select("rec", "cut", F.size("supervisions").cast("bigint").alias("segments"))


@query("single_speaker", f"WITH {WINDOWED} SELECT rec, cut, who[1] AS speaker, segments FROM cuts WHERE len(list_distinct(who)) = 1")
def single_speaker(spark: SparkSession, d: str) -> DataFrame:
    return L.single_speaker(_windowed(spark, d)).select("rec", "cut", "speaker", F.size("supervisions").cast("bigint").alias("segments"))


@query("filter_duration", f"WITH {CUTS} SELECT cut_id, dur_us FROM v_cuts WHERE dur_us BETWEEN 1000000 AND 20000000")
def filter_duration(spark: SparkSession, d: str) -> DataFrame:
    return views.cuts(spark, d).where(L.within("dur_us", 1.0, 20.0)).select("cut_id", "dur_us")


ALL_CUTS = CUTS + """, all_cuts AS (SELECT t.conv_id, t.turn, t.role AS speaker, coalesce(c.dur_us, 0) AS dur_us, c.cut_id IS NOT NULL AS aligned
  FROM conversations t LEFT JOIN v_cuts c ON c.conv_id = t.conv_id AND c.turn = t.turn)"""


def _all_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Utterances with or without words."""
    c = views.cuts(spark, d).select("conv_id", "turn", "dur_us", F.lit(True).alias("aligned"))
    t = views.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    return t.join(c, ["conv_id", "turn"], "left").withColumn("dur_us", F.coalesce("dur_us", F.lit(0))).withColumn("aligned", F.coalesce("aligned", F.lit(False)))


@query("filter_aligned", f"WITH {ALL_CUTS} SELECT conv_id, turn, speaker FROM all_cuts WHERE aligned")
def filter_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _all_cuts(spark, d).where("aligned").select("conv_id", "turn", "speaker")


@query("min_spk_utt", f"WITH {CUTS} SELECT cut_id, speaker FROM v_cuts WHERE speaker IN (SELECT speaker FROM v_cuts GROUP BY speaker HAVING count(*) >= 150)")
def min_spk_utt(spark: SparkSession, d: str) -> DataFrame:
    return L.frequent_speakers(views.cuts(spark, d).select("cut_id", "speaker"), 150).select("cut_id", "speaker")


@query("cuts_per_speaker", f"WITH {CUTS} SELECT speaker, count(*) AS cuts FROM v_cuts GROUP BY speaker")
def cuts_per_speaker(spark: SparkSession, d: str) -> DataFrame:
    return views.cuts(spark, d).groupBy("speaker").agg(F.count("*").alias("cuts"))


@query("drop_report", f"""WITH {ALL_CUTS}, by_speaker AS (SELECT speaker, count(*) AS n, count(*) FILTER (dur_us NOT BETWEEN 0 AND 20000000) AS a,
  count(*) FILTER (dur_us BETWEEN 0 AND 20000000 AND NOT aligned) AS b, count(*) FILTER (dur_us BETWEEN 0 AND 20000000 AND aligned) AS c FROM all_cuts GROUP BY speaker)
SELECT CAST(sum(n) AS BIGINT) AS cuts, CAST(sum(a) AS BIGINT) AS dropped_duration, CAST(sum(b) AS BIGINT) AS dropped_alignment,
  CAST(sum(CASE WHEN c < 150 THEN c ELSE 0 END) AS BIGINT) AS dropped_few, CAST(sum(CASE WHEN c >= 150 THEN c ELSE 0 END) AS BIGINT) AS kept,
  count(*) AS speakers_before, count(*) FILTER (c >= 150) AS speakers_after FROM by_speaker""")
def drop_report(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_report(_all_cuts(spark, d), 0, 20, 150)


@query("align_probe", f"""WITH {ALL_CUTS}, head AS (SELECT aligned FROM all_cuts ORDER BY conv_id, turn LIMIT 200)
SELECT count(*) AS probed, count(*) FILTER (aligned) AS aligned FROM head""")
def align_probe(spark: SparkSession, d: str) -> DataFrame:
    """A look at the first 200 cuts; the limit is the feature."""
    return _all_cuts(spark, d).orderBy("conv_id", "turn").limit(200).agg(F.count("*").alias("probed"), F.count_if(F.col("aligned")).alias("aligned"))


@query("list_noise", f"WITH {FILES} SELECT page_id, path FROM v_files WHERE lower(path) LIKE '%5' OR lower(path) LIKE '%#top'")
def list_noise(spark: SparkSession, d: str) -> DataFrame:
    return L.with_ending(views.files(spark, d), ["5", "#TOP"]).select("page_id", "path")


@query("noise_regex", f"WITH {FILES} SELECT page_id, path FROM v_files WHERE regexp_matches(regexp_extract(path, '[^/]*$', 0), '[13579]{{2}}')")
def noise_regex(spark: SparkSession, d: str) -> DataFrame:
    return L.named_like(views.files(spark, d), "[13579]{2}").select("page_id", "path")


@query("noise_min_len", f"WITH {FILES} SELECT page_id, n_samples FROM v_files WHERE n_samples / 16000 > 2.0")
def noise_min_len(spark: SparkSession, d: str) -> DataFrame:
    return L.longer_than(views.files(spark, d), 2.0).select("page_id", "n_samples")


@query("missing_sources", f"WITH {FILES} SELECT page_id, path FROM v_files WHERE path NOT IN (SELECT path FROM v_files WHERE n_samples / 16000 > 2.0)")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a listing, here that of the files longer than two seconds, doesn't have."""
    f = views.files(spark, d)
    there = L.longer_than(f, 2.0).select("path")
    return f.join(there, "path", "left_anti").select("page_id", "path")


@query("cuts_from_manifests", f"""WITH {SEGMENTS}, {RECORDINGS} SELECT r.rec, r.sampling_rate, s.id, s.speaker, s.dur_us FROM v_recordings r LEFT JOIN v_segments s ON s.rec = r.rec""")
def cuts_from_manifests(spark: SparkSession, d: str) -> DataFrame:
    return views.recordings(spark, d).join(views.segments(spark, d), "rec", "left").select("rec", "sampling_rate", "id", "speaker", "dur_us")


@query("recs_without_segments", f"WITH {SEGMENTS}, {RECORDINGS} SELECT rec, channels FROM v_recordings WHERE rec NOT IN (SELECT rec FROM v_segments)")
def recs_without_segments(spark: SparkSession, d: str) -> DataFrame:
    return views.recordings(spark, d).join(views.segments(spark, d), "rec", "left_anti").select("rec", "channels")


@query("fk_orphans", f"""WITH {SEGMENTS}, {RECORDINGS} SELECT rec, 'recording' AS side FROM v_recordings WHERE rec NOT IN (SELECT rec FROM v_segments)
UNION ALL SELECT DISTINCT rec, 'segment' FROM v_segments WHERE rec NOT IN (SELECT rec FROM v_recordings)""")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return L.orphans(views.recordings(spark, d), views.segments(spark, d))


@query("split_channels", f"WITH {RECORDINGS} SELECT strftime(rec, '%Y-%m-%d') || '_ch' || c AS id, rec, c AS channel FROM (SELECT rec, CAST(unnest(range(channels)) AS INTEGER) AS c FROM v_recordings)")
def split_channels(spark: SparkSession, d: str) -> DataFrame:
    return L.split_channels(views.recordings(spark, d))


@query("path_parts", f"""WITH {FILES}, n AS (SELECT page_id, path, regexp_extract(path, '[^/]*$', 0) AS name, regexp_replace(path, '/[^/]*$', '') AS parent FROM v_files)
SELECT page_id, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, parent, parent || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.wav' AS wav FROM n""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return L.path_parts(views.files(spark, d))


@query("rewrite_sources", f"WITH {FILES} SELECT page_id, 1 AS n_sources, regexp_replace(path, '^https?://', 'data/16k/') AS source FROM v_files")
def rewrite_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = F.array(F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.col("path").alias("source")))
    moved = F.transform(sources, lambda s: s.withField("source", F.regexp_replace(s["source"], "^https?://", "data/16k/")))
    return views.files(spark, d).select("page_id", F.size(moved).alias("n_sources"), moved[0]["source"].alias("source"))


@query("resample_meta", f"""WITH {FILES}, r AS (SELECT page_id, n_samples AS n, CASE WHEN page_id % 3 = 0 THEN 44100 ELSE 16000 END AS sr FROM v_files),
m AS (SELECT page_id, CASE WHEN sr = 16000 THEN n ELSE (n * 32000 + sr) // (2 * sr) END AS n_samples FROM r)
SELECT page_id, n_samples, 16000 AS sampling_rate, ((n_samples * 2000 + 16000) // 32000) / 1000.0 AS duration FROM m""")
def resample_meta(spark: SparkSession, d: str) -> DataFrame:
    f = views.files(spark, d).withColumn("sampling_rate", F.when(F.col("page_id") % 3 == 0, 44100).otherwise(16000))
    return L.resampled(f, 16000)


STATUS = "CASE WHEN page_id % 7 = 0 THEN 'error' WHEN page_id % 5 = 0 THEN 'skipped' ELSE 'processed' END"


@query("resample_summary", f"SELECT {STATUS} AS status, count(*) AS files FROM pages GROUP BY 1")
def resample_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).select(F.expr(STATUS).alias("status")).groupBy("status").agg(F.count("*").alias("files"))


@query("rir_pairs", """WITH a AS (SELECT page_id, page_id // 5 AS room, 'room_' || page_id // 5 || '/src_' || page_id % 5 || '.flac' AS path FROM pages),
b AS (SELECT page_id, 'room_' || page_id // 5 || '/src_' || page_id % 5 || '-anechoic.flac' AS path FROM pages)
SELECT a.room, a.path, b.path AS anechoic FROM a JOIN b ON replace(a.path, '.flac', '-anechoic.flac') = b.path""")
def rir_pairs(spark: SparkSession, d: str) -> DataFrame:
    room, src = F.floor(F.col("page_id") / 5), F.col("page_id") % 5
    f = views.files(spark, d).select("page_id", room.alias("room"), F.concat(F.lit("room_"), room, F.lit("/src_"), src).alias("base"))
    a = f.select("room", F.concat("base", F.lit(".flac")).alias("path"))
    b = f.select(F.concat("base", F.lit("-anechoic.flac")).alias("anechoic"))
    return a.join(b, F.replace(a["path"], F.lit(".flac"), F.lit("-anechoic.flac")) == b["anechoic"]).select("room", "path", "anechoic")


@query("json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS encoded FROM events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k bigint")
    return views.table(spark, d, "events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("encoded"))


@query("md5_check", "SELECT page_id, md5(html) AS md5 FROM pages")
def md5_check(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", F.md5("html").alias("md5"))


@query("round_modes", f"""WITH {SEGMENTS}, x AS (SELECT id, dur_us / 100000.0 AS x FROM v_segments)
SELECT id, round(x) AS half_up, round_even(x, 0) AS half_even, CAST(trunc(x) AS BIGINT) AS whole, format('{{:.4f}}', x) AS text FROM x""")
def round_modes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("dur_us") / 100000.0
    return views.segments(spark, d).select("id", F.round(x, 0).alias("half_up"), F.bround(x, 0).alias("half_even"), x.cast("bigint").alias("whole"), F.format_string("%.4f", x).alias("text"))


@query("db_to_linear", f"WITH {SEGMENTS} SELECT id, round(pow(10.0, -(dur_us / 1e7) / 20.0), 6) AS gain FROM v_segments")
def db_to_linear(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).select("id", F.round(F.pow(F.lit(10.0), -(F.col("dur_us") / 1e7) / 20.0), 6).alias("gain"))


@query("clip", f"WITH {SEGMENTS} SELECT id, round(least(greatest(dur_us / 5e8, 0.03), 0.97), 6) AS share FROM v_segments")
def clip(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).select("id", F.round(F.least(F.greatest(F.col("dur_us") / 5e8, F.lit(0.03)), F.lit(0.97)), 6).alias("share"))
