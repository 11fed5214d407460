"""Queries that draw: samplers, rooms, and whole simulated meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..operators import library as L
from ..operators import sampling as S
from ..operators.simulate import SimConfig, simulate
from ..sources import views
from .registry import CUTS, SEGMENTS, query

SEED = 7
CONFIG = SimConfig(seed=SEED, max_concurrent_speakers=None)
MEETINGS = "meet AS (SELECT c_custkey AS meeting FROM customer)"
LIBRARY = SEGMENTS + ", lib AS (SELECT speaker, CAST(id AS VARCHAR) AS cut_id, dur_us FROM v_segments WHERE dur_us BETWEEN 0 AND 20000000)"
U = lambda *key: uniform_sql(SEED, *key)
N_SPEAKERS = f"CAST(2 + least(floor({U('meeting', chr(39) + 'n' + chr(39))} * 3), 2) AS BIGINT)"


def _meetings(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("meeting"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d).where(L.within("dur_us", 0, 20))
    return s.select("speaker", F.col("id").cast("string").alias("cut_id"), "dur_us")


@query("sample_n_speakers", f"WITH {MEETINGS} SELECT meeting, {N_SPEAKERS} AS n FROM meet")
def sample_n_speakers(spark: SparkSession, d: str) -> DataFrame:
    return _meetings(spark, d).select("meeting", S.n_speakers(SEED, 2, 4).alias("n"))


RANKED = LIBRARY + ", " + MEETINGS + f""", who AS (SELECT DISTINCT speaker FROM lib), ranked AS (
  SELECT meeting, speaker, row_number() OVER (PARTITION BY meeting ORDER BY {U('meeting', 'speaker', "'rank'")}, speaker) AS r,
    least({N_SPEAKERS}, (SELECT count(*) FROM who)) AS n FROM meet CROSS JOIN who)"""


@query("sample_speakers", f"WITH {RANKED} SELECT meeting, speaker, CAST(r - 1 AS INTEGER) AS rank FROM ranked WHERE r <= n")
def sample_speakers(spark: SparkSession, d: str) -> DataFrame:
    return S.speakers(_meetings(spark, d), _library(spark, d), SEED, 2, 4)


P_IND, P_MARKOV = [0.15, 0.45, 0.3, 0.1], [[0.1, 0.5, 0.25, 0.15], [0.3, 0.4, 0.2, 0.1], [0.2, 0.5, 0.2, 0.1], [0.4, 0.3, 0.2, 0.1]]


def _steps(p: list[float]) -> str:
    total, out = 0.0, []
    for x in p[:-1]:
        total = round(total + x, 12)
        out.append(f"CAST({U('id', chr(39) + 'type' + chr(39))} >= {total} AS INTEGER)")
    return "(" + " + ".join(out) + ")"


@query("sample_transition", f"""WITH {SEGMENTS} SELECT id, CAST(CASE WHEN id % 5 = 4 THEN {_steps(P_IND)} WHEN id % 5 = 0 THEN {_steps(P_MARKOV[0])} WHEN id % 5 = 1 THEN {_steps(P_MARKOV[1])}
  WHEN id % 5 = 2 THEN {_steps(P_MARKOV[2])} ELSE {_steps(P_MARKOV[3])} END AS INTEGER) AS type FROM v_segments""")
def sample_transition(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d).withColumn("prev", F.when(F.col("id") % 5 < 4, F.col("id") % 5))
    return s.select("id", S.transition(uniform(SEED, "id", F.lit("type")), F.col("prev"), P_IND, P_MARKOV).cast("int").alias("type"))


@query("sample_gap", f"""WITH {SEGMENTS} SELECT id, CAST(floor(-CASE WHEN id % 2 = 0 THEN 0.57 ELSE 0.4 END * ln({U('id', "'gap'")}) * 1e6) AS BIGINT) AS gap_us FROM v_segments""")
def sample_gap(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).select("id", S.gap_us(uniform(SEED, "id", F.lit("gap")), F.col("id") % 2, CONFIG.betas).alias("gap_us"))


@query("sample_overlap", f"""WITH {SEGMENTS} SELECT id, round(least(greatest(-0.44 * ln({U('id', "'gap'")}), 0.03), 0.97), 6) AS share FROM v_segments""")
def sample_overlap(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).select("id", F.round(S.overlap_share(uniform(SEED, "id", F.lit("gap")), 0.44), 6).alias("share"))


@query("sample_next_speaker", f"""WITH {SEGMENTS} SELECT id, list_filter([0, 1, 2, 3], lambda s: s <> speaker)[CAST(least(floor({U('id', "'spk'")} * 3), 2) AS BIGINT) + 1] AS next_speaker FROM v_segments""")
def sample_next_speaker(spark: SparkSession, d: str) -> DataFrame:
    who = F.array(*[F.lit(k) for k in range(4)])
    return views.segments(spark, d).select("id", S.next_speaker(uniform(SEED, "id", F.lit("spk")), who, F.col("speaker").cast("int")).cast("int").alias("next_speaker"))


@query("sample_cuts", f"""WITH {LIBRARY}, ix AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY cut_id) - 1 AS pos, cut_id, dur_us, count(*) OVER (PARTITION BY speaker) AS n FROM lib),
dr AS (SELECT s.id, s.speaker, least(CAST(floor({U('id', "'cut'")} * k.n) AS BIGINT), k.n - 1) AS pos FROM v_segments s JOIN (SELECT speaker, count(*) AS n FROM lib GROUP BY speaker) k ON k.speaker = s.speaker)
SELECT dr.id, dr.speaker, dr.pos, ix.cut_id, ix.dur_us FROM dr JOIN ix ON ix.speaker = dr.speaker AND ix.pos = dr.pos""")
def sample_cuts(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_cuts(views.segments(spark, d).select("id", "speaker"), L.cut_index(_library(spark, d)), SEED)


@query("augment_flags", f"""WITH {MEETINGS} SELECT meeting, {U('meeting', "'reverb'")} < 0.5 AS reverb, {U('meeting', "'noise'")} < 0.5 AS noise FROM meet""")
def augment_flags(spark: SparkSession, d: str) -> DataFrame:
    return S.flags(_meetings(spark, d), SEED, 0.5, 0.5)


@query("speed_perturb", f"""WITH {CUTS}, f AS (SELECT cut_id, speaker, dur_us, round(0.95 + {U('cut_id', "'speed'")} * 0.1, 6) AS factor FROM v_cuts)
SELECT f.cut_id, f.speaker, factor, CAST(floor(f.dur_us / factor) AS BIGINT) AS dur_us, CAST(sum(floor(w.start_us / factor)) AS BIGINT) AS word_starts
FROM f JOIN v_words w ON f.cut_id = w.conv_id || '_' || w.turn GROUP BY ALL""")
def speed_perturb(spark: SparkSession, d: str) -> DataFrame:
    starts = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + w["start_us"])
    return S.perturbed(views.cuts(spark, d), SEED, 0.95, 1.05).withColumn("word_starts", starts).drop("words")


def _attempt(what: str) -> str:
    return U("room_id", "a", f"'{what}'")


ROOMS = f"""ids AS (SELECT p_partkey AS room_id FROM part), l0 AS (
  SELECT room_id, a, 5.0 + {_attempt('l')} * 5.0 AS l, 3.0 + {_attempt('z')} * 2.0 AS z, 0.1 + {_attempt('rt60')} * (0.7 - 0.1) AS rt60, {_attempt('w')} AS uw
  FROM ids CROSS JOIN (SELECT i AS a FROM range(16) t(i))), l1 AS (SELECT *, l / 2 + uw * (10.0 - l / 2) AS w FROM l0), l2 AS (
  SELECT *, (24 * 2.302585092994046 / 343.0) * (l * w * z) / (2 * (l * w + l * z + w * z) * rt60) AS absorption FROM l1), r AS (
  SELECT * FROM l2 WHERE absorption <= 1 QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY a) = 1), m AS (
  SELECT room_id, a AS attempt, l, w, z, rt60, absorption, 0.5 + {U('room_id', "'mx'")} * (l - 1.0) AS mic_x, 0.5 + {U('room_id', "'my'")} * (w - 1.0) AS mic_y,
    0.5 + {U('room_id', "'mz'")} * (z - 0.5 - 0.5) AS mic_z FROM r), s0 AS (
  SELECT m.*, t.a AS try_, 0.5 + {U('room_id', 't.a', "'sx'")} * (l - 1.0) AS src_x, 0.5 + {U('room_id', 't.a', "'sy'")} * (w - 1.0) AS src_y, 0.5 + {U('room_id', 't.a', "'sz'")} * 1.5 AS src_z
  FROM m CROSS JOIN (SELECT i AS a FROM range(16) t(i)) t), s1 AS (
  SELECT *, sqrt((src_x - mic_x) ** 2 + (src_y - mic_y) ** 2 + (src_z - mic_z) ** 2) AS distance FROM s0), placed AS (
  SELECT * FROM s1 WHERE distance > 1 QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY try_) = 1)"""
ROOM_COLUMNS = ["l", "w", "z", "rt60", "absorption", "mic_x", "mic_y", "mic_z", "src_x", "src_y", "src_z", "distance"]


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _rooms(spark: SparkSession, d: str, wanted: DataFrame | None = None) -> DataFrame:
    """All rooms, or those whose room_id is wanted; ids are spread first, as a file of them is small and its rooms are much work."""
    ids = views.table(spark, d, "part").select(F.col("p_partkey").alias("room_id"))
    ids = ids if wanted is None else ids.join(wanted, "room_id", "left_semi")
    return S.rooms(ids.repartition(_partitions(spark), "room_id"), SEED)


@query("sample_rooms", f"WITH {ROOMS} SELECT room_id, CAST(attempt AS INTEGER) AS attempt, {', '.join(f'round({c}, 6) AS {c}' for c in ROOM_COLUMNS)} FROM placed")
def sample_rooms(spark: SparkSession, d: str) -> DataFrame:
    return _rooms(spark, d).select("room_id", "attempt", *[F.round(c, 6).alias(c) for c in ROOM_COLUMNS])


@query("rir_direct_path", f"WITH {ROOMS} SELECT room_id, CAST(floor(distance * 16000 / 343.0 + 0.5) AS BIGINT) AS delay FROM placed")
def rir_direct_path(spark: SparkSession, d: str) -> DataFrame:
    return _rooms(spark, d).select("room_id", S.direct_path_delay(F.col("distance")).alias("delay"))


def _draw(what: str) -> str:
    return U("meeting", "step", f"'{what}'")


MARKOV = ((0.4, 0.3, 0.2, 0.1), (0.2, 0.5, 0.2, 0.1), (0.3, 0.3, 0.1, 0.3), (0.5, 0.2, 0.2, 0.1))


def _kind(p: tuple[float, ...]) -> str:
    """Index of the class that the draw of a type falls into."""
    ends = [round(sum(p[: k + 1]), 12) for k in range(len(p) - 1)]
    return " + ".join(f"CAST({_draw('type')} >= {e} AS INTEGER)" for e in ends)


def _sim(limit: int | None = None, markov: tuple[tuple[float, ...], ...] | None = None) -> str:
    """A meeting row by row: the state is the list of times at which each chosen speaker is free (-1: silent so far), and all that was said."""
    first = _kind((0.25,) * 4)
    kind = first if markov is None else "CASE before_kind " + " ".join(f"WHEN {k} THEN {_kind(row)}" for k, row in enumerate(markov)) + " END"
    cut = f"least(CAST(floor({_draw('cut')} * b.k) AS BIGINT), b.k - 1) + 1"
    start, start_us, said = f"CAST(floor({_draw('start')} * 1e6) AS BIGINT)", "start_us", ""
    if limit is not None:
        # no more than the limit at once at the start of anything said during the utterance, by the others and the new one
        others = "list_distinct(list_transform(list_filter(said, lambda y: y.b > y.a AND y.a <= greatest(x.a, t) AND y.b > greatest(x.a, t) AND y.s <> idx), lambda y: y.s))"
        crowded = f"list_filter(said, lambda x: x.a < t + dur_us AND x.b > t AND x.b > x.a AND 1 + len({others}) > {limit})"
        times = "list_concat([start_us], list_sort(list_filter(list_transform(said, lambda x: x.b), lambda t: t > start_us)))"
        start_us = f"coalesce(list_filter({times}, lambda t: len({crowded}) = 0)[1], greatest(said[len(said)].b, start_us))"
        said = ", list_append(said, {'s': idx, 'a': start_us, 'b': start_us + dur_us}) AS said"
    return RANKED + f""", chosen AS (SELECT meeting, list(speaker ORDER BY r) AS spk, count(*) AS n FROM ranked WHERE r <= n GROUP BY meeting), by_speaker AS (
  SELECT speaker, list(cut_id ORDER BY cut_id) AS ids, list(dur_us ORDER BY cut_id) AS durs, count(*) AS k FROM lib GROUP BY speaker), sim AS (
  SELECT meeting, step, spk, n, idx, -1 AS shown, kind, {start} AS start_us, b.durs[{cut}] AS dur_us, b.ids[{cut}] AS cut_id,
    list_transform(range(1, n + 1), lambda i: CASE WHEN i = idx THEN {start} + b.durs[{cut}] ELSE -1 END) AS free{f", [{{'s': idx, 'a': {start}, 'b': {start} + b.durs[{cut}]}}] AS said" * (limit is not None)}
  FROM (SELECT *, CAST(least(floor({_draw('spk')} * n), n - 1) AS BIGINT) + 1 AS idx, {first} AS kind
    FROM (SELECT *, CAST(0 AS INTEGER) AS step FROM chosen)) c JOIN by_speaker b ON b.speaker = c.spk[c.idx]
  UNION ALL
  SELECT meeting, step, spk, n, idx, kind AS shown, kind, start_us, dur_us, cut_id,
    list_transform(range(1, n + 1), lambda i: CASE WHEN i <> idx THEN free[i] WHEN free[i] < 0 THEN start_us + dur_us ELSE greatest(start_us + dur_us + 10000, free[i]) END){said}
  FROM (SELECT * REPLACE ({start_us} AS start_us) FROM (
    SELECT e.*, greatest(CASE
        WHEN kind = 0 OR n = 1 THEN before_end + CAST(floor(-0.57 * ln({_draw('gap')}) * 1e6) AS BIGINT)
        WHEN kind = 1 THEN before_end + CAST(floor(-0.4 * ln({_draw('gap')}) * 1e6) AS BIGINT)
        ELSE before_end - CAST(floor(least(greatest(-CASE WHEN kind = 2 THEN 0.44 ELSE 0.67 END * ln({_draw('gap')}), 0.03), 0.97) * before_dur) AS BIGINT) END,
        CASE WHEN free[idx] >= 0 THEN free[idx] ELSE 0 END) AS start_us, b.durs[{cut}] AS dur_us, b.ids[{cut}] AS cut_id
    FROM (
      SELECT *, CASE WHEN kind = 0 OR n = 1 THEN prev WHEN j < prev THEN j ELSE j + 1 END AS idx
      FROM (SELECT *, CAST(least(floor({_draw('spk')} * (n - 1)), n - 2) AS BIGINT) + 1 AS j, {kind} AS kind
        FROM (SELECT meeting, CAST(step + 1 AS INTEGER) AS step, spk, n, idx AS prev, kind AS before_kind, start_us + dur_us AS before_end, dur_us AS before_dur, free{', said' * (limit is not None)} FROM sim
          WHERE start_us + dur_us < 60000000 OR len(list_filter(free, lambda t: t >= 0)) < n))) e
    JOIN by_speaker b ON b.speaker = e.spk[e.idx])))"""


SIM = _sim()
MEETING_ROWS = "SELECT meeting, step, spk[idx] AS speaker, cut_id, shown AS type, start_us, dur_us FROM sim"


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    return simulate(_meetings(spark, d), _library(spark, d), CONFIG)


@query("simulate", f"WITH RECURSIVE {SIM} {MEETING_ROWS}")
def simulated(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d)


@query("simulate_concurrent", f"WITH RECURSIVE {_sim(2)} {MEETING_ROWS}")
def simulate_concurrent(spark: SparkSession, d: str) -> DataFrame:
    """With at most two speakers at once."""
    return simulate(_meetings(spark, d), _library(spark, d), SimConfig(seed=SEED, max_concurrent_speakers=2))


@query("simulate_markov", f"WITH RECURSIVE {_sim(3, MARKOV)} {MEETING_ROWS}")
def simulate_markov(spark: SparkSession, d: str) -> DataFrame:
    """With turn types that depend on the one before, and at most three speakers at once."""
    return simulate(_meetings(spark, d), _library(spark, d), SimConfig(seed=SEED, max_concurrent_speakers=3, p_markov=MARKOV))


NAMES = "CASE type WHEN -1 THEN 'FIRST' WHEN 0 THEN 'TH' WHEN 1 THEN 'TS' WHEN 2 THEN 'IR' ELSE 'BC' END"


@query("sim_segments", f"""WITH RECURSIVE {SIM} SELECT meeting || '_' || lpad(CAST(step AS VARCHAR), 4, '0') AS id, meeting, speaker, round(start_us / 1e6, 6) AS start, round(dur_us / 1e6, 6) AS duration, {NAMES} AS transition_type, cut_id AS original_cut_id
FROM (SELECT *, shown AS type, spk[idx] AS speaker FROM (SELECT meeting, step, spk, idx, shown, start_us, dur_us, cut_id FROM sim))""")
def sim_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _simulated(spark, d)
    return s.select(F.concat_ws("_", "meeting", F.lpad(F.col("step").cast("string"), 4, "0")).alias("id"), "meeting", "speaker", F.round(F.col("start_us") / 1e6, 6).alias("start"),
                    F.round(F.col("dur_us") / 1e6, 6).alias("duration"), F.expr(NAMES).alias("transition_type"), F.col("cut_id").alias("original_cut_id"))


@query("sim_recordings", f"""WITH RECURSIVE {SIM} SELECT meeting, md5('{SEED}|' || meeting) AS id, count(*) AS utterances, count(DISTINCT spk[idx]) AS speakers, CAST(max(start_us + dur_us) AS BIGINT) AS end_us,
  CAST(max(start_us + dur_us) * 16000 // 1000000 AS BIGINT) AS num_samples FROM sim GROUP BY meeting""")
def sim_recordings(spark: SparkSession, d: str) -> DataFrame:
    end = F.max(F.col("start_us") + F.col("dur_us"))
    g = _simulated(spark, d).groupBy("meeting").agg(F.count("*").alias("utterances"), F.countDistinct("speaker").alias("speakers"), end.alias("end_us"))
    return g.select("meeting", F.md5(F.concat_ws("|", F.lit(str(SEED)), "meeting")).alias("id"), "utterances", "speakers", "end_us", F.floor(F.col("end_us") * 16000 / 1000000).alias("num_samples"))


LEVEL = f"""round(-35.0 + {U('meeting', "'base'")} * 27.0 + (-12.0 + {_draw('rel')} * 17.0), 6)"""


@query("speech_levels", f"WITH RECURSIVE {SIM} SELECT meeting, step, {LEVEL} AS level_db FROM sim")
def speech_levels(spark: SparkSession, d: str) -> DataFrame:
    return S.levels(_simulated(spark, d), SEED, CONFIG.base_gain, CONFIG.rel_gain)


@query("min_speech_level", f"WITH RECURSIVE {SIM} SELECT meeting, min({LEVEL}) AS level_db FROM sim GROUP BY meeting")
def min_speech_level(spark: SparkSession, d: str) -> DataFrame:
    return S.levels(_simulated(spark, d), SEED, CONFIG.base_gain, CONFIG.rel_gain).groupBy("meeting").agg(F.min("level_db").alias("level_db"))


@query("weighted_mix", f"""WITH {SEGMENTS} SELECT id, speaker FROM v_segments WHERE {U('id', "'mix'")} < CASE speaker WHEN 0 THEN 3.0 / 3 WHEN 1 THEN 3.0 / 3 WHEN 2 THEN 1.0 / 3 ELSE 0.0 END""")
def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_mix(views.segments(spark, d), "speaker", {0: 3, 1: 3, 2: 1}, SEED, "id").select("id", "speaker")
