"""Queries over signals: levels, filters, fades, mixtures, noise."""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import pick, uniform, uniform_sql
from ..operators import audio, render, signal
from ..operators.simulate import draw
from ..sources import views
from .registry import SIGNALS, query
from .sampling import SEED, _partitions, _rooms

TAPS = signal.fir_highpass()
RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"
PEAK = "list_max(list_transform(x, lambda v: abs(v)))"


def _round(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v, 6) + 0.0)"


@query("dc_remove", f"WITH {SIGNALS} SELECT sig_id, {_round('list_transform(x, lambda v: v - list_sum(x) / len(x))')} AS y FROM v_signals")
def dc_remove(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.dc_remove(F.col("x"))).alias("y"))


@query("peak", f"WITH {SIGNALS} SELECT sig_id, round({PEAK}, 6) AS peak FROM v_signals")
def peak(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", F.round(signal.peak(F.col("x")), 6).alias("peak"))


@query("rms_normalize", f"""WITH {SIGNALS}, g AS (SELECT *, CASE WHEN {RMS} > 0 THEN pow(10.0, -20.0 / 20) / {RMS} ELSE 1e-8 END AS g, {RMS} > 0 AS loud FROM v_signals)
SELECT sig_id, round(g, 6) AS gain, {_round('CASE WHEN loud THEN list_transform(x, lambda v: v * g) ELSE x END')} AS y FROM g""")
def rms_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return views.signals(spark, d).select("sig_id", F.round(signal.gain_to(x, -20.0), 6).alias("gain"), signal.rounded(signal.normalize(x, -20.0)).alias("y"))


@query("peak_guard", f"""WITH {SIGNALS}, a AS (SELECT sig_id, list_transform(x, lambda v: v * 3.0) AS x FROM v_signals), p AS (SELECT *, {PEAK} AS p FROM a)
SELECT sig_id, p > 0.99 AS scaled, {_round('CASE WHEN p > 0.99 THEN list_transform(x, lambda v: v * (0.99 / p)) ELSE x END')} AS y FROM p""")
def peak_guard(spark: SparkSession, d: str) -> DataFrame:
    s = views.signals(spark, d).withColumn("x", F.transform("x", lambda v: v * 3.0))
    return s.select("sig_id", (signal.peak(F.col("x")) > 0.99).alias("scaled"), signal.rounded(signal.peak_guard(F.col("x"))).alias("y"))


FIR = """ideal AS (SELECT i AS k, (CASE WHEN i = 31 THEN 0.005 ELSE sin(pi() * 0.005 * (i - 31)) / (pi() * (i - 31)) END) * (0.54 - 0.46 * cos(2 * pi() * i / 62)) AS h FROM range(63) t(i)),
  taps AS (SELECT k, -h / (SELECT sum(h) FROM ideal) + CASE WHEN k = 31 THEN 1.0 ELSE 0.0 END AS h FROM ideal)"""


@query("fir_taps", f"WITH {FIR} SELECT k, round(h, 9) AS tap FROM taps")
def fir_taps(spark: SparkSession, d: str) -> DataFrame:
    h = F.array(*[F.lit(round(t, 9)) for t in TAPS])
    return spark.range(1).select(F.posexplode(h).alias("k", "tap")).select(F.col("k").cast("bigint").alias("k"), "tap")


@query("fir_convolve", f"""WITH {SIGNALS}, {FIR}, s AS (SELECT sig_id, unnest(x) AS v, unnest(range(len(x))) AS i FROM v_signals),
  y AS (SELECT sig_id, i + k AS j, sum(v * h) AS v FROM s CROSS JOIN taps GROUP BY 1, 2) SELECT sig_id, list(round(v, 6) + 0.0 ORDER BY j) AS y FROM y GROUP BY sig_id""")
def fir_convolve(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.convolve(F.col("x"), TAPS)).alias("y"))


@query("rir_trim", f"""WITH {SIGNALS}, p AS (SELECT *, list_position(list_transform(x, lambda v: abs(v)), {PEAK}) AS first FROM v_signals) SELECT sig_id, {_round('x[first:]')} AS y FROM p""")
def rir_trim(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.trim_to_direct_path(F.col("x"))).alias("y"))


@query("pad_trim", f"""WITH {SIGNALS}, n AS (SELECT *, CASE WHEN sig_id % 2 = 0 THEN 80 ELSE 48 END AS n FROM v_signals)
SELECT sig_id, {_round('list_transform(range(1, n + 1), lambda i: coalesce(x[i], 0.0))')} AS y FROM n""")
def pad_trim(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("sig_id") % 2 == 0, 80).otherwise(48)
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.fit_length(F.col("x"), n)).alias("y"))


def _fade(a: str, b: str, samples: int) -> str:
    """DuckDB list of a and b faded into each other; both are columns."""
    k = f"least({samples}, len({b}) // 4, len({a}))"
    at = f"(pi() * (i - 1) / {k})"
    middle = f"list_transform(range(1, {k} + 1), lambda i: {a}[len({a}) - {k} + i] * ((1 + cos{at}) / 2) + {b}[i] * ((1 - cos{at}) / 2))"
    return f"list_concat(list_concat({a}[1:len({a}) - {k}], {middle}), {b}[{k} + 1:])"


@query("crossfade_concat", f"WITH {SIGNALS}, t AS (SELECT sig_id, x AS a, list_reverse(x) AS b FROM v_signals) SELECT sig_id, {_round(_fade('a', 'b', 10))} AS y FROM t")
def crossfade_concat(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.crossfade(F.col("x"), F.reverse("x"), 10)).alias("y"))


@query("crossfade_repeat", f"""WITH {SIGNALS}, r1 AS (SELECT sig_id, x AS b, {_fade('x', 'x', 8)} AS a FROM v_signals), r2 AS (SELECT sig_id, b, {_fade('a', 'b', 8)} AS a FROM r1),
  r3 AS (SELECT sig_id, {_fade('a', 'b', 8)} AS a FROM r2) SELECT sig_id, {_round('a[1:200]')} AS y FROM r3""")
def crossfade_repeat(spark: SparkSession, d: str) -> DataFrame:
    return views.signals(spark, d).select("sig_id", signal.rounded(signal.repeat_to(F.col("x"), 200, 8, 4)).alias("y"))


def _mixed(keys: str) -> str:
    return f"""WITH {SIGNALS}, p AS (SELECT sig_id // 25 AS rec, speaker, (sig_id % 25) * 16 AS off, x FROM v_signals), s AS (SELECT {keys}, off + unnest(range(len(x))) AS i, unnest(x) AS v FROM p),
  y AS (SELECT {keys}, i, sum(v) AS v FROM s GROUP BY ALL), n AS (SELECT {keys}, max(i) + 1 AS n_samples FROM y GROUP BY ALL), f AS (SELECT *, unnest(range(n_samples)) AS i FROM n)
SELECT {', '.join('f.' + k.strip() for k in keys.split(','))}, f.n_samples, list(round(coalesce(v, 0.0), 6) + 0.0 ORDER BY f.i) AS mix FROM f LEFT JOIN y ON {' AND '.join(f'f.{k.strip()} = y.{k.strip()}' for k in keys.split(','))} AND f.i = y.i GROUP BY ALL"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    s = views.signals(spark, d)
    return s.select(F.floor(F.col("sig_id") / 25).alias("rec"), "speaker", ((F.col("sig_id") % 25) * 16).alias("offset"), "x")


@query("mix", _mixed("rec"))
def mix(spark: SparkSession, d: str) -> DataFrame:
    return signal.mix(_pieces(spark, d), ["rec"]).withColumn("mix", signal.rounded(F.col("mix")))


@query("mix_per_speaker", _mixed("rec, speaker"))
def mix_per_speaker(spark: SparkSession, d: str) -> DataFrame:
    return signal.mix(_pieces(spark, d), ["rec", "speaker"]).withColumn("mix", signal.rounded(F.col("mix")))


RENDER = render.RenderConfig(seed=SEED, rate=100, speakers=True, chunk=128)
LEVEL = f"round(-35.0 + {uniform_sql(SEED, 'meeting', chr(39) + 'base' + chr(39))} * 27.0 + (-12.0 + {uniform_sql(SEED, 'meeting', 'step', chr(39) + 'rel' + chr(39))} * 17.0), 6)"


@query("render_meetings", f"""WITH {SIGNALS}, t AS (SELECT sig_id // 25 AS meeting, sig_id % 25 AS step, speaker, (sig_id % 25) * 16 AS off, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM v_signals),
  v AS (SELECT meeting, step, speaker, off, {LEVEL} AS level_db, {RMS} AS r, x FROM t), s AS (
  SELECT meeting, unnest(['mix', 'spk-' || speaker]) AS stem, off, CASE WHEN r > 0 THEN list_transform(x, lambda v: v * (pow(10.0, level_db / 20) / r)) ELSE x END AS x FROM v), y AS (
  SELECT meeting, stem, i, sum(v) AS v FROM (SELECT meeting, stem, off + unnest(range(len(x))) AS i, unnest(x) AS v FROM s) GROUP BY ALL), p AS (
  SELECT meeting, max(abs(v)) AS p FROM y WHERE stem = 'mix' GROUP BY meeting), g AS (
  SELECT meeting, stem, i // 128 AS chunk, i, v * CASE WHEN p > 0.99 THEN 0.99 / p ELSE 1.0 END AS v FROM y JOIN p USING (meeting)), n AS (
  SELECT meeting, stem, chunk, max(i) AS last FROM g GROUP BY ALL), f AS (SELECT meeting, stem, chunk, unnest(range(chunk * 128, last + 1)) AS i FROM n)
SELECT f.meeting, f.stem, f.chunk, list(round(coalesce(v, 0.0), 6) + 0.0 ORDER BY f.i) AS x FROM f LEFT JOIN g ON f.meeting = g.meeting AND f.stem = g.stem AND f.i = g.i GROUP BY ALL""")
def render_meetings(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures and speakers' stems of all signals, at their levels and below the peak limit, at 100 Hz in chunks of 128 samples."""
    s = views.signals(spark, d)
    timeline = s.select(F.floor(F.col("sig_id") / 25).alias("meeting"), (F.col("sig_id") % 25).alias("step"), "speaker", F.col("sig_id").cast("string").alias("cut_id"), ((F.col("sig_id") % 25) * 160_000).alias("start_us"))
    sound = s.select(F.col("sig_id").cast("string").alias("cut_id"), "x")
    return render.meetings(timeline, sound, RENDER).withColumn("x", signal.rounded(F.col("x")))


A, B = (uniform_sql(SEED, "sig_id", "i - 1", f"'{p}'") for p in "ab")


@query("gauss_noise", f"""WITH {SIGNALS} SELECT sig_id, {_round(f"list_transform(range(1, len(x) + 1), lambda i: x[i] + 0.01 * sqrt(-2 * ln({A})) * cos(2 * pi() * {B}))")} AS y FROM v_signals""")
def gauss_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise of RMS 0.01 from keyed uniforms (Box and Muller), so that a task that is redone gives the same."""
    def noisy(v, i):  # noqa: ANN001, ANN202
        a, b = (uniform(SEED, "sig_id", i, F.lit(p)) for p in "ab")
        return v + 0.01 * F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)

    return views.signals(spark, d).select("sig_id", signal.rounded(F.transform("x", noisy)).alias("y"))


START = f"CAST(least(floor({uniform_sql(SEED, 'sig_id', chr(39) + 'crop' + chr(39))} * (len(x) - 16 + 1)), len(x) - 16) AS BIGINT)"


@query("slice_noise", f"WITH {SIGNALS}, s AS (SELECT *, {START} AS start FROM v_signals) SELECT sig_id, start, {_round('x[start + 1:start + 16]')} AS y FROM s")
def slice_noise(spark: SparkSession, d: str) -> DataFrame:
    start = pick(uniform(SEED, "sig_id", F.lit("crop")), F.size("x") - 15)
    return views.signals(spark, d).withColumn("start", start).select("sig_id", "start", signal.rounded(F.slice("x", (F.col("start") + 1).cast("int"), F.lit(16))).alias("y"))


@query("real_noise_single", f"""WITH {SIGNALS}, s AS (SELECT *, {START} AS start FROM v_signals), l AS (SELECT sig_id, list_transform(range(160), lambda i: x[(start + i) % len(x) + 1]) AS x FROM s),
  g AS (SELECT *, pow(10.0, -30.0 / 20) / {RMS} AS g FROM l) SELECT sig_id, {_round('list_transform(x, lambda v: v * g)')} AS y FROM g""")
def real_noise_single(spark: SparkSession, d: str) -> DataFrame:
    s = views.signals(spark, d).withColumn("start", pick(uniform(SEED, "sig_id", F.lit("crop")), F.size("x") - 15))
    looped = F.transform(F.sequence(F.lit(0), F.lit(159)), lambda i: F.element_at("x", ((F.col("start") + i) % F.size("x") + 1).cast("int")))
    return s.withColumn("x", looped).select("sig_id", signal.rounded(signal.normalize(F.col("x"), -30.0)).alias("y"))


def _bed() -> str:
    """Nine files of 64 samples fill 512, as each after the first is faded in over 8."""
    level = "pow(10.0, -30.0 / 20)"
    chosen = ", ".join(f"files[CAST(least(floor({uniform_sql(SEED, 'rec', str(j), chr(39) + 'noise' + chr(39))} * n), n - 1) AS BIGINT) + 1] AS f{j}" for j in range(9))
    steps = ["b0 AS (SELECT *, f0 AS a FROM c)"] + [f"b{j} AS (SELECT * REPLACE ({_fade('a', f'f{j}', 8)} AS a) FROM b{j - 1})" for j in range(1, 9)]
    return f"""WITH {SIGNALS}, l AS (SELECT sig_id // 25 AS rec, sig_id, CASE WHEN {RMS} > 0 THEN list_transform(x, lambda v: v * ({level} / {RMS})) ELSE x END AS x FROM v_signals),
  g AS (SELECT rec, list(x ORDER BY sig_id) AS files, count(*) AS n FROM l GROUP BY rec), c AS (SELECT rec, {chosen} FROM g), {', '.join(steps)}, x AS (SELECT rec, a[1:512] AS x FROM b8)
SELECT rec, {_round(f'list_transform(x, lambda v: v * ({level} / {RMS}))')} AS y FROM x"""


@query("real_noise_multi", _bed())
def real_noise_multi(spark: SparkSession, d: str) -> DataFrame:
    """A bed of 512 samples a recording out of its signals as noise files."""
    def bed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        rec = int(rows["rec"].iloc[0])
        y = audio.noise_bed([np.asarray(x) for x in rows["x"]], 512, 8, -30.0, lambda j: draw(SEED, rec, j, "noise"))
        return pd.DataFrame({"rec": [rec], "y": [(np.round(y, 6) + 0.0).tolist()]})

    return _pieces(spark, d).groupBy("rec").applyInPandas(bed, "rec bigint, y array<double>")


@query("resample", f"""WITH {SIGNALS}, n AS (SELECT sig_id, x, unnest(range(CAST(ceil(len(x) / 2.0) AS BIGINT))) AS n FROM v_signals), k AS (SELECT sig_id, n, unnest(x) AS v, 2 * n - unnest(range(len(x))) AS t FROM n),
  y AS (SELECT sig_id, n, sum(v * 0.5 * (CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * 0.5 * t) / (pi() * 0.5 * t) END) * CASE WHEN abs(t) < 32 THEN 0.5 + 0.5 * cos(pi() * t / 32) ELSE 0 END) AS v FROM k GROUP BY 1, 2)
SELECT sig_id, list(round(v, 6) + 0.0 ORDER BY n) AS x FROM y GROUP BY sig_id""")
def resample(spark: SparkSession, d: str) -> DataFrame:
    """From 16 kHz to 8 kHz by windowed sinc."""
    return audio.resample_signals(views.signals(spark, d), 16000, 8000).select("sig_id", signal.rounded(F.col("x")).alias("x"))


@query("rir_image_source")
def rir_image_source(spark: SparkSession, d: str) -> DataFrame:
    """Impulse responses of all sampled rooms; tests compare the direct path with the geometry and the length with rt60."""
    return audio.room_responses(_rooms(spark, d)).drop("position")


@query("rir_convolve")
def rir_convolve(spark: SparkSession, d: str) -> DataFrame:
    """Each signal reverberated in the room of its number (modulo the rooms), trimmed to the direct path."""
    parts = views.table(spark, d, "part").agg(F.count("*").alias("n"))
    s = views.signals(spark, d).crossJoin(F.broadcast(parts)).withColumn("room_id", F.col("sig_id") % F.col("n") + 1).drop("n")
    rooms = _rooms(spark, d, s.select("room_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rooms travel as geometry; a room's signals come together, so its response is made once
        last, h = None, np.zeros(0)
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part, out = b.slice(at, 32), []
                for r in part.to_pylist():
                    if r["room_id"] != last:
                        last, h = r["room_id"], audio.room_response(SimpleNamespace(**r))[0]
                        h = h[int(np.abs(h).argmax()) :]
                    out.append(np.round(np.convolve(np.asarray(r["x"]), h), 6))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("sig_id")), audio.lists(out)], names=["sig_id", "y"])

    joined = s.select("room_id", "sig_id", "x").join(rooms, "room_id").repartition(_partitions(spark), "room_id").sortWithinPartitions("room_id")
    return joined.mapInArrow(run, "sig_id bigint, y array<double>")


@query("euclid", f"WITH {SIGNALS} SELECT sig_id, round(sqrt((x[1] - 0.1) ** 2 + (x[2] - 0.2) ** 2 + (x[3] - 0.3) ** 2), 6) AS distance FROM v_signals")
def euclid(spark: SparkSession, d: str) -> DataFrame:
    target = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))
    squares = F.zip_with(F.slice("x", 1, 3), target, lambda a, b: (a - b) * (a - b))
    return views.signals(spark, d).select("sig_id", F.round(F.sqrt(signal.total(squares)), 6).alias("distance"))
