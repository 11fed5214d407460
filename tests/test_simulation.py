"""Draws, whole meetings, signals, files, stages and streams."""

from __future__ import annotations

import datetime
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnloom import pipeline
from turnloom.functions import rng
from turnloom.operators import audio, intervals, sampling, signal
from turnloom.operators import simulate as simulate_module
from turnloom.operators.simulate import SimConfig, draw, place_utterance, simulate
from turnloom.plans import sampling as room_plans
from turnloom.plans import signals as sig_plans
from turnloom.sources import views
from turnloom.streaming import turns as live

LIBRARY = [(s, f"{s}-{k}", 1_000_000 + 700_000 * k) for s in range(4) for k in range(6)]


def library(spark):
    return spark.createDataFrame(LIBRARY, "speaker bigint, cut_id string, dur_us bigint")


def meetings(spark, n=40):
    return spark.range(n).withColumnRenamed("id", "meeting")


def test_uniforms_are_those_of_python(spark):
    got = [r.u for r in spark.range(5).select(rng.uniform(3, "id", F.lit("x")).alias("u")).collect()]
    assert got == [draw(3, k, "x") for k in range(5)]


def test_categorical(spark):
    u = [0.0, 0.1, 0.15, 0.59, 0.6, 0.9, 0.999]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    assert [r.k for r in df.select(rng.categorical(F.col("u"), [0.15, 0.45, 0.3, 0.1]).alias("k")).collect()] == [0, 0, 1, 1, 2, 3, 3]


def timelines(spark, config, n=40, parts=3):
    rows = simulate(meetings(spark, n).repartition(parts), library(spark), config).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.meeting, r.step)):
        out.setdefault(r.meeting, []).append(r)
    return out


def test_meetings_hold_the_rules(spark):
    for meeting in timelines(spark, SimConfig(max_concurrent_speakers=2)).values():
        own: dict = {}
        assert meeting[0].type == -1 and 2 <= len({r.speaker for r in meeting}) <= 4
        for r in meeting:
            assert r.start_us >= own.get(r.speaker, 0)  # nobody talks over themselves
            own[r.speaker] = max(own.get(r.speaker, 0), r.start_us + r.dur_us)
        last = meeting[-1]
        assert last.start_us + last.dur_us >= 60_000_000


def test_partitioning_does_not_matter(spark):
    config = SimConfig()
    assert timelines(spark, config, parts=1) == timelines(spark, config, parts=7)


def test_a_library_that_is_joined_gives_the_same(spark, monkeypatch):
    want = timelines(spark, SimConfig(), 15)
    monkeypatch.setattr(simulate_module, "BROADCAST_CUTS", 3)
    assert timelines(spark, SimConfig(), 15) == want


def test_meetings_that_need_more_rounds_are_whole(spark, monkeypatch):
    """A joined library's cuts come a few at a time; types, placement and the last utterances are those of a broadcast one."""
    markov = ((0.4, 0.3, 0.2, 0.1), (0.2, 0.5, 0.2, 0.1), (0.3, 0.3, 0.1, 0.3), (0.5, 0.2, 0.2, 0.1))
    config = SimConfig(max_concurrent_speakers=2, p_markov=markov)
    want = timelines(spark, config, 15)
    monkeypatch.setattr(simulate_module, "BROADCAST_CUTS", 3)
    monkeypatch.setattr(simulate_module, "JOINED_STEPS", 12)
    assert timelines(spark, config, 15) == want
    assert max(map(len, want.values())) > 24 > 12 > 0  # three rounds


def test_meetings_are_spread_over_tasks(spark, small):
    """However few files their ids come in."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for config in (SimConfig(), SimConfig(max_concurrent_speakers=2)):
        assert simulate(meetings(spark).coalesce(1), library(spark), config).rdd.getNumPartitions() == parts
    for query in ("simulated", "simulate_concurrent", "simulate_markov", "sim_segments", "speech_levels"):
        assert getattr(room_plans, query)(spark, small).rdd.getNumPartitions() == parts


def test_one_speaker_always_holds(spark):
    for meeting in timelines(spark, SimConfig(min_max_spk=(1, 1)), 5).values():
        assert len({r.speaker for r in meeting}) == 1
        assert all(a.start_us + a.dur_us <= b.start_us for a, b in zip(meeting, meeting[1:], strict=False))


def test_types_follow_the_probabilities(spark):
    p = (0.1, 0.5, 0.1, 0.3)
    kinds = [r.type for m in timelines(spark, SimConfig(p_ind=p), 150).values() for r in m[1:]]
    for k in range(4):
        assert abs(np.mean([x == k for x in kinds]) - p[k]) < 0.05
    with pytest.raises(ValueError):
        SimConfig(boost_overlap_factor=-1)


@pytest.mark.parametrize("seed", range(5))
def test_placement_equals_a_search(seed):
    r = random.Random(seed)
    said = [(r.randrange(4), a := r.randrange(40), a + r.randrange(1, 12)) for _ in range(10)]
    for proposed in range(0, 40, 3):
        got = place_utterance(proposed, 5, 9, said, 2)
        ok = lambda t: all(len({s for s, a, b in said if a <= x < b} | {9}) <= 2 for x in range(t, t + 5))
        want = next((t for t in [proposed, *sorted({b for *_, b in said if b > proposed})] if ok(t)), max(said[-1][2], proposed))
        assert got == want


def test_rooms_are_feasible(spark):
    rows = sampling.rooms(spark.range(200).withColumnRenamed("id", "room_id"), 1).collect()
    assert len(rows) >= 199
    for r in rows:
        assert r.absorption <= 1 and r.distance > 1 and 5 <= r.l <= 10 and r.l / 2 <= r.w <= 10
        assert 0.5 <= r.mic_x <= r.l - 0.5 and 0.5 <= r.src_y <= r.w - 0.5


def test_direct_path_of_a_room(spark):
    rooms = sampling.rooms(spark.range(5).withColumnRenamed("id", "room_id"), 1)
    for r in audio.room_responses(rooms).join(rooms, "room_id").collect():
        k = int(np.argmax(np.abs(r.anechoic)))
        assert k == round(r.distance * 16000 / audio.SOUND) and r.anechoic[k] == pytest.approx(1 / (4 * math.pi * r.distance))
        assert np.count_nonzero(r.anechoic) == 1 and np.count_nonzero(r.ir) > 10


def test_no_room_is_given_up(spark):
    """Where few attempts are feasible, drawing goes on."""
    rows = sampling.rooms(spark.range(60).withColumnRenamed("id", "room_id"), 1, rt60=(0.01, 0.11)).collect()
    assert len(rows) == 60 and max(r.attempt for r in rows) >= 16
    assert all(r.absorption <= 1 and r.distance > 1 for r in rows)


def test_draws_of_rooms_are_the_keyed_ones(spark):
    u = [rng.uniform(3, "room_id", F.lit(a), F.lit("l")).alias(f"u{a}") for a in range(4)]
    ids = spark.range(50).withColumnRenamed("id", "room_id")
    for r in sampling.rooms(ids, 3).join(ids.select("room_id", *u), "room_id").where("attempt < 4").collect():
        assert r.l == pytest.approx(5 + 5 * r[f"u{r.attempt}"], abs=1e-12)


def test_responses_last_as_long_as_the_reverberation(spark, small):
    """Orders and lengths follow from rt60 and size; the registered responses are whole."""
    rows = sig_plans.rir_image_source(spark, small).join(room_plans._rooms(spark, small), "room_id").where("room_id between 1 and 12").collect()
    assert len(rows) == 12
    for r in rows:
        sides = [(r.l, r.w), (r.l, r.z), (r.w, r.z)]
        order = math.ceil(343 * r.rt60 / min(a * b / math.sqrt(a * a + b * b) for a, b in sides) - 1)
        assert audio.inverse_sabine(np.array([r.l, r.w, r.z]), r.rt60) == (pytest.approx(r.absorption), order)
        assert len(r.ir) >= r.rt60 * 16000 and r.ir[-1] != 0
    assert any(np.any(np.array(r.ir)[2048:]) for r in rows)
    wet = {r.sig_id: r for r in sig_plans.rir_convolve(spark, small).where("sig_id < 12").collect()}
    dry = {r.sig_id: r.x for r in views.signals(spark, small).where("sig_id < 12").collect()}
    by_room = {r.room_id: np.array(r.ir) for r in rows}
    compared = 0
    for k, r in wet.items():
        if k + 1 in by_room:
            h = by_room[k + 1]
            assert np.allclose(r.y, np.convolve(dry[k], h[np.abs(h).argmax() :]), atol=1e-6)
            compared += 1
    assert compared


def test_images_equal_a_loop():
    room, src, mic = np.array([5.0, 4.0, 3.0]), np.array([1.0, 3.0, 1.5]), np.array([4.0, 1.0, 1.2])
    want = np.zeros(4096)
    for i in itertools.product(range(-4, 5), repeat=3):
        if sum(map(abs, i)) <= 4:
            image = [j * side + s if j % 2 == 0 else (j + 1) * side - s for j, side, s in zip(i, room, src, strict=True)]
            d = math.dist(image, mic)
            want[round(d * 16000 / 343)] += math.sqrt(0.7) ** sum(map(abs, i)) / (4 * math.pi * d)
    got = audio.image_source(room, src, mic, 0.3, 4, 16000)
    assert len(got) == np.flatnonzero(want)[-1] + 1 and np.allclose(got, want[: len(got)])
    assert np.allclose(audio.image_source(room, src, mic, 0.3, 4, 16000, 4096), want)


def test_images_are_never_held_at_once():
    """More than a million images of order 100, in the memory of a few planes."""
    room, src, mic = np.array([5.0, 4.0, 3.0]), np.array([1.0, 3.0, 1.5]), np.array([4.0, 1.0, 1.2])
    audio.image_source(room, src, mic, 0.3, 100, 16000)
    tracemalloc.start()
    h = audio.image_source(room, src, mic, 0.3, 100, 16000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and h[-1] != 0


def test_rooms_are_made_in_many_tasks_and_only_those_wanted(spark, small):
    """However few files the ids come in."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = room_plans._rooms(spark, small)
    assert every.rdd.getNumPartitions() == parts and sig_plans.rir_convolve(spark, small).rdd.getNumPartitions() == parts
    some = room_plans._rooms(spark, small, spark.range(3, 6).withColumnRenamed("id", "room_id"))
    want = {r.room_id: r for r in every.where("room_id between 3 and 5").collect()}
    assert {r.room_id: r for r in some.collect()} == want and len(want) == 3


def signals(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "sig_id bigint, x array<double>")


def test_signal_edges(spark):
    df = signals(spark, [[0.0, 0.0], [0.99, -0.5], [1.98, 0.0]])
    x = F.col("x")
    assert [r.g for r in df.select(signal.gain_to(x, -20.0).alias("g")).collect()][0] == 1e-8
    assert [r.y for r in df.select(signal.normalize(x, -20.0).alias("y")).collect()][0] == [0.0, 0.0]
    assert [r.y for r in df.select(signal.peak_guard(x).alias("y")).collect()] == [[0.0, 0.0], [0.99, -0.5], [0.99, 0.0]]


def test_convolution_and_mix(spark):
    rng_ = np.random.default_rng(1)
    a, b = rng_.normal(size=20).tolist(), rng_.normal(size=9).tolist()
    got = [r.y for r in signals(spark, [a, b]).select(signal.convolve(F.col("x"), [0.5, -1.0, 2.0]).alias("y")).collect()]
    assert np.allclose(got[0], np.convolve(a, [0.5, -1.0, 2.0])) and np.allclose(got[1], np.convolve(b, [0.5, -1.0, 2.0]))
    p = spark.createDataFrame([(1, 0, a), (1, 30, b), (2, 2, b)], "rec bigint, offset bigint, x array<double>")
    mixed = {r.rec: r for r in signal.mix(p, ["rec"]).collect()}
    want = np.zeros(39)
    want[:20] += a
    want[30:] += b
    assert np.allclose(mixed[1].mix, want) and mixed[2].n_samples == 11


def test_crossfade_keeps_a_constant(spark):
    """Two equal constants fade into each other without a dip, whatever the length of the fade."""
    for n in (1, 4, 40):
        row = spark.createDataFrame([([1.0] * 50, [1.0] * n)], "a array<double>, b array<double>").select(signal.crossfade(F.col("a"), F.col("b"), 10).alias("y")).first()
        assert np.allclose(row.y, 1) and len(row.y) == 50 + n - min(10, n // 4)


def test_resampling_keeps_a_sine():
    x = np.sin(2 * math.pi * 440 * np.arange(4000) / 16000)
    y = audio.resample(x, 16000, 8000)
    assert len(y) == 2000 and np.abs(y[200:-200] - np.sin(2 * math.pi * 440 * np.arange(2000) / 8000)[200:-200]).max() < 0.01


def test_resampling_in_blocks_is_the_same():
    x = np.random.default_rng(1).normal(size=5000)
    for source, target in ((16000, 8000), (8000, 16000), (44100, 16000)):
        assert np.allclose(audio.resample(x, source, target, block=700), audio.resample(x, source, target, block=1 << 20))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_of_all_widths_and_channels(spark, tmp_path, width):
    import io
    import wave

    x = np.stack([np.sin(np.arange(900) / 9), 0.5 * np.cos(np.arange(900) / 7)], axis=1)
    full = {1: 127, 2: 32767, 3: 8388607, 4: 2147483647}[width]
    numbers = np.round(x * full).astype(np.int64)
    body = (numbers + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in numbers.ravel())
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(16000)
        w.writeframes(body)
    got, rate = audio.read_channels(out.getvalue())
    assert rate == 16000 and got.shape == (900, 2) and np.abs(got - x).max() < 2 / full + 1e-9
    assert np.allclose(audio.read_wav(out.getvalue(), 10, 30, channel=1)[0], got[10:30, 1])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(out.getvalue())
    assert [r.status for r in audio.resample_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), 8000).collect()] == ["processed"]
    y, rate = audio.read_channels((tmp_path / "out" / "a.wav").read_bytes())
    assert rate == 8000 and y.shape == (450, 2)


def test_noise_bed_has_its_level():
    files = [np.random.default_rng(k).normal(size=100 + 30 * k) for k in range(3)]
    bed = audio.noise_bed(files, 1000, 16, -30.0, lambda k: (0.3 + 0.4 * k) % 1)
    assert len(bed) == 1000 and np.sqrt(np.mean(bed**2)) == pytest.approx(10**-1.5)
    assert not audio.noise_bed([], 10, 4, -30.0, lambda k: 0.5).any()


def test_wav_files_round_trip(spark, tmp_path):
    x = np.sin(np.arange(800) / 10).tolist()
    audio.write_wavs(signals(spark, [x, x[:400]]), f"{tmp_path}/a/b").collect()
    assert sorted(r.n_samples for r in audio.read_headers(spark, str(tmp_path)).collect()) == [400, 800]
    with open(f"{tmp_path}/a/b/0.wav", "rb") as f:
        part, rate = audio.read_wav(f.read(), 100, 200)
    assert rate == 16000 and np.allclose(part, x[100:200], atol=1e-4)
    (tmp_path / "a" / "bad.wav").write_bytes(b"no sound")
    run = lambda: sorted(r.status for r in audio.resample_folder(spark, str(tmp_path / "a"), str(tmp_path / "out"), 8000).collect())
    assert run() == ["error", "processed", "processed"]
    assert run() == ["error", "skipped", "skipped"]


def test_stages_are_done_once(spark, tmp_path, small):
    config = SimConfig(n_meetings=3, min_spk_utt=2)
    cuts = views.cuts(spark, small)
    stages = pipeline.meeting_stages(cuts, config)
    first = pipeline.run_stages(spark, str(tmp_path), stages)
    assert first["statistics"].count() == 3 and first["supervisions"].count() == first["timelines"].count()
    names = {r.name for r in first["library"].select("name").distinct().collect()}
    lines = [r.line.split() for r in first["rttm"].collect()]
    assert lines and {line[7] for line in lines} <= names and names
    broken = [(n, None) for n, _ in stages]
    again = pipeline.run_stages(spark, str(tmp_path), broken)
    assert again["timelines"].count() == first["timelines"].count()
    with pytest.raises(ValueError):
        pipeline.run_stages(spark, f"{tmp_path}/other", stages, first=2)


SEGMENT = "id bigint, rec date, speaker bigint, channel int, start_us bigint, dur_us bigint"


def test_live_merge_equals_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, datetime.date(2024, 1, 1), r.randrange(2), 0, r.randrange(600) * 100_000, r.randrange(20) * 100_000) for k in range(150)]
    batch = spark.createDataFrame(rows, SEGMENT)
    want = sorted(tuple(x) for x in intervals.merge(batch).select("speaker", "start_us", "end_us", "parts").collect())
    assert sorted(tuple(x) for x in live.merge_live(batch).select("speaker", "start_us", "end_us", "parts").collect()) == want
    late = (999, datetime.date(2024, 1, 1), 5, 0, 10_000_000_000, 0)
    for k, part in enumerate([rows[:75], rows[75:], [late], [(1000, *late[1:])]]):
        spark.createDataFrame(part, SEGMENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert k >= 0
    stream = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = live.merge_live(stream, watermark="120 seconds").writeStream.format("memory").queryName("merged_live").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = spark.sql("select speaker, start_us, end_us, parts from merged_live where speaker < 5").collect()
    assert sorted(tuple(x) for x in got) == want


def test_live_types_keep_state_between_batches(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    t = 1_704_067_200_000_000  # rows at the epoch itself would be late, as a watermark begins there
    for part in ([(0, day, 0, 0, t, 5_000_000)], [(1, day, 1, 0, t + 4_000_000, 500_000)], [(2, day, 1, 0, t + 6_000_000, 500_000)]):
        spark.createDataFrame(part, SEGMENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = live.turn_types_live(stream).writeStream.format("memory").queryName("types_live").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r.id, r.gap_us, r.type) for r in spark.table("types_live").collect()) == [(1, -1_000_000, 3), (2, 1_500_000, 0)]
