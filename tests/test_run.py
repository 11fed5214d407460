"""Rendering, settings, manifests and file lists."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from turnloom import config
from turnloom.operators import render, words
from turnloom.sources import manifests


def test_chunks_add_up_to_the_whole(spark):
    rng = np.random.default_rng(1)
    parts = [(m, int(rng.integers(0, 900)), rng.normal(size=int(rng.integers(1, 400))).tolist()) for m in (1, 2) for _ in range(8)]
    df = spark.createDataFrame(parts, "meeting bigint, offset bigint, x array<double>")
    chunks = render.mix_chunks(df, ["meeting"], 128)
    got = {m: np.zeros(2000) for m in (1, 2)}
    for r in chunks.collect():
        assert len(r.x) <= 128
        got[r.meeting][r.chunk * 128 : r.chunk * 128 + len(r.x)] = r.x
    want = {m: np.zeros(2000) for m in (1, 2)}
    for m, at, x in parts:
        want[m][at : at + len(x)] += x
    assert all(np.allclose(got[m], want[m]) for m in (1, 2))
    guarded = render.guard(chunks, "meeting")
    assert all(r.peak == pytest.approx(0.99) for r in render.loudness(guarded, "meeting").collect())
    loud = {r.meeting: r for r in render.loudness(chunks, "meeting").collect()}
    assert loud[1].peak == pytest.approx(np.abs(want[1]).max())


def test_utterances_are_levelled_and_placed(spark):
    timeline = spark.createDataFrame([(1, 0, "c", 500_000, -20.0)], "meeting bigint, speaker bigint, cut_id string, start_us bigint, level_db double")
    signals = spark.createDataFrame([("c", [1.0, 3.0])], "cut_id string, x array<double>")
    row = render.pieces(timeline, signals).first()
    assert row.offset == 8000 and np.allclose(row.x, [-0.1, 0.1])


def test_chunks_are_added_in_a_stream(spark, monkeypatch):
    """No group is called on its own; chunks that span batches are whole, however few samples leave together."""
    rng = np.random.default_rng(2)
    parts = [(m, stem, int(rng.integers(0, 90)), rng.normal(size=int(rng.integers(0, 60))).tolist()) for m in range(5) for stem in "ab" for _ in range(9)]
    df = spark.createDataFrame(parts, "meeting bigint, stem string, offset bigint, x array<double>")
    monkeypatch.setattr(render, "SAMPLES", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        chunks = render.mix_chunks(df, ["meeting", "stem"], 16)
        assert "FlatMapGroups" not in chunks._jdf.queryExecution().executedPlan().toString()
        rows = chunks.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for m, stem, at, x in parts:
        want.setdefault((m, stem), np.zeros(160))[at : at + len(x)] += x
    assert len({(r.meeting, r.stem, r.chunk) for r in rows}) == len(rows)
    for r in rows:
        assert np.allclose(want[r.meeting, r.stem][r.chunk * 16 : r.chunk * 16 + len(r.x)], r.x)
        want[r.meeting, r.stem][r.chunk * 16 : r.chunk * 16 + len(r.x)] = 0
    assert not any(x.any() for x in want.values())



def test_settings():
    c = config.from_words(["duration=240", "n_meetings=5", "min_max_spk=[3,3]", "hmm_params.p_ind=[0.1,0.2,0.3,0.4]", "hmm_params.beta_bc=0.5", "save_rttm=true", "n_jobs=8", "noise_folders=/a", "boost_overlap_factor=null"])
    assert c.sim.duration_us == 240_000_000 and c.sim.min_max_spk == (3, 3) and c.sim.p_ind == (0.1, 0.2, 0.3, 0.4) and c.sim.betas[3] == 0.5
    assert c.save_rttm and c.noise_folders == ("/a",)
    for wrong in ("nonsense=1", "hmm_params.x=1", "mic_type=circular"):
        with pytest.raises(ValueError):
            config.from_words([wrong])


def test_manifest_becomes_cuts(spark, tmp_path):
    word = lambda s, a, d: {"symbol": s, "start": a, "duration": d, "score": None}
    cuts = [
        {"id": "c1", "start": 0, "duration": 2, "channel": 0, "supervisions": [{"id": "s", "recording_id": "r", "start": 0.5, "duration": 1.5, "speaker": "x", "alignment": {"word": [word("a", 0.6, 0.2), word("b", 1.4, 0.2)]}}]},
        {"id": "c2", "start": 0, "duration": 2, "channel": 0, "supervisions": [{"id": "t", "recording_id": "r", "start": 0, "duration": 1, "speaker": "y"}]},
    ]
    for k, c in enumerate(cuts):
        with gzip.open(tmp_path / f"set_{k}.jsonl.gz", "wt") as f:
            f.write(json.dumps(c) + "\n")
    read = manifests.to_cuts(manifests.read_cuts(spark, manifests.split_paths(str(tmp_path), "set", ["0", "1"])))
    rows = {r.cut_id: r for r in read.collect()}
    assert rows["c1"].dur_us == 1_500_000 and [w.start_us for w in rows["c1"].words] == [100_000, 900_000] and rows["c2"].words is None
    assert [r.text for r in words.split_at_pauses(read).orderBy("part").collect()] == ["a", "b"]


def test_file_lists_and_reports(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.wav", "deep/b.flac", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"12345")
    files = manifests.audio_files(spark, str(tmp_path / "in"))
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in files.collect()) == [("a.wav", 5), ("b.flac", 5)]
    manifests.write_list(files, f"{tmp_path}/list")
    assert manifests.read_list(spark, f"{tmp_path}/list").count() == 2
    manifests.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["a: 1", "b: x"]
    manifests.write_json(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().a == 1


def wav(path, x, rate=16000):
    from turnloom.operators import audio

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(audio.wav_bytes(x, rate))


def run_folder(tmp_path, rng):
    """A manifest of three speakers' cuts in two files each, and two noise files."""
    rows = []
    for s in range(3):
        for f in range(2):
            path = tmp_path / "speech" / f"{s}-{f}.wav"
            wav(path, 0.3 * rng.normal(size=16000 * 6))
            for k in range(3):
                words = [{"symbol": w, "start": 0.1 + 0.3 * i, "duration": 0.2, "score": None} for i, w in enumerate(("a", "b", "c"))]
                rows.append({
                    "id": f"c{s}-{f}-{k}", "start": 2.0 * k, "duration": 1.1, "channel": 0,
                    "supervisions": [{"id": "s", "recording_id": f"{s}-{f}", "start": 0, "duration": 1.1, "speaker": f"speaker{s}", "text": "a b c", "alignment": {"word": words}}],
                    "recording": {"id": f"{s}-{f}", "sources": [{"type": "file", "channels": [0], "source": str(path)}], "sampling_rate": 16000, "num_samples": 96000, "duration": 6.0},
                })
    with gzip.open(tmp_path / "cuts_train.jsonl.gz", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    for k in range(2):
        wav(tmp_path / "noise" / f"n{k}.wav", 0.1 * rng.normal(size=16000 * 3))
    return rows


def test_a_run_writes_mixtures_stems_and_manifests(spark, tmp_path):
    from turnloom import __main__ as cli
    from turnloom.operators import audio

    run_folder(tmp_path, np.random.default_rng(3))
    out = tmp_path / "out"
    cli.simulate([
        f"manifest_dir={tmp_path}", f"output_dir={out}", "n_meetings=3", "duration=6", "min_spk_utt=2", "min_max_spk=[2,3]", "save_rttm=true", "save_nemo_manifest=true", "save_spk=true",
        "save_anechoic=true", "reverberate=true", "reverb_prob=1.0", "n_rirs=2", "n_pos_rirs=2", "rt60=[0.1,0.2]", "add_noise=true", "noise_probability_global=1.0", f"noise_folders=[\"{tmp_path}/noise\"]",
    ])
    lines = {r["id"]: r for p in (out / "recordings.jsonl").glob("*.json.gz") for r in map(json.loads, gzip.open(p, "rt"))}
    assert set(lines) == {"meeting_0", "meeting_1", "meeting_2"}
    cuts = {r["id"]: r for p in (out / "cuts.jsonl").glob("*.json.gz") for r in map(json.loads, gzip.open(p, "rt"))}
    for name, r in lines.items():
        x, rate = audio.read_wav(open(r["sources"][0]["source"], "rb").read())
        assert rate == 16000 and len(x) == r["num_samples"] and 0.01 < np.abs(x).max() <= 0.9901
        said = cuts[name]["supervisions"]
        assert [s["id"] for s in said] == sorted(s["id"] for s in said) and said[0]["alignment"]["word"][0]["symbol"] == "a"
        speakers = {s["speaker"] for s in said}
        assert speakers <= {"speaker0", "speaker1", "speaker2"}
        stems = {p.name for p in (out / "wav").glob(f"{name}-*.wav")}
        assert stems == {f"{name}-spk-{s}{a}.wav" for s in speakers for a in ("", "-anechoic")}
        # what isn't noise is the sum of the speakers
        total = np.zeros(len(x))
        for s in speakers:
            y, _ = audio.read_wav((out / "wav" / f"{name}-spk-{s}.wav").read_bytes())
            total[: len(y)] += y
        noise = x - total
        assert 0 < np.sqrt(np.mean(noise**2)) < np.sqrt(np.mean(total**2))
    text = "".join(p.read_text() for p in (out / "rttm_files").rglob("*.txt"))
    assert {line.split()[7] for line in text.splitlines()} <= {"speaker0", "speaker1", "speaker2"}
    assert spark.read.json(str(out / "nemo_manifest")).count() == 3


def test_voices_and_noise_equal_numpy(spark):
    """Levels, responses, stems and the peak limit of one meeting, sample by sample."""
    rng = np.random.default_rng(4)
    timeline = spark.createDataFrame([(5, 0, "a", "c0", 0), (5, 1, "b", "c1", 600_000)], "meeting bigint, step int, speaker string, cut_id string, start_us bigint")
    x = {"c0": rng.normal(size=900), "c1": rng.normal(size=700)}
    signals = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "cut_id string, x array<double>")
    h = np.concatenate((np.zeros(7), [1.0], 0.1 * rng.normal(size=90)))
    responses = spark.createDataFrame([(3, 0, h.tolist(), [0.0, 0.5])], "room_id bigint, position int, ir array<double>, anechoic array<double>")
    c = render.RenderConfig(seed=1, rate=1000, base_gain=(3.0, 3.0), rel_gain=(0.0, 0.0), reverb_prob=1.0, speakers=True, anechoic=True, chunk=256)
    got: dict[str, np.ndarray] = {}
    for r in render.meetings(timeline, signals, c, responses).collect():
        got.setdefault(r.stem, np.zeros(1600))[r.chunk * 256 : r.chunk * 256 + len(r.x)] = r.x
    want = {k: np.zeros(1600) for k in ("mix", "spk-a", "spk-b", "spk-a-anechoic", "spk-b-anechoic")}
    for cut, speaker, at in (("c0", "a", 0), ("c1", "b", 600)):
        own = x[cut] - x[cut].mean()
        wet = np.convolve(own, h[7:])
        gain = 10 ** (3 / 20) / np.sqrt(np.mean(wet**2))
        for stem, y in (("mix", wet * gain), (f"spk-{speaker}", wet * gain), (f"spk-{speaker}-anechoic", 0.5 * own * gain)):
            want[stem][at : at + len(y)] += y
    scale = 0.99 / np.abs(want["mix"]).max()
    assert scale < 1
    for stem, y in want.items():
        assert np.allclose(got[stem], y * scale), stem
    loud = render.RenderConfig(seed=1, rate=1000, base_gain=(-40.0, -40.0), rel_gain=(0.0, 0.0), noise_prob=1.0, noise_gain=(5.0, 5.0), gauss_gain=(5.0, 5.0), fade_s=0.02, chunk=256)
    clean = {r.chunk: np.array(r.x) for r in render.meetings(timeline, signals, render.RenderConfig(**{**loud.__dict__, "noise_prob": 0.0})).collect()}
    files = spark.createDataFrame([(f"n{k}", rng.normal(size=300 + 50 * k).tolist()) for k in range(3)], "noise_id string, x array<double>")
    for noise in (None, files):
        noisy = {r.chunk: np.array(r.x) for r in render.meetings(timeline, signals, loud, noise=noise).collect()}
        left = np.concatenate([noisy[k] - np.pad(clean[k], (0, len(noisy[k]) - len(clean[k]))) for k in sorted(noisy)])
        assert np.sqrt(np.mean(left**2)) == pytest.approx(10 ** (-35 / 20), rel=0.1)


def test_settings_that_nothing_would_read_are_errors():
    for wrong in ("data_dir=/x", "rir_dir=/x", "speed_perturb=true", "multi_noise_sampling=false", "save_anechoic=true"):
        with pytest.raises(ValueError):
            config.from_words([wrong])


def test_room_lists_and_responses_round_trip(spark, tmp_path):
    from turnloom.operators import audio, sampling

    rooms = sampling.rooms(spark.range(3).withColumnRenamed("id", "room_id"), 1, rt60=(0.1, 0.15), positions=2)
    assert rooms.count() == 6 and rooms.select("room_id", "position", "src_x").distinct().count() == 6
    assert rooms.select("room_id", "mic_x").distinct().count() == 3
    made = audio.room_responses(rooms, order=1)
    written = audio.write_responses(made, f"{tmp_path}/rirs").cache()
    manifests.write_rooms(written, f"{tmp_path}/rooms")
    read = manifests.read_rooms(spark, f"{tmp_path}/rooms/*.txt")
    lists = {r.room_id: r.paths for r in read.collect()}
    assert sorted(lists) == [0, 1, 2] and all(len(p) == 2 for p in lists.values())
    (tmp_path / "all.json").write_text(json.dumps([lists[k] for k in range(3)]))
    assert {r.room_id: r.paths for r in manifests.read_rooms(spark, f"{tmp_path}/all.json").collect()} == lists
    want = {(r.room_id, r.position): r for r in made.collect()}
    got = {(r.room_id, r.position): r for r in audio.read_responses(read).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert np.allclose(r.ir, want[k].ir, atol=1e-4) and np.allclose(r.anechoic, want[k].anechoic, atol=1e-4)
