"""python -m turnloom simulate key=value ... | resample SOURCE TARGET [RATE] [--overwrite]"""

from __future__ import annotations

import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, pipeline
from .operators import audio, render, sampling, turns
from .operators.simulate import SimConfig
from .sources import manifests


def simulate(words: list[str]) -> None:
    c = config.from_words(words)
    spark = SparkSession.builder.getOrCreate()
    cuts = manifests.to_cuts(manifests.read_cuts(spark, manifests.split_paths(c.manifest_dir, c.manifest_prefix, c.dset_splits)))
    sim = c.sim
    if c.hmm_fit_transitions_to is not None:
        own = manifests.to_segments(spark.read.schema("recording_id string, speaker string, start double, duration double").json(c.hmm_fit_transitions_to))
        fitted = {k: [r for r in f.collect()] for k, f in (("p", turns.fit_probabilities(own, 1_000_000)), ("b", turns.fit_betas(own, 1_000_000)), ("m", turns.fit_transitions(own, 1_000_000)))}
        p = tuple(r.p for r in sorted(fitted["p"], key=lambda r: r.type))
        betas = tuple(r.beta for r in sorted(fitted["b"], key=lambda r: r.type))
        rows = [[r.p for r in sorted(fitted["m"], key=lambda r: (r.prev_type, r.next_type)) if r.prev_type == k] for k in range(4)]
        sim = dataclasses.replace(sim, p_ind=p, betas=betas, p_markov=tuple(map(tuple, rows)))
    if not c.use_markov:
        sim = dataclasses.replace(sim, p_markov=None)
    tables = pipeline.run_stages(spark, c.output_dir, pipeline.meeting_stages(cuts, sim), c.stage)
    if c.save_rttm:
        tables["rttm"].select(F.col("line").alias("value"), F.col("meeting").alias("rec")).write.partitionBy("rec").mode("overwrite").text(f"{c.output_dir}/rttm_files")
    if c.save_nemo_manifest:
        pipeline.nemo_manifest(tables["statistics"], c.output_dir).write.mode("overwrite").json(f"{c.output_dir}/nemo_manifest")
    if c.save_cutset:
        manifests.write_json(tables["supervisions"], f"{c.output_dir}/supervisions.jsonl")
    if tables["library"].where("source is null").limit(1).count():
        print("the manifest names no sound files, so no mixtures were rendered")
        return
    written = render_run(spark, c, sim, tables)
    if c.save_cutset:
        recordings = pipeline.recordings(written, sim.samplerate)
        manifests.write_json(recordings, f"{c.output_dir}/recordings.jsonl")
        manifests.write_json(pipeline.cut_manifest(recordings, tables["supervisions"]), f"{c.output_dir}/cuts.jsonl")


def render_run(spark: SparkSession, c: config.RunConfig, sim: SimConfig, tables: dict[str, DataFrame]) -> DataFrame:
    """The WAV files of a run: mixtures, and the stems that its settings ask for."""
    rate, responses, noise = sim.samplerate, None, None
    if c.reverberate:
        def make(spark: SparkSession, _: dict[str, DataFrame]) -> DataFrame:
            ids = spark.range(c.n_rirs).withColumnRenamed("id", "room_id").repartition(min(c.n_rirs, 4 * spark.sparkContext.defaultParallelism))
            return audio.room_responses(sampling.rooms(ids, sim.seed, c.room_sz, c.room_ceiling, c.rt60, c.delta_dist, c.n_pos_rirs), rate=rate)

        responses = pipeline.run_stages(spark, c.output_dir, [("responses", make)])["responses"]
    if c.add_noise and c.noise_folders:
        noise = audio.noise_files(spark, list(c.noise_folders), c.noise_filename_pattern, c.filter_noise_len, sim.seed, rate)
    r = render.RenderConfig(
        seed=sim.seed, rate=rate, base_gain=sim.base_gain, rel_gain=sim.rel_gain, fir=c.use_fir, reverb_prob=c.reverb_prob if c.reverberate else 0.0,
        noise_prob=c.noise_probability_global if c.add_noise else 0.0, noise_gain=c.noise_rel_gain, speakers=c.save_spk, anechoic=c.save_anechoic,
    )
    names = tables["library"].select("cut_id", F.col("name").alias("speaker"))
    timeline = tables["timelines"].drop("speaker").join(names, "cut_id")
    used = tables["library"].join(timeline.select("cut_id").distinct(), "cut_id", "left_semi")

    def sound(spark: SparkSession, _: dict[str, DataFrame]) -> DataFrame:
        return render.write_meetings(render.meetings(timeline, audio.load_cuts(used, rate), r, responses, noise), f"{c.output_dir}/wav", rate, r.chunk)

    return pipeline.run_stages(spark, c.output_dir, [("files", sound)])["files"]


def resample(words: list[str]) -> None:
    plain = [w for w in words if w != "--overwrite"]
    done = audio.resample_folder(SparkSession.builder.getOrCreate(), plain[0], plain[1], int(plain[2]) if len(plain) > 2 else 16000, "--overwrite" in words)
    for r in done.groupBy("status").count().orderBy("status").collect():
        print(f"{r['status']}: {r['count']}")


if __name__ == "__main__":
    command = {"simulate": simulate, "resample": resample}.get(sys.argv[1] if len(sys.argv) > 1 else "")
    if command is None:
        sys.exit(__doc__)
    command(sys.argv[2:])
