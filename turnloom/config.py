"""Run settings by name: a nested mapping or ``key=value`` words become a SimConfig and what surrounds it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields

from .operators.simulate import SimConfig


@dataclass
class RunConfig:
    """A run: where it reads and writes, which stages, and the simulation itself."""

    sim: SimConfig = field(default_factory=SimConfig)
    stage: int = 1
    output_dir: str | None = None
    data_dir: str | None = None
    rir_dir: str | None = None
    manifest_dir: str | None = None
    manifest_prefix: str = "cuts"
    dset_splits: tuple[str, ...] = ("train",)
    add_noise: bool = False
    noise_folders: tuple[str, ...] = ()
    noise_filename_pattern: str | None = None
    noise_rel_gain: tuple[float, float] = (-20.0, -3.0)
    noise_probability_global: float = 0.5
    multi_noise_sampling: bool = True
    filter_noise_len: float = 2.0
    reverberate: bool = False
    reverb_prob: float = 0.5
    n_rirs: int = 5000
    n_pos_rirs: int = 50
    rt60: tuple[float, float] = (0.1, 0.7)
    room_sz: tuple[float, float] = (5.0, 10.0)
    room_ceiling: tuple[float, float] = (3.0, 5.0)
    delta_dist: float = 0.5
    mic_type: str = "single"
    use_fir: bool = False
    use_markov: bool = False
    hmm_fit_transitions_to: str | None = None
    save_cutset: bool = True
    save_spk: bool = False
    save_anechoic: bool = False
    save_rttm: bool = False
    save_nemo_manifest: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.noise_folders, str):
            self.noise_folders = (self.noise_folders,)
        if self.mic_type != "single":
            raise ValueError("only a single microphone is simulated")
        for name, why in (("data_dir", "sound files are read from where the manifests say"), ("rir_dir", "room responses are made, and kept with the run")):
            if getattr(self, name) is not None:
                raise ValueError(f"{name} can't be set: {why}")
        if self.sim.speed_perturb:
            raise ValueError("speed_perturb changes cuts before a run, not in it")
        if not self.multi_noise_sampling:
            raise ValueError("noise is always drawn from several files")
        if self.save_anechoic and not (self.reverberate and self.save_spk):
            raise ValueError("anechoic stems need reverberate and save_spk")


#: Names that mean something only to one machine's processes, or that nothing reads.
IGNORED = {"n_jobs", "hydra", "drop_without_align", "max_position_change", "circular", "use_rand_ism", "rand_disp"}
_SCALED = {"duration": ("duration_us", 1_000_000)}


def _tuples(value: object) -> object:
    return tuple(_tuples(v) for v in value) if isinstance(value, (list, tuple)) else value


def from_mapping(settings: Mapping[str, object]) -> RunConfig:
    """Unknown names are an error; those of IGNORED are let through."""
    sim_names, run_names = {f.name for f in fields(SimConfig)} - {"extra"}, {f.name for f in fields(RunConfig)} - {"sim"}
    sim: dict[str, object] = {}
    run: dict[str, object] = {}
    for name, value in settings.items():
        if name in IGNORED or (value is None and name in sim_names | set(_SCALED)):
            continue
        if name in _SCALED:
            target, factor = _SCALED[name]
            sim[target] = int(round(float(value) * factor))
        elif name == "hmm_params":
            for k, v in dict(value or {}).items():
                if k.startswith("beta_"):
                    order = ("beta_th", "beta_ts", "beta_ir", "beta_bc")
                    betas = list(sim.get("betas", SimConfig().betas))
                    betas[order.index(k)] = float(v)
                    sim["betas"] = tuple(betas)
                elif k in ("p_ind", "p_markov"):
                    sim[k] = _tuples(v)
                else:
                    raise ValueError(f"unknown setting hmm_params.{k}")
        elif name in sim_names:
            sim[name] = _tuples(value)
        elif name in run_names:
            run[name] = _tuples(value)
        else:
            raise ValueError(f"unknown setting {name}")
    return RunConfig(sim=SimConfig(**sim), **run)


def from_words(words: Iterable[str]) -> RunConfig:
    """``key=value`` words, values as JSON where they are JSON; ``a.b=1`` reaches into a."""
    settings: dict[str, object] = {}
    for w in words:
        key, _, text = w.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        at = settings
        *path, last = key.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return from_mapping(settings)
