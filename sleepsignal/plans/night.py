"""The two night pipelines: inputs to merged timeline, merged timeline to features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import align, clean, events, spectral
from sleepsignal.operators.cohort import append_column, outer_merge
from sleepsignal.operators.features.bout import bout_features
from sleepsignal.operators.features.eeg import stage_power
from sleepsignal.operators.features.eog import eog_features
from sleepsignal.operators.features.extra import extra_features, waso
from sleepsignal.operators.features.fused import night_features
from sleepsignal.operators.features.stage_prob import stage_prob_features
from sleepsignal.schemas import KEY, T
from sleepsignal.session import cut
from sleepsignal.sources.incremental import each_module

Module = Callable[..., DataFrame]
MODULES: dict[str, Module] = {
    "eog": eog_features, "stage_prob": stage_prob_features, "eeg": stage_power, "bout": bout_features, "extra": extra_features,
}


@dataclass(frozen=True)
class Settings:
    """Rates and lengths of the recordings, in Hz and seconds."""

    fs: float = 250.0
    detect_fs: float = 128.0
    epoch_s: float = 30.0
    sub_s: float = 4.0
    phasic_s: float = 1.0
    sem_s: float = 0.5
    artefact_uv: float = 300.0
    chunk_s: float = 600.0


def detect(
    samples: DataFrame, hypnogram: DataFrame, s: Settings = Settings(), taps: Sequence[float] | None = None, idx: str = "sample_idx", chunk_rows: int = 65_536, digits: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Typed movements and classified sub-epochs from raw LOC, ROC and stage on the detection grid.

    Band-pass in chunks with a halo, antiphase gate, amplitude against the stage-wise threshold of the raw channels, nearest minima.
    Raw channels and stage travel through the filter with their sample, so nothing is joined back. The gated samples
    are written once; filtered values are rounded to ``digits`` decimals and the threshold to four, so that equal
    inputs give equal events on any cluster. Times are relative to the first sample, as the grid starts there.
    """
    taps = spectral.fir_taps(s.detect_fs, 0.1, 5.0, 2 * int(2 * s.detect_fs) + 1) if taps is None else taps
    filtered = spectral.bandpass_filter(samples, taps, ["LOC", "ROC"], idx, chunk_rows, keep=["LOC", "ROC", "stage"], digits=digits)
    filtered = cut(spectral.antiphase_gate(filtered).select(KEY, idx, "LOC", "ROC", "stage", "loc_clean", "roc_clean"))
    threshold = events.stagewise_threshold(filtered).withColumn("threshold", F.round("threshold", 4))
    em = events.detect_em(filtered, s.detect_fs, s.sem_s, threshold, idx=idx, chunk_rows=chunk_rows)
    em = cut(clean.drop_artefact_events(em, s.artefact_uv))
    length = filtered.groupBy(KEY).agg((F.count(F.lit(1)) / F.lit(s.detect_fs)).alias("duration_s"))
    return em, events.classify_subepochs(hypnogram, length, em, s.epoch_s, s.sub_s, s.phasic_s)


def process(
    eog: DataFrame, staging: DataFrame, rem_events: DataFrame, em_events: DataFrame, subepochs: DataFrame, eeg: DataFrame,
    lights: DataFrame, s: Settings = Settings(),
) -> DataFrame:
    """Trim to lights-off .. lights-on, mask artefacts, shift event times, merge everything on the sample timeline."""
    on_clock = lambda df, cols: clean.time_offset(df, lights, cols)
    eog = clean.mask_artefacts(clean.trim_lights(eog, lights), s.artefact_uv)
    staging = clean.trim_lights(staging, lights, "epoch_start")
    times = ["Start", "Peak", "End"]
    return align.merged_timeline(
        eog, staging, on_clock(rem_events, times), on_clock(em_events, times), on_clock(subepochs, ["SubEpochStart", "SubEpochEnd"]),
        on_clock(eeg, [T]), s.chunk_s)


def features(merged: DataFrame, s: Settings = Settings(), **options) -> DataFrame:
    """One row per session with all 141 features and the wake after sleep onset, from three scans of the timeline."""
    return night_features(merged, s.fs, s.chunk_s, s.sub_s, **options)


def extract(
    merged: DataFrame, modules: Sequence[str] = tuple(MODULES), s: Settings = Settings(), options: dict[str, dict] | None = None,
    with_waso: bool = True,
) -> tuple[DataFrame, dict[str, str]]:
    """One row per session with the features of all modules, and the modules that had to be skipped.

    ``merged`` should be a written table: every module prunes it to its own columns.
    """
    unknown = set(modules) - set(MODULES)
    if unknown:
        raise ValueError(f"unknown modules {sorted(unknown)}; use {sorted(MODULES)}")
    common = {
        "eog": {"fs": s.fs, "chunk_s": s.chunk_s, "sub_s": s.sub_s}, "stage_prob": {"fs": s.fs, "chunk_s": s.chunk_s},
        "eeg": {"fs": s.fs, "chunk_s": s.chunk_s}, "bout": {"fs": s.fs, "sub_s": s.sub_s}, "extra": {"fs": s.fs, "chunk_s": s.chunk_s, "sub_s": s.sub_s},
    }
    opts = options or {}
    built, failed = each_module({m: (lambda m=m: MODULES[m](merged, **{**common[m], **opts.get(m, {})})) for m in modules})
    if not built:
        raise ValueError(f"no module could be built: {failed}")
    out = outer_merge(list(built.values()), KEY)
    if with_waso:
        out = append_column(out, waso(merged, s.fs), KEY, "waso_min")
    return out, failed
