"""Spectral features: band power per stage (31) and per REM context (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import runs, spectral
from sleepsignal.operators.clean import stage_normalise
from sleepsignal.operators.features import for_all_sessions, over
from sleepsignal.schemas import KEY, STAGES, T, require

Bands = dict[str, tuple[float, float]]


def stage_power(
    df: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S, bands: Bands = spectral.STAGE_BANDS, seg_s: float = 4.0, min_s: float = 10.0
) -> DataFrame:
    require(df, [T, "stage", "EEG_LOC", "EEG_ROC"])
    psd = spectral.welch(spectral.stage_signal(df, chunk_s), [KEY, "stage"], "pos", "x", fs, seg_s, min_s * fs)
    return for_all_sessions(df, stage_columns(psd, bands))


def stage_columns(psd: DataFrame, bands: Bands) -> DataFrame:
    """One row per session from densities by (session, stage)."""
    p = spectral.band_power(psd, [KEY, "stage"], bands, empty_is_null=False)
    total = sum((F.col(b) for b in bands), F.lit(0.0))
    p = p.withColumn("total", total).withColumn("theta_ratio", F.round(over(F.round("theta", 6), F.col("total")), 6))
    aggs = []
    for s in STAGES:
        for c in (*bands, "total", "theta_ratio"):
            aggs.append(F.max(F.when(F.col("stage") == s, F.round(c, 6))).alias(f"eeg__{s.lower()}__{c}"))
    whole = F.when((F.col("stage") == spectral.ALL) & (F.col("beta") > 0), F.round(F.col("theta") / F.col("beta"), 6))
    return p.groupBy(KEY).agg(*aggs, F.max(whole).alias("eeg__overall__theta_beta_ratio"))


def context_power(
    df: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S, bands: Bands = spectral.CONTEXT_BANDS, seg_s: float = 4.0, min_s: float = 2.0
) -> DataFrame:
    d = df if "EpochType" in df.columns else df.withColumn("EpochType", F.lit(None).cast("string"))
    sig = spectral.context_signal(d, chunk_s, stage_normalise(F.col("stage")))
    psd = spectral.welch(sig, [KEY, "context"], "pos", "x", fs, seg_s, min_s * fs)
    return for_all_sessions(df, context_columns(psd, bands))


def context_columns(psd: DataFrame, bands: Bands) -> DataFrame:
    """One row per session from densities by (session, context)."""
    p = spectral.band_power(psd, [KEY, "context"], bands, empty_is_null=True)
    ratio = F.when(F.col("delta") > 0, F.round(F.col("theta") / F.col("delta"), 6))
    aggs = []
    for c in ("rem", "phasic", "tonic"):
        mine = F.col("context") == c
        aggs += [F.max(F.when(mine, F.col(b))).alias(f"eeg_{b}_{c}_power") for b in bands]
        aggs.append(F.max(F.when(mine, F.col("_ratio"))).alias(f"eeg_theta_delta_ratio_{c}"))
    return p.withColumn("_ratio", ratio).groupBy(KEY).agg(*aggs)
