"""Movement shape, sleep architecture, wake after sleep onset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import runs
from sleepsignal.operators.clean import stage_normalise
from sleepsignal.operators.features import bout, eeg, for_all_sessions, minutes, narrow, over, rounded_time, samples
from sleepsignal.plans.chunked import join_salted
from sleepsignal.schemas import KEY, SLEEP_STAGES, T, require


def em_morphology(df: DataFrame) -> DataFrame:
    """Slopes, amplitude variance and slow share of all movements of a night."""
    cols = ["EM_Type", "em_MeanAbsValPeak", "em_LOCAbsRiseSlope", "em_ROCAbsRiseSlope", "em_LOCAbsFallSlope", "em_ROCAbsFallSlope"]
    ev = runs.first_per_key(df.filter(F.col("is_em_event")), "em_event_id", [c for c in cols if c in df.columns])
    pair = lambda k: F.round(F.avg((F.col(f"em_LOCAbs{k}Slope") + F.col(f"em_ROCAbs{k}Slope")) / 2), 6)
    out = ev.groupBy(KEY).agg(
        pair("Rise").alias("em_mean_rise_slope"), pair("Fall").alias("em_mean_fall_slope"),
        F.round(F.var_samp("em_MeanAbsValPeak"), 6).alias("em_amplitude_variance"),
        F.round(over(F.count_if(F.col("EM_Type") == "SEM"), F.count(F.lit(1))), 4).alias("em_sem_fraction"),
    )
    return for_all_sessions(df, out)


def sleep_architecture(df: DataFrame, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    d = narrow(df, KEY, T, "stage").withColumn("stage", stage_normalise(F.col("stage")))
    n = runs.with_neighbour_stage(d, chunk_s=chunk_s)
    rem = F.col("stage") == "REM"
    first = lambda c: F.min(F.when(c, F.col(T)))
    latency = (first(rem) - first(F.col("stage").isin(*SLEEP_STAGES))) / 60.0
    starts = F.count_if(rem & ~F.col("prev_stage").eqNullSafe(F.lit("REM")))
    return n.groupBy(KEY).agg(rounded_time(latency, 4).alias("rem_latency_min"), F.nullif(starts, F.lit(0)).alias("n_rem_cycles"))


def waso(df: DataFrame, fs: float = 250.0) -> DataFrame:
    """Minutes of wake after the first sleep sample; NULL without sleep."""
    onset = df.groupBy(KEY).agg(F.min(F.when(F.col("stage").isin(*SLEEP_STAGES), F.col(T))).alias("_on"))
    wake = join_salted(narrow(df.filter(F.col("stage") == "W"), KEY, T), onset, [KEY])
    after = wake.groupBy(KEY).agg(samples(wake, F.col(T) > F.col("_on")).alias("_w"))
    minutes_awake = F.round(minutes(F.coalesce("_w", F.lit(0)), fs), 4)
    return onset.join(after, KEY, "left").select(KEY, F.when(F.col("_on").isNotNull(), minutes_awake).alias("waso_min"))


def extra_features(df: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S, sub_s: float = 4.0, long_s: float = 30.0, **spectral_options) -> DataFrame:
    require(df, [T, "stage", "EEG_LOC", "EEG_ROC"])
    out = eeg.context_power(df, fs, chunk_s, **spectral_options)
    for part in (bout.bout_structure(df, fs, sub_s, long_s), em_morphology(df), sleep_architecture(df, chunk_s)):
        out = out.join(part, KEY, "left")
    return out
