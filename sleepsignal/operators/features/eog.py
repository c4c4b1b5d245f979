"""Eye-movement features (50 per session)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.operators import runs
from sleepsignal.operators.features import for_all_sessions, minutes, narrow, over, rem_samples, samples
from sleepsignal.schemas import KEY, STAGES, T, require

REQUIRED = (T, "LOC", "ROC", "stage", "is_rem_event", "is_em_event", "EM_Type")


def stage_distribution(df: DataFrame, fs: float, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    n = runs.with_neighbour_stage(narrow(df, KEY, T, "stage"), chunk_s=chunk_s)
    total = samples(n)
    aggs = [F.round(minutes(total, fs), 3).alias("total_recording_min")]
    for s in STAGES:
        c = samples(n, F.col("stage") == s)
        aggs += [F.round(minutes(c, fs), 3).alias(f"{s.lower()}_duration_min"), F.round(c / total, 4).alias(f"{s.lower()}_fraction")]
    starts = (F.col("stage") == "REM") & ~F.col("prev_stage").eqNullSafe(F.lit("REM"))
    return n.groupBy(KEY).agg(*aggs, F.count_if(starts).alias("n_rem_epochs"))


def rem_epoch_duration(df: DataFrame, fs: float, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    r = runs.true_runs(narrow(df, KEY, T, "stage"), F.col("stage") == "REM", T, chunk_s)
    r = r.groupBy(KEY, "run_id").agg(minutes(samples(r), fs).alias("d"))
    p = "rem_epoch_"
    out = r.groupBy(KEY).agg(
        F.count(F.lit(1)).alias(f"{p}count"), F.round(F.avg("d"), 3).alias(f"{p}mean_duration_min"),
        F.round(F.stddev_samp("d"), 3).alias(f"{p}std_duration_min"), F.round(F.min("d"), 3).alias(f"{p}min_duration_min"),
        F.round(F.max("d"), 3).alias(f"{p}max_duration_min"),
    )
    return for_all_sessions(df, out)


def rem_event_features(df: DataFrame, fs: float, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    rem = df.filter(F.col("stage") == "REM")
    if "event_Peak" not in df.columns:
        return _rem_event_edges(df, fs, chunk_s)
    cols = ["event_Duration", "event_LOCAbsValPeak", "event_ROCAbsValPeak", "event_LOCAbsRiseSlope", "event_ROCAbsRiseSlope"]
    ev = runs.first_per_key(rem.filter(F.col("event_Peak").isNotNull()), "event_Peak", cols)
    mean = lambda c: F.round(F.avg(c), 4)
    agg = ev.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_k"), mean("event_Duration").alias("rem_event_mean_duration_s"),
        mean("event_LOCAbsValPeak").alias("rem_event_mean_loc_amp_uv"), mean("event_ROCAbsValPeak").alias("rem_event_mean_roc_amp_uv"),
        mean("event_LOCAbsRiseSlope").alias("rem_event_mean_loc_rise_slope"), mean("event_ROCAbsRiseSlope").alias("rem_event_mean_roc_rise_slope"),
    )
    med = exact_quantiles(ev, [KEY], "event_Duration", {"_med": 0.5})
    out = rem_samples(df).join(agg, KEY, "left").join(med, KEY, "left")
    k = F.coalesce("_k", F.lit(0))
    return out.select(
        KEY, k.cast("long").alias("rem_event_count"), F.round(over(k, minutes(F.col("_n_rem"), fs)), 4).alias("rem_event_rate_per_min"),
        "rem_event_mean_duration_s", F.round("_med", 4).alias("rem_event_median_duration_s"), "rem_event_mean_loc_amp_uv",
        "rem_event_mean_roc_amp_uv", "rem_event_mean_loc_rise_slope", "rem_event_mean_roc_rise_slope",
    )


def _rem_event_edges(df: DataFrame, fs: float, chunk_s: float) -> DataFrame:
    """Event count from rising edges of the flag inside REM, when no event columns are present."""
    rem = df.filter(F.col("stage") == "REM").select(KEY, T, "is_rem_event")
    k = runs.true_runs(rem, F.col("is_rem_event"), T, chunk_s).groupBy(KEY).agg(F.count_distinct("run_id").alias("_k"))
    out = rem_samples(df).join(k, KEY, "left")
    n = F.coalesce("_k", F.lit(0))
    none = ["mean_duration_s", "median_duration_s", "mean_loc_amp_uv", "mean_roc_amp_uv", "mean_loc_rise_slope", "mean_roc_rise_slope"]
    return out.select(
        KEY, n.cast("long").alias("rem_event_count"), F.round(over(n, minutes(F.col("_n_rem"), fs)), 4).alias("rem_event_rate_per_min"),
        *[F.lit(None).cast("double").alias(f"rem_event_{c}") for c in none],
    )


def em_classification(df: DataFrame, fs: float) -> DataFrame:
    rem = df.filter((F.col("stage") == "REM") & F.col("em_event_id").isNotNull())
    has_mean = "em_MeanAbsValPeak" in df.columns
    if not has_mean:
        rem = rem.withColumn("em_MeanAbsValPeak", (F.col("em_LOCAbsValPeak") + F.col("em_ROCAbsValPeak")) / 2)
    ev = runs.first_per_key(rem, "em_event_id", ["EM_Type", "em_Duration", "em_MeanAbsValPeak"])
    aggs = []
    for label, kind in (("sem", "SEM"), ("rem_em", "REM")):
        is_kind = F.col("EM_Type") == kind
        aggs += [
            F.count_if(is_kind).alias(f"_{label}"), F.round(F.avg(F.when(is_kind, F.col("em_Duration"))), 4).alias(f"{label}_mean_duration_s"),
            F.round(F.avg(F.when(is_kind, F.col("em_MeanAbsValPeak"))), 4).alias(f"{label}_mean_amp_uv"),
        ]
    out = rem_samples(df).join(ev.groupBy(KEY).agg(*aggs), KEY, "left")
    some = F.col("_n_rem") > 0
    s, r = F.coalesce("_sem", F.lit(0)), F.coalesce("_rem_em", F.lit(0))
    rem_min = minutes(F.col("_n_rem"), fs)
    return out.select(
        KEY, F.when(some, s).cast("long").alias("sem_count_rem_sleep"), F.when(some, r).cast("long").alias("rem_em_count_rem_sleep"),
        F.round(over(s, rem_min), 4).alias("sem_rate_per_min"), F.round(over(r, rem_min), 4).alias("rem_em_rate_per_min"),
        F.round(over(s, s + r), 4).alias("sem_fraction"), F.round(over(r, s + r), 4).alias("rem_em_fraction"),
        "sem_mean_duration_s", "rem_em_mean_duration_s", "sem_mean_amp_uv", "rem_em_mean_amp_uv",
    )


def em_stage_counts(df: DataFrame) -> DataFrame:
    """Events by the stage of their first sample."""
    ev = runs.first_per_key(df.filter(F.col("em_event_id").isNotNull()), "em_event_id", ["stage"])
    names = {"N1": "n1", "N2": "n2", "N3": "n3", "REM": "rem", "W": "wake"}
    agg = ev.groupBy(KEY).agg(*[F.count_if(F.col("stage") == s).alias(f"em_count_{n}") for s, n in names.items()])
    return for_all_sessions(df, agg).select(KEY, *[F.coalesce(f"em_count_{n}", F.lit(0)).cast("long").alias(f"em_count_{n}") for n in names.values()])


def phasic_tonic(df: DataFrame, sub_s: float = 4.0) -> DataFrame:
    s = runs.subepoch_series(df, sub_s).groupBy(KEY).agg(
        F.count_if(F.col("EpochType") == "Phasic").alias("_p"), F.count_if(F.col("EpochType") == "Tonic").alias("_t"))
    out = for_all_sessions(df, s)
    p, t = F.coalesce("_p", F.lit(0)), F.coalesce("_t", F.lit(0))
    return out.select(
        KEY, p.cast("long").alias("phasic_epoch_count"), t.cast("long").alias("tonic_epoch_count"),
        F.round(over(p, p + t), 4).alias("phasic_fraction"), F.round(over(t, p + t), 4).alias("tonic_fraction"),
    )


def epoch_type_percentages(subepochs: DataFrame) -> DataFrame:
    """Share of Phasic, Tonic and Unclassified sub-epochs per session, in percent."""
    n = F.count(F.lit(1))
    pct = lambda k: F.round(F.count_if(F.col("EpochType") == k) * 100.0 / n, 2).alias(f"{k.lower()}_pct")
    return subepochs.groupBy(KEY).agg(n.alias("n_subepochs"), pct("Phasic"), pct("Tonic"), pct("Unclassified"))


def eog_amplitude(df: DataFrame) -> DataFrame:
    rem = df.filter(F.col("stage") == "REM")
    long = rem.select(KEY, F.explode(F.array(*[
        F.struct(F.lit(c.lower()).alias("ch"), F.col(c).alias("v")) for c in ("LOC", "ROC")])).alias("_s")).select(
        KEY, "_s.ch", F.col("_s.v").alias("v"), F.abs("_s.v").alias("a"))
    stats = long.groupBy(KEY, "ch").agg(F.avg("a").alias("m"), F.stddev_samp("v").alias("s"))
    q = stats.join(exact_quantiles(long, [KEY, "ch"], "a", {"p": 0.95}), [KEY, "ch"], "left")
    aggs = []
    for ch in ("loc", "roc"):
        for c, name in (("m", "mean_abs_uv"), ("s", "std_uv"), ("p", "p95_uv")):
            aggs.append(F.round(F.max(F.when(F.col("ch") == ch, F.col(c))), 4).alias(f"rem_{ch}_{name}"))
    return for_all_sessions(df, q.groupBy(KEY).agg(*aggs))


def eog_features(df: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S, sub_s: float = 4.0) -> DataFrame:
    require(df, REQUIRED)
    out = stage_distribution(df, fs, chunk_s)
    for part in (
        rem_epoch_duration(df, fs, chunk_s), rem_event_features(df, fs, chunk_s), em_classification(df, fs),
        em_stage_counts(df), phasic_tonic(df, sub_s), eog_amplitude(df),
    ):
        out = out.join(part, KEY, "left")
    return out
