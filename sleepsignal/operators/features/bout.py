"""Phasic / tonic bout features (17 per session) and bout structure (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.operators import runs
from sleepsignal.operators.clean import stage_normalise
from sleepsignal.operators.features import for_all_sessions, minutes, over, rem_samples, rounded_time
from sleepsignal.schemas import KEY, T, require

LABELS = ("Phasic", "Tonic")


def _wide(stats: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(session, EpochType) rows to one row with prefixed columns."""
    aggs = [F.max(F.when(F.col("EpochType") == lab, F.col(c))).alias(f"{lab.lower()}_{name}") for lab in LABELS for c, name in cols.items()]
    return stats.groupBy(KEY).agg(*aggs)


def bout_features(df: DataFrame, fs: float = 250.0, sub_s: float = 4.0, break_on_gap: bool = False, chunk_bins: int = 4096) -> DataFrame:
    require(df, [T, "stage", "EpochType"])
    series = runs.subepoch_series(df, sub_s)
    b = runs.bouts(series, break_on_gap, chunk_bins).withColumn("d", F.col("length") * F.lit(float(sub_s)))
    stats = b.groupBy(KEY, "EpochType").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), F.min("d").alias("min"),
        F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std"), F.sum("d").alias("total"),
    ).join(exact_quantiles(b, [KEY, "EpochType"], "d", {"median": 0.5}), [KEY, "EpochType"])
    per_min = F.round(over(F.col("n"), minutes(F.col("_n_rem"), fs)), 4)
    stats = stats.join(rem_samples(df), KEY).select(
        KEY, "EpochType", F.col("n").alias("c"), per_min.alias("rate"), *[F.round(c, 4).alias(c) for c in ("mean", "max", "min", "std", "median", "total")])
    wide = _wide(stats, {
        "c": "bout_count", "mean": "bout_mean_duration_s", "max": "bout_max_duration_s", "min": "bout_min_duration_s", "std": "bout_std_duration_s",
        "median": "bout_median_duration_s", "rate": "bout_rate_per_min", "total": "bout_total_duration_s"})
    turns = runs.label_changes(series, chunk_bins).withColumnRenamed("n_changes", "phasic_tonic_transitions")
    return for_all_sessions(df, wide.join(turns, KEY, "left"))


def bout_structure(df: DataFrame, fs: float = 250.0, sub_s: float = 4.0, long_s: float = 30.0, chunk_bins: int = 4096) -> DataFrame:
    d = df.withColumn("stage", stage_normalise(F.col("stage")))
    series = runs.subepoch_series(d, sub_s)
    b = runs.bouts(series, False, chunk_bins).withColumn("d", F.col("length") * F.lit(float(sub_s)))
    stats = b.groupBy(KEY, "EpochType").agg(
        F.max("d").alias("longest"), F.coalesce(F.sum(F.when(F.col("d") > long_s, F.col("d"))), F.lit(0.0)).alias("long"),
    ).join(exact_quantiles(b, [KEY, "EpochType"], "d", {"p25": 0.25, "p75": 0.75, "p90": 0.9}), [KEY, "EpochType"])
    n = rem_samples(d)
    rem_min = minutes(F.col("_n_rem"), fs)
    stats = stats.join(n, KEY).select(
        KEY, "EpochType", *[F.round(c, 4).alias(c) for c in ("p25", "p75", "p90", "longest")],
        F.round(over(F.col("long"), rem_min * 60), 4).alias("long"))
    wide = _wide(stats, {"p25": "bout_p25_s", "p75": "bout_p75_s", "p90": "bout_p90_s", "longest": "longest_run_s", "long": "long_bout_fraction"})
    turns = runs.label_changes(series, chunk_bins)
    rem = d.filter(F.col("stage") == "REM").groupBy(KEY).agg(
        rounded_time(F.min(F.when(F.col("EpochType") == "Phasic", F.col(T))) - F.min(T), 4).alias("phasic_first_latency_s"))
    out = n.join(turns, KEY, "left").withColumn("pt_transitions_per_min", F.round(over(F.greatest("n_changes", F.lit(0)), rem_min), 4))
    return out.select(KEY, "pt_transitions_per_min").join(wide, KEY, "left").join(rem, KEY, "left")
