"""Stage-probability features (12 per session)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import runs
from sleepsignal.operators.features import for_all_sessions, minutes, over
from sleepsignal.schemas import KEY, PROB_COLS, T, require


def stage_probability(df: DataFrame) -> DataFrame:
    rem = df.filter(F.col("stage") == "REM")
    share = lambda cond: F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 4)
    mean = [F.round(F.avg(c), 4).alias(f"rem_mean_{c}") for c in PROB_COLS]
    nrem = F.round(F.avg(F.col("prob_n1") + F.col("prob_n2") + F.col("prob_n3")), 4)
    out = rem.groupBy(KEY).agg(
        *mean, share(F.col("prob_rem") > 0.5).alias("rem_certainty"), nrem.alias("rem_mean_prob_nrem"),
        share(F.col("prob_w") > 0.2).alias("rem_high_wake_prob_frac"),
    )
    return for_all_sessions(df, out)


def rem_stability(df: DataFrame, fs: float, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    n = runs.with_neighbour_stage(df.select(KEY, T, "stage", "prob_rem"), chunk_s=chunk_s)
    is_rem = F.col("stage") == "REM"
    exits = (F.col("prev_stage") == "REM") & ~F.col("stage").eqNullSafe(F.lit("REM"))
    sure = F.coalesce(F.col("prob_rem") > 0.5, F.lit(False)).cast("int")
    g = n.groupBy(KEY).agg(
        F.count_if(is_rem).alias("_rem"), F.count_if(exits).alias("_out"), F.count_if(exits & (F.col("stage") == "W")).alias("_w"),
        F.avg(F.when(is_rem, F.col("prob_rem"))).alias("_stab"), F.avg(sure).alias("_amount"),
    )
    some = F.col("_rem") > 0
    hours = minutes(F.col("_rem"), fs) / 60.0
    return g.select(
        KEY, F.round("_stab", 4).alias("rem_stability_index"), F.round(over(F.col("_out"), hours), 4).alias("rem_fragmentation_index"),
        F.when(some, F.round(over(F.col("_w"), F.col("_out")), 4)).alias("rem_w_transition_frac"),
        F.when(some, F.round("_amount", 4)).alias("amount_of_rem"),
    )


def stage_prob_features(df: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S) -> DataFrame:
    require(df, [T, "stage", *PROB_COLS])
    return rem_stability(df, fs, chunk_s).join(stage_probability(df), KEY, "left")
