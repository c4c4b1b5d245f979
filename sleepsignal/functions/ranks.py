"""Rank statistics of two labelled samples from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.plans.chunked import CHUNK, Run, running, with_value_chunk


def value_counts(df: DataFrame, keys: Sequence[str], value: str, y: str, weight: str | None = None) -> DataFrame:
    """Per (keys, value): weight of positives and negatives; ties collapse before any ordering."""
    w = F.lit(1) if weight is None else F.col(weight)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(
            F.sum(F.when(F.col(y) == 1, w).otherwise(F.lit(0))).cast("long").alias("_pos"),
            F.sum(F.when(F.col(y) == 0, w).otherwise(F.lit(0))).cast("long").alias("_neg"),
        )
    )


def cumulative_counts(counts: DataFrame, keys: Sequence[str], n_chunks: int = 512, bound_keys: Sequence[str] | None = None) -> DataFrame:
    """Adds the inclusive running counts ``_cpos`` and ``_cneg`` by ascending value."""
    return running(
        with_value_chunk(counts, keys, "_v", n_chunks, bound_keys=bound_keys),
        keys,
        ["_v"],
        [Run("_cpos", F.col("_pos"), "sum"), Run("_cneg", F.col("_neg"), "sum")],
    ).drop(CHUNK)


def rank_sums(
    df: DataFrame, keys: Sequence[str], value: str, y: str, weight: str | None = None, bound_keys: Sequence[str] | None = None
) -> DataFrame:
    """Per key: n_pos, n_neg, Mann-Whitney U of the positives, tie term and AUC."""
    cum = cumulative_counts(value_counts(df, keys, value, y, weight), keys, bound_keys=bound_keys)
    t = (F.col("_pos") + F.col("_neg")).cast("double")
    u = F.col("_pos") * (F.col("_cneg") - F.col("_neg") / F.lit(2.0))
    return (
        cum.groupBy(*keys)
        .agg(
            F.sum("_pos").alias("n_pos"),
            F.sum("_neg").alias("n_neg"),
            F.sum(u).alias("u"),
            F.sum(t * t * t - t).alias("tie_term"),
        )
        .withColumn("auc", F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg").cast("double"), F.lit(0.0)))
    )
