"""Feature groups: one row per session, NULL where a feature is not defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleepsignal.schemas import KEY


#: Rows of a condensed timeline stand for this many samples; in a table of samples there is no such column.
WEIGHT = "_weight"


def narrow(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, and the weight where there is one."""
    return df.select(*cols, *([WEIGHT] if WEIGHT in df.columns else []))


def samples(df: DataFrame, when: Column | None = None) -> Column:
    """Aggregate: number of samples, of those where ``when`` holds."""
    if WEIGHT not in df.columns:
        return F.count(F.lit(1)) if when is None else F.count_if(when)
    w = F.col(WEIGHT) if when is None else F.when(when, F.col(WEIGHT))
    return F.coalesce(F.sum(w), F.lit(0)).cast("long")


def minutes(n: Column, fs: float) -> Column:
    return n / F.lit(float(fs)) / F.lit(60.0)


def over(a: Column, b: Column) -> Column:
    """Ratio, NULL for a zero denominator."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def rounded_time(c: Column, digits: int) -> Column:
    """Difference of two times, rounded half away from zero after scaling: what the subtraction leaves in the last bits moves no half."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale, 0) / scale


def for_all_sessions(df: DataFrame, feats: DataFrame) -> DataFrame:
    return df.select(KEY).distinct().join(feats, KEY, "left")


def rem_samples(df: DataFrame) -> DataFrame:
    """Per session: number of samples and of REM samples."""
    return df.groupBy(KEY).agg(samples(df).alias("_n"), samples(df, F.col("stage") == "REM").alias("_n_rem"))
