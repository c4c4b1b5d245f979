"""Runs, spans, transitions and per-key reductions of a session's label sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.plans.chunked import CHUNK, Run, row_index, run_ids, running, with_time_chunk
from sleepsignal.schemas import KEY, T

CHUNK_S = 3600.0


def stage_runs(df: DataFrame, label: Column | None = None, chunk_s: float = CHUNK_S, t: str = T) -> DataFrame:
    """Samples plus the number of their run of equal labels."""
    lab = F.col("stage") if label is None else label
    return run_ids(with_time_chunk(df, t, chunk_s), [KEY], [t], lab).drop(CHUNK)


def spans(df: DataFrame, label: Column, chunk_s: float = CHUNK_S, t: str = T, name: str = "stage") -> DataFrame:
    """One row per run: first and last time, label and number of samples."""
    lab = df.withColumn("_span", label)
    return (
        stage_runs(lab, F.col("_span"), chunk_s, t)
        .groupBy(KEY, "run_id")
        .agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.first("_span").alias(name), F.count(F.lit(1)).alias("n"))
    )


def epochtype_spans(df: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    return spans(df, F.coalesce("EpochType", F.lit("None")), chunk_s, name="EpochType")


def mask_runs(df: DataFrame, mask: Column, idx: str, chunk_rows: float, by: Sequence[str] = (KEY,), dealt: bool = False) -> DataFrame:
    """First and last index of every run where the mask is true."""
    r = true_runs(df, mask, idx, chunk_rows, by, dealt)
    return r.groupBy(*by, "run_id").agg(F.min(idx).alias("start_idx"), F.max(idx).alias("end_idx")).drop("run_id")


def true_runs(df: DataFrame, mask: Column, idx: str, chunk_rows: float, by: Sequence[str] = (KEY,), dealt: bool = False) -> DataFrame:
    """Rows where the mask is true; the run is named by the last index before it where it is not. ``dealt``: see ``running``."""
    m = df.withColumn("_m", F.coalesce(mask, F.lit(False)))
    m = m if dealt else with_time_chunk(m, idx, chunk_rows)
    r = running(m, list(by), [idx], [Run("run_id", F.when(~F.col("_m"), F.col(idx)), "last")], dealt=dealt)
    return r.filter("_m").withColumn("run_id", F.coalesce("run_id", F.lit(-1))).drop("_m", CHUNK)


def with_neighbour_stage(df: DataFrame, lead: bool = False, chunk_s: float = CHUNK_S) -> DataFrame:
    """Adds ``prev_stage`` (or ``next_stage``) and whether such a row exists."""
    name = "next_stage" if lead else "prev_stage"
    here = F.struct(F.lit(True).alias("there"), F.col("stage").alias("s"))
    r = running(with_time_chunk(df, T, chunk_s), [KEY], [T], [Run("_n", here, "lead" if lead else "lag")])
    return r.withColumns({name: F.col("_n.s"), f"has_{name[:4]}": F.coalesce("_n.there", F.lit(False))}).drop("_n", CHUNK)


def stage_transitions(
    df: DataFrame, from_stage: str | None = None, to_stage: str | None = None, chunk_s: float = CHUNK_S
) -> DataFrame:
    """Samples after which the stage changes, with the stage they change to."""
    n = with_neighbour_stage(df.select(KEY, T, "stage"), lead=True, chunk_s=chunk_s)
    out = n.filter(F.col("next_stage").isNotNull() & ~F.col("stage").eqNullSafe(F.col("next_stage")))
    if from_stage is not None:
        out = out.filter(F.col("stage") == from_stage)
    if to_stage is not None:
        out = out.filter(F.col("next_stage") == to_stage)
    return out.select(KEY, T, F.col("stage").alias("from_stage"), F.col("next_stage").alias("to_stage"))


def rem_exits(df: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Steps out of REM, and those that go straight to wake."""
    n = with_neighbour_stage(df.select(KEY, T, "stage"), chunk_s=chunk_s)
    out = (F.col("prev_stage") == "REM") & ~F.col("stage").eqNullSafe(F.lit("REM"))
    return n.groupBy(KEY).agg(
        F.count_if(out).alias("n_exits"), F.count_if((F.col("prev_stage") == "REM") & (F.col("stage") == "W")).alias("n_to_wake")
    )


def first_per_key(df: DataFrame, key: str, cols: Sequence[str], t: str = T) -> DataFrame:
    """Earliest row of each (session, key); NULL counts as one key.

    An aggregate rather than a row_number filter: a repeated key collapses before the shuffle.
    """
    keep = [c for c in cols if c not in (KEY, key)]
    row = F.struct(F.col(t).alias("_t"), *[F.col(c).alias(c) for c in keep])
    return df.groupBy(KEY, key).agg(F.min_by(row, t).alias("_r")).select(KEY, key, *[F.col(f"_r.{c}").alias(c) for c in keep])


def subepoch_series(df: DataFrame, length_s: float = 4.0, stage: Column | None = None) -> DataFrame:
    """REM sub-epochs on the timeline: first labelled row of each ``t // length`` bin."""
    rem = (F.col("stage") if stage is None else stage) == "REM"
    s = df.filter(rem & F.col("EpochType").isNotNull()).withColumn("bin", F.floor(F.col(T) / length_s).cast("long"))
    return s.groupBy(KEY, "bin").agg(F.min_by("EpochType", T).alias("EpochType"))


def bouts(series: DataFrame, break_on_gap: bool = False, chunk_bins: int = 4096) -> DataFrame:
    """Runs of equal labels in the sub-epoch sequence; time gaps do not end a bout by default."""
    s = with_time_chunk(series, "bin", chunk_bins)
    label = F.col("EpochType")
    if break_on_gap:
        s = row_index(s, [KEY], ["bin"], "_pos")
        label = F.struct("EpochType", F.col("bin") - F.col("_pos"))
    r = run_ids(s, [KEY], ["bin"], label)
    return r.groupBy(KEY, "run_id", "EpochType").agg(F.count(F.lit(1)).alias("length"))


def label_changes(series: DataFrame, chunk_bins: int = 4096) -> DataFrame:
    """Number of label changes along the sub-epoch sequence."""
    r = run_ids(with_time_chunk(series, "bin", chunk_bins), [KEY], ["bin"], F.col("EpochType"))
    return r.groupBy(KEY).agg((F.max("run_id") - 1).alias("n_changes"))


def first_n(df: DataFrame, n: int, order: str = T, name: str = "rn") -> DataFrame:
    """First n rows of each session; Spark applies the limit before the shuffle as well."""
    w = Window.partitionBy(KEY).orderBy(order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def crop_windows(samples: DataFrame, anchors: DataFrame, lo: float, hi: float, anchor: str = "anchor_t") -> DataFrame:
    """Samples with anchor + lo <= t < anchor + hi, with the time relative to the anchor.

    Both sides are bucketed by window length, so an anchor reaches two buckets and a
    sample is compared only with the anchors of its own bucket.
    """
    width = float(hi - lo)
    first = F.floor((F.col(anchor) + lo) / width).cast("long")
    a = anchors.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    s = samples.withColumn("_bucket", F.floor(F.col(T) / width).cast("long"))
    hit = (F.col(T) >= F.col(anchor) + lo) & (F.col(T) < F.col(anchor) + hi)
    return s.join(a, [KEY, "_bucket"]).filter(hit).withColumn("rel_t", F.col(T) - F.col(anchor)).drop("_bucket")


def stage_anchors(df: DataFrame, stage: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Start time of every run of a stage."""
    n = with_neighbour_stage(df.select(KEY, T, "stage"), chunk_s=chunk_s)
    start = (F.col("stage") == stage) & ~F.col("prev_stage").eqNullSafe(F.lit(stage))
    return n.filter(start).select(KEY, F.col(T).alias("anchor_t"))


def onset_latency(df: DataFrame, first: Column, then: Column, name: str) -> DataFrame:
    """First time of ``then`` minus first time of ``first``."""
    at = lambda c: F.min(F.when(c, F.col(T)))
    return df.groupBy(KEY).agg((at(then) - at(first)).alias(name))


def hypnogram_upsample(samples: DataFrame, hypnogram: DataFrame, fs: float, epoch_s: float = 30.0, idx: str = "sample_idx") -> DataFrame:
    """Stage of the epoch each sample index falls in; samples past the last epoch are cut."""
    e = F.floor(F.col(idx) / F.lit(fs * epoch_s)).cast("long")
    return samples.withColumn("epoch_idx", e).join(hypnogram.select(KEY, "epoch_idx", "stage_code"), [KEY, "epoch_idx"])
