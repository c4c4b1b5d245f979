"""Eye-movement events: detection on cleaned channels, typing and sub-epoch rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.operators.clean import em_type
from sleepsignal.operators.runs import mask_runs
from sleepsignal.plans.chunked import CHUNK, Run, join_per_key, running, with_time_chunk
from sleepsignal.schemas import KEY, require
from sleepsignal.session import cut

AMP_LIMIT = 600.0
PERCENTILE = 0.92
CHUNK_ROWS = 460_000
SPACING_CHUNK = 100_000


def stagewise_threshold(samples: DataFrame, loc: str = "LOC", roc: str = "ROC", p: float = PERCENTILE) -> DataFrame:
    """Mean over stages of the p-quantile of abs(signal), averaged over both channels."""
    long = samples.select(
        KEY, F.coalesce("stage", F.lit("W")).alias("stage"),
        F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.abs(loc).alias("v")),
                          F.struct(F.lit(1).alias("ch"), F.abs(roc).alias("v")))).alias("_s"),
    ).select(KEY, "stage", "_s.*")
    q = exact_quantiles(long, [KEY, "stage", "ch"], "v", {"q": p})
    return (
        q.groupBy(KEY, "ch").agg(F.avg("q").alias("q")).groupBy(KEY).agg(F.avg("q").alias("threshold"))
    )


def difference_threshold(samples: DataFrame, loc: str = "loc_clean", roc: str = "roc_clean", limit: float = AMP_LIMIT, p: float = PERCENTILE) -> DataFrame:
    """p-quantile of abs(roc - loc) among the values below the amplitude limit."""
    d = samples.withColumn("_a", F.abs(F.col(roc) - F.col(loc))).filter(F.col("_a") < limit)
    return exact_quantiles(d, [KEY], "_a", {"threshold": p})


def amplitude_steps(samples: DataFrame, idx: str = "sample_idx", loc: str = "loc_clean", roc: str = "roc_clean", chunk_rows: int = CHUNK_ROWS, per_key: DataFrame | None = None) -> DataFrame:
    """Samples with ``amp`` = abs(roc - loc), the adjacent samples as structs ``prev`` / ``next`` and the columns of ``per_key``."""
    cols = [loc, roc, "stage"] if "stage" in samples.columns else [loc, roc]
    me = F.struct(F.col(idx).alias("i"), *[F.col(c) for c in cols])
    s = running(
        with_time_chunk(samples, idx, chunk_rows), [KEY], [idx], [Run("prev", me, "lag"), Run("next", me, "lead")], per_key=per_key
    )
    # The amplitude is made from the channels on the spot and not sent along.
    amp = lambda side: F.when(F.col(side).isNotNull(), F.col(side).withField("amp", F.abs(F.col(f"{side}.{roc}") - F.col(f"{side}.{loc}"))))
    return s.withColumns({"amp": F.abs(F.col(roc) - F.col(loc)), "prev": amp("prev"), "next": amp("next")})


def is_minimum() -> Column:
    """The first difference turns upwards here, or the sample is an end of the series."""
    before = F.signum(F.col("amp") - F.col("prev.amp"))
    after = F.signum(F.col("next.amp") - F.col("amp"))
    return F.col("prev").isNull() | F.col("next").isNull() | (after > before)


def local_minima(samples: DataFrame, threshold: DataFrame, idx: str = "sample_idx", loc: str = "loc_clean", roc: str = "roc_clean", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Minima of the amplitude that lie below half the threshold."""
    s = amplitude_steps(samples, idx, loc, roc, chunk_rows, threshold)
    return s.filter(is_minimum() & (F.col("amp") < F.col("threshold") / 2)).select(KEY, idx, "amp")


def peak_in_run(df: DataFrame, value: str, idx: str, by: list[str]) -> DataFrame:
    """Index of the largest value of each group, first one on ties."""
    return df.groupBy(*by).agg(F.max_by(idx, F.struct(F.col(value), -F.col(idx))).alias("peak_idx"), F.max(value).alias("peak_value"))


def rolling_mask(samples: DataFrame, mask: Column, fs: float, hole_s: float = 2.0, em_s: float = 2.5, idx: str = "sample_idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dilate a mask over ``hole_s`` then erode it over ``em_s`` (centred windows).

    A window holds a true sample when the last one up to its end lies behind its start. Every chunk also gets the
    samples of its neighbours in reach of both windows, so one sort of the chunk is enough and nothing is carried.
    """
    i = F.col(idx)

    def reach(size: float) -> tuple[int, int]:
        n = int(size)
        return n // 2, max(0, n - n // 2 - 1)

    (h, k), (h2, k2) = reach(hole_s * fs), reach(em_s * fs)
    at = lambda c: F.floor(c / F.lit(float(chunk_rows))).cast("long")
    s = samples.withColumns({"_m": F.coalesce(mask, F.lit(False)), "_own": at(i), CHUNK: F.explode(F.sequence(at(i - k - k2), at(i + h + h2)))})
    by = Window.partitionBy(KEY, CHUNK).orderBy(idx)
    last = lambda c, ahead: F.max(F.when(c, i)).over(by.rangeBetween(Window.unboundedPreceding, ahead))
    s = s.repartition(KEY, CHUNK).withColumn("_d", F.coalesce(last(F.col("_m"), k) >= i - h, F.lit(False)))
    s = s.withColumn("is_em", ~F.coalesce(last(~F.col("_d"), k2) >= i - h2, F.lit(False)))
    return s.filter(F.col("_own") == F.col(CHUNK)).drop("_m", "_own", "_d", CHUNK)


def em_candidates(threshold: Column, limit: float = AMP_LIMIT, amp: str = "amp") -> Column:
    return (F.col(amp) < limit) & (F.col(amp) > threshold)


def detect_movements(
    samples: DataFrame, threshold: DataFrame, fs: float = 128.0, idx: str = "sample_idx",
    loc: str = "loc_clean", roc: str = "roc_clean", limit: float = AMP_LIMIT, chunk_rows: int = CHUNK_ROWS, raw: Sequence[str] = (),
) -> DataFrame:
    """One row per eye movement: times, peak amplitudes and slopes.

    With ``raw`` channels, their mean absolute value at the peak is carried along as MeanAbsValPeak. The samples
    are written between the two passes, so the second does not run the first again; it reads minima and candidates only.

    Candidate runs give the peaks; the nearest qualifying minimum on either side
    gives the bases, with the adjacent sample as fallback.
    """
    require(samples, [KEY, idx, loc, roc, "stage"])
    s = amplitude_steps(samples, idx, loc, roc, chunk_rows, threshold.select(KEY, "threshold"))
    mean = [F.when(F.col("_cand"), sum((F.abs(c) for c in raw), F.lit(0.0)) / len(raw)).alias("MeanAbsValPeak")] if raw else []
    s = s.withColumns({
        "_cand": F.coalesce(em_candidates(F.col("threshold"), limit), F.lit(False)),
        "_low": F.coalesce(is_minimum() & (F.col("amp") < F.col("threshold") / 2), F.lit(False)),
        "_goes_on": F.coalesce(em_candidates(F.col("threshold"), limit, "prev.amp"), F.lit(False)),
    })
    # Only minima and candidates ever look at their neighbours, so the others are written without.
    side = lambda c, where: F.when(where & F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("i", loc, roc, "stage")])).alias(c)
    s = cut(s.select(KEY, idx, loc, roc, "stage", *mean, CHUNK, "_cand", "_low", (F.col("_cand") & ~F.col("_goes_on")).alias("_begins"),
                     side("prev", F.col("_cand") | F.col("_low")), side("next", F.col("_cand"))))
    # Candidates know whether their run begins, so the second pass needs no other samples.
    s = s.filter(F.col("_cand") | F.col("_low"))
    me = F.struct(F.col(idx).alias("i"), loc, roc, "stage")
    before_me = F.coalesce(F.col("prev"), me)
    s = running(s, [KEY], [idx], [
        Run("_left", F.when(F.col("_low"), me), "last_before"),
        Run("_right", F.when(F.col("_low"), before_me), "next_after"),
        Run("run_id", F.when(F.col("_begins"), F.col(idx)), "last"),
    ])
    left = F.coalesce("_left", "prev", me)
    right = F.coalesce("_right", "next", me)
    s = s.withColumns({"_l": left, "_r": right})
    row = F.struct(F.col(idx).alias("i"), F.col(loc), F.col(roc), F.col("_l"), F.col("_r"), *(["MeanAbsValPeak"] if raw else []))
    ev = (
        s.filter("_cand").groupBy(KEY, "run_id").agg(F.max_by(row, F.struct(F.abs(F.col(roc) - F.col(loc)), -F.col(idx))).alias("p"))
        .select(KEY, "run_id", "p.*")
    )
    rise = F.nullif((F.col("i") - F.col("_l.i")) / fs, F.lit(0.0))
    fall = F.nullif((F.col("_r.i") - F.col("i")) / fs, F.lit(0.0))
    slope = lambda ch, to, frm, d: F.abs((F.col(to) - F.col(frm)) / d)
    return ev.select(
        KEY,
        (F.col("_l.i") / fs).alias("Start"), (F.col("i") / fs).alias("Peak"), (F.col("_r.i") / fs).alias("End"),
        (F.col("_r.i") / fs - F.col("_l.i") / fs).alias("Duration"),
        F.abs(loc).alias("LOCAbsValPeak"), F.abs(roc).alias("ROCAbsValPeak"),
        slope("loc", loc, f"_l.{loc}", rise).alias("LOCAbsRiseSlope"),
        slope("roc", roc, f"_l.{roc}", rise).alias("ROCAbsRiseSlope"),
        slope("loc", f"_r.{loc}", loc, fall).alias("LOCAbsFallSlope"),
        slope("roc", f"_r.{roc}", roc, fall).alias("ROCAbsFallSlope"),
        F.col("_l.stage").alias("Stage"), *(["MeanAbsValPeak"] if raw else []),
    )


def bases(samples: DataFrame, threshold: DataFrame, idx: str = "sample_idx", loc: str = "loc_clean", roc: str = "roc_clean", limit: float = AMP_LIMIT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Left and right base index of each candidate peak."""
    e = detect_movements(samples, threshold, 1.0, idx, loc, roc, limit, chunk_rows)
    return e.select(KEY, *[F.col(a).cast("long").alias(b) for a, b in
                           (("Peak", "peak_idx"), ("Start", "left_idx"), ("End", "right_idx"))])


def em_mean_amplitude(events: DataFrame, samples: DataFrame, fs: float, idx: str = "sample_idx") -> DataFrame:
    """Adds MeanAbsValPeak: (abs(loc) + abs(roc)) / 2 at the sample nearest to the peak."""
    n = samples.groupBy(KEY).agg((F.max(idx)).alias("_last"))
    at = F.least(F.greatest(F.bround(F.col("Peak") * fs).cast("long"), F.lit(0).cast("long")), F.col("_last"))
    amp = ((F.abs("LOC") + F.abs("ROC")) / 2).alias("MeanAbsValPeak")
    e = events.join(n, KEY).withColumn("_at", at)
    return e.join(samples.select(KEY, F.col(idx).alias("_at"), amp), [KEY, "_at"], "left").drop("_at", "_last")


def detect_em(samples: DataFrame, fs: float = 128.0, sem_s: float = 0.5, threshold: DataFrame | None = None, **kw) -> DataFrame:
    """Events typed as slow (SEM) or rapid (REM) with their mean peak amplitude."""
    th = stagewise_threshold(samples) if threshold is None else threshold
    e = detect_movements(samples, th, fs, raw=("LOC", "ROC"), **kw)
    return e.withColumn("EM_Type", em_type(F.col("Duration"), sem_s))


def subepoch_grid(hypnogram: DataFrame, durations: DataFrame, epoch_s: float = 30.0, sub_s: float = 4.0) -> DataFrame:
    """Full sub-epochs whose start lies in a REM epoch; the grid starts at 0."""
    e = F.col("epoch_idx")
    lo = F.ceil(e * F.lit(epoch_s) / F.lit(sub_s)).cast("long")
    hi = (F.ceil((e + 1) * F.lit(epoch_s) / F.lit(sub_s)) - 1).cast("long")
    g = hypnogram.filter(F.col("stage_code") == 4).filter(lo <= hi).select(KEY, "epoch_idx", F.explode(F.sequence(lo, hi)).alias("slot"))
    start = F.round(F.col("slot") * F.lit(float(sub_s)), 6)
    return (
        g.join(durations.select(KEY, "duration_s"), KEY).filter(start + sub_s <= F.col("duration_s"))
        .select(KEY, "slot", start.alias("SubEpochStart"), (start + sub_s).alias("SubEpochEnd"), F.col("epoch_idx").cast("int").alias("EpochIdx"))
    )


def classify_subepochs(
    hypnogram: DataFrame, durations: DataFrame, events: DataFrame,
    epoch_s: float = 30.0, sub_s: float = 4.0, phasic_s: float = 1.0,
) -> DataFrame:
    """Phasic when the movements peaking in a sub-epoch last at least ``phasic_s`` in total."""
    total = events.groupBy(KEY, F.floor(F.col("Peak") / sub_s).cast("long").alias("slot")).agg(F.sum("Duration").alias("_em_s"))
    g = subepoch_grid(hypnogram, durations, epoch_s, sub_s).join(total, [KEY, "slot"], "left")
    kind = F.when(F.coalesce("_em_s", F.lit(0.0)) >= phasic_s, "Phasic").otherwise("Tonic")
    return g.select(KEY, "SubEpochStart", "SubEpochEnd", "EpochIdx", kind.alias("EpochType"))


def two_window_rule(
    events: DataFrame, epoch_s: float = 4.0, amp_uv: float = 150.0, max_s: float = 0.5, quiet_uv: float = 25.0,
) -> DataFrame:
    """Epochs of REM events on a grid from the session's first event start.

    Phasic: a candidate movement in both halves.  Tonic: no movement, or only
    movements below ``quiet_uv``.  Else Unclassified.
    """
    e = events.filter(F.col("Stage") == "REM")
    ends = e.groupBy(KEY).agg(F.min("Start").alias("_t0"), F.max("Start").alias("_t1"))
    n = F.ceil((F.col("_t1") - F.col("_t0")) / epoch_s).cast("long")
    # Two steps, so that no row holds the grid of a whole session.
    blocks = ends.withColumn("_n", n).filter("_n > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(4096).cast("long"))))
    grid = blocks.select(KEY, "_t0", F.explode(F.sequence("_b", F.least(F.col("_b") + 4095, F.col("_n") - 1))).alias("slot"))
    rel = F.col("Start") - F.col("_t0")
    slot = F.floor(rel / epoch_s).cast("long")
    cand = ((F.col("LOCAbsValPeak") > amp_uv) | (F.col("ROCAbsValPeak") > amp_uv)) & (F.col("Duration") < max_s)
    loud = ~((F.col("LOCAbsValPeak") < quiet_uv) & (F.col("ROCAbsValPeak") < quiet_uv))
    first_half = rel - slot * epoch_s < epoch_s / 2
    per = e.join(ends, KEY).groupBy(KEY, slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("EM_count"), F.count_if(cand & first_half).alias("_c1"),
        F.count_if(cand & ~first_half).alias("_c2"), F.count_if(loud).alias("_loud"),
    )
    kind = F.when((F.col("_c1") > 0) & (F.col("_c2") > 0), "Phasic").when(F.coalesce("_loud", F.lit(0)) == 0, "Tonic").otherwise("Unclassified")
    start = F.col("_t0") + F.col("slot") * F.lit(float(epoch_s))
    return grid.join(per, [KEY, "slot"], "left").select(
        KEY, "slot", F.round(start, 4).alias("EpochStart"), F.round(start + epoch_s, 4).alias("EpochEnd"),
        kind.alias("REM_Type"), F.coalesce("EM_count", F.lit(0)).cast("long").alias("EM_count"),
    )


def min_spacing(epochs: DataFrame, min_gap_s: float = 8.0, epoch_s: float = 4.0) -> DataFrame:
    """Keep an epoch once at least ``min_gap_s`` seconds have passed since the start of the last kept one.

    The rule is greedy from the first epoch of the session on and works on any grid, with holes too. Each epoch
    points to the first one that may follow it; the kept ones are those reached from the first. Pointers are
    doubled in rounds, so a chain of n epochs takes log2 n joins and no session is held in one task.
    """
    every = max(1, math.ceil(min_gap_s / epoch_s - 1e-9))
    slots = epochs.select(KEY, "slot").distinct()
    # the follower is among the slots from slot + every on: the next slot of the epoch every - 1 later or after
    marks = slots.select(KEY, "slot", F.lit(1).alias("_own")).unionByName(slots.select(KEY, (F.col("slot") + every).alias("slot"), F.lit(0).alias("_own")))
    marks = marks.groupBy(KEY, "slot").agg(F.max("_own").alias("_own"))
    ahead = running(
        with_time_chunk(marks, "slot", SPACING_CHUNK), [KEY], ["slot"],
        [Run("_next", F.when(F.col("_own") == 1, F.col("slot")), "next")]).select(KEY, (F.col("slot") - every).alias("slot"), "_next")
    step = cut(ahead.filter("_next is not null").join(slots, [KEY, "slot"], "left_semi"))
    kept = cut(slots.groupBy(KEY).agg(F.min("slot").alias("slot")))
    while True:  # kept slots reach as many again through pointers of the doubled length
        reached = kept.join(step, [KEY, "slot"]).select(KEY, F.col("_next").alias("slot"))
        more = cut(reached.join(kept, [KEY, "slot"], "left_anti").distinct())
        if more.isEmpty():
            break
        kept = cut(kept.unionByName(more))
        to = step.select(KEY, F.col("slot").alias("_next"), F.col("_next").alias("_next2"))
        step = cut(step.join(to, [KEY, "_next"]).select(KEY, "slot", F.col("_next2").alias("_next")))
    return epochs.join(kept, [KEY, "slot"], "left_semi")


def movement_runs(samples: DataFrame, threshold: DataFrame, idx: str = "sample_idx", loc: str = "loc_clean", roc: str = "roc_clean", limit: float = AMP_LIMIT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First and last index of every candidate run."""
    s = with_time_chunk(samples.withColumn("amp", F.abs(F.col(roc) - F.col(loc))), idx, chunk_rows)
    s = join_per_key(s, threshold, [KEY])
    return mask_runs(s, em_candidates(F.col("threshold"), limit), idx, chunk_rows, dealt=True)
