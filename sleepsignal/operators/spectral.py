"""Signal operators: regular grids, band-pass filtering, spectra and band power."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from sleepsignal.plans.chunked import CHUNK, Run, row_index_and_total, running, with_time_chunk
from sleepsignal.schemas import KEY, STAGES, T

# Frequency bands in Hz; bands share their edges.
STAGE_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
CONTEXT_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "gamma": (30.0, 45.0)}
ALL = "ALL"
BLOCK_SEGS = 16


def resample_down(samples: DataFrame, fs: float, cols: Sequence[str], by: Sequence[str] = (KEY,)) -> DataFrame:
    """Mean of each channel per grid step of 1/fs seconds."""
    step = F.floor(F.col(T) * F.lit(float(fs))).cast("long")
    out = samples.groupBy(*by, step.alias("sample_idx")).agg(*[F.avg(c).alias(c) for c in cols])
    return out.withColumn(T, F.col("sample_idx") / F.lit(float(fs)))


def resample_up(samples: DataFrame, fs: float, cols: Sequence[str], chunk_s: float = 3600.0) -> DataFrame:
    """Linear interpolation of each channel onto the grid k/fs between first and last sample."""
    f = F.lit(float(fs))
    body = F.struct(F.col(T).alias("t"), *[F.col(c) for c in cols])
    t0, t1 = F.floor(F.col("_a") * f).cast("long"), F.floor(F.col("_z") * f).cast("long")
    # Grid points are generated per time chunk, so no row expands into a whole night.
    ends = with_time_chunk(samples.select(KEY, T), T, chunk_s).groupBy(KEY).agg(
        F.min(T).alias("_a"), F.max(T).alias("_z"), F.min(CHUNK).alias("_c0"), F.max(CHUNK).alias("_c1"))
    chunks = ends.withColumn(CHUNK, F.explode(F.sequence("_c0", "_c1")))
    lo = F.greatest(F.ceil(F.col("_a") * f).cast("long"), F.ceil(F.col(CHUNK) * chunk_s * f).cast("long"))
    hi = F.least(t1, F.ceil((F.col(CHUNK) + 1) * chunk_s * f).cast("long") - 1)
    grid = chunks.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").select(
        KEY, F.explode(F.sequence("_lo", "_hi")).alias("sample_idx"))
    u = samples.select(KEY, F.col(T).alias("_t"), F.lit(0).alias("_kind"), body.alias("_s")).unionByName(
        grid.select(KEY, (F.col("sample_idx") / f).alias("_t"), F.lit(1).alias("_kind"), "sample_idx"), allowMissingColumns=True)
    r = running(with_time_chunk(u, "_t", chunk_s), [KEY], ["_t", "_kind"],
                [Run("_b", F.col("_s"), "last"), Run("_f", F.col("_s"), "next")],
                order_ahead=[F.desc("_t"), F.asc("_kind")]).filter("_kind = 1")
    b, a, t = F.col("_b"), F.col("_f"), F.col("_t")
    w = F.when(a.t > b.t, (t - b.t) / (a.t - b.t)).otherwise(0.0)
    return r.select(KEY, "sample_idx", t.alias(T), *[(b[c] + (a[c] - b[c]) * w).alias(c) for c in cols])


def fir_taps(fs: float, lo: float, hi: float, n: int) -> np.ndarray:
    """Windowed-sinc band-pass of odd length n (Hamming window)."""
    k = np.arange(n) - (n - 1) / 2
    low = lambda f: 2 * f / fs * np.sinc(2 * f / fs * k)
    return (low(hi) - low(lo)) * np.hamming(n)


def bandpass_filter(
    samples: DataFrame, taps: Sequence[float], cols: Sequence[str], idx: str = "sample_idx", chunk_rows: int = 65536,
    suffix: str = "_clean", keep: Sequence[str] = (), digits: int | None = None,
) -> DataFrame:
    """Zero-phase FIR over the sample index; samples outside the series count as 0.

    Columns named in ``keep`` are passed on. ``digits`` rounds the result, so that it does not depend on the order of sums.

    Chunks carry a halo of half the filter length copied from their neighbours, so the
    series is filtered in parallel and the seams are exact.
    """
    taps = np.asarray(taps, dtype=float)
    half = len(taps) // 2
    if half >= chunk_rows:
        raise ValueError("chunk_rows must exceed half the filter length")
    i = F.col(idx)
    home = F.floor(i / chunk_rows).cast("long")
    near = F.array_distinct(F.array(F.floor((i - half) / chunk_rows).cast("long"), home, F.floor((i + half) / chunk_rows).cast("long")))
    src = samples.select(KEY, idx, *cols, *[c for c in keep if c not in cols], F.explode(near).alias(CHUNK)).filter(F.col(CHUNK) >= 0)
    schema = Ty.StructType([
        samples.schema[KEY], Ty.StructField(idx, Ty.LongType()), *[Ty.StructField(f"{c}{suffix}", Ty.DoubleType()) for c in cols],
        *[samples.schema[c] for c in keep],
    ])

    def filtered(rows: pa.Table, turn: np.ndarray) -> pa.RecordBatch:
        """Whole chunks, the first rows of which are ``turn``: laid out one after the other with zeros between, one pass per channel."""
        at = rows.column(idx).to_numpy().astype(np.int64)
        sizes = np.diff([*turn, len(at)])
        lo, hi = at[turn], at[np.append(turn[1:], len(at)) - 1]
        slots = np.concatenate([[0], np.cumsum(hi - lo + 1 + 2 * half)])
        spot = at - np.repeat(lo - slots[:-1], sizes) + half
        mine = at // chunk_rows == rows.column(CHUNK).to_numpy()
        out = [rows.column(KEY), rows.column(idx).cast(pa.int64())]
        for c in cols:
            x = np.zeros(slots[-1])
            x[spot] = np.nan_to_num(rows.column(c).cast(pa.float64()).to_numpy())
            y = np.convolve(x, taps, mode="valid")[spot - half]
            out.append(pa.array(y if digits is None else np.round(y, digits)))
        out += [rows.column(c) for c in keep]
        return pa.Table.from_arrays(out, schema.names).filter(pa.array(mine)).combine_chunks()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def whole() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column(KEY).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            turn = np.append(0, np.flatnonzero((np.diff(rows.column(CHUNK).to_numpy()) != 0) | (np.diff(key) != 0)) + 1)
            yield from filtered(rows, turn).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(CHUNK).to_numpy()
            key = batch.column(KEY).dictionary_encode(null_encoding="encode").indices.to_numpy()
            turn = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(key) != 0)) + 1
            first = (batch.column(KEY)[0].as_py(), chunk[0])
            if held and first != last:
                yield from whole()
                held = []
            if len(turn):  # the last chunk of a batch may go on in the next
                held.append(batch.slice(0, turn[-1]))
                yield from whole()
                held = []
            held.append(batch.slice(turn[-1] if len(turn) else 0))
            last = (batch.column(KEY)[batch.num_rows - 1].as_py(), chunk[-1])
        if held:
            yield from whole()

    return src.repartition(KEY, CHUNK).sortWithinPartitions(KEY, CHUNK, idx).mapInArrow(apply, schema)


def antiphase_gate(df: DataFrame, loc: str = "LOC_clean", roc: str = "ROC_clean") -> DataFrame:
    """Cleaned channels, 0 where both eyes' channels do not move in opposite directions."""
    anti = F.col(loc) * F.col(roc) < 0
    return df.withColumns({"loc_clean": F.when(anti, F.col(loc)).otherwise(0.0), "roc_clean": F.when(anti, F.col(roc)).otherwise(0.0)})


def density(segments: Sequence, fs: float) -> pd.Series:
    """One-sided spectral density of each segment: Hann window, mean removed; segments of equal length go together."""
    out: list = [None] * len(segments)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for i, row in zip(where, densities(np.stack([np.asarray(segments[i], dtype=float) for i in where]), fs)):
            out[i] = row
    return pd.Series(out)


def densities(x: np.ndarray, fs: float) -> np.ndarray:
    """``density`` of the rows of a matrix."""
    n = x.shape[1]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spec = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
    spec[:, 1 : None if n % 2 else -1] *= 2
    return spec


def _psd_udf(fs: float):
    @F.pandas_udf("total array<double>, segs long")
    def psd(at: pd.Series, x: pd.Series, size: pd.Series) -> pd.DataFrame:
        """Sum of the densities of a block's segments, and their number; values of equal position are added up, segments with a NULL left out."""
        segments, owner = [], []
        for row, (i, v, n) in enumerate(zip(at, x, size, strict=True)):
            line = np.bincount(np.asarray(i) - np.min(i), np.asarray(v, dtype=float))
            cuts = np.lib.stride_tricks.sliding_window_view(line, n)[:: n - n // 2]
            cuts = cuts[~np.isnan(cuts).any(axis=1)]
            segments += list(cuts)
            owner.append(len(cuts))
        spec, ends = density(segments, fs).to_list(), np.cumsum([0, *owner])
        total = [np.sum(spec[a:b], axis=0) if a < b else [None] * (int(n) // 2 + 1) for a, b, n in zip(ends, ends[1:], size)]
        return pd.DataFrame({"total": total, "segs": owner})

    return psd


def welch(df: DataFrame, by: Sequence[str], pos: str, x: str, fs: float, seg_s: float = 4.0, min_n: float = 1) -> DataFrame:
    """Mean one-sided spectral density per group: columns k, freq, psd.

    ``pos`` is the 0-based position in the group and column ``n`` the size of the group; the values of rows of equal position are
    added up.  Hann segments of ``seg_s`` seconds (the whole series when shorter), half overlapping, mean removed.  Blocks of
    ``BLOCK_SEGS`` segments, never a series, are the unit of work: a row is sent once, or twice where two blocks overlap, and a
    block hands on the sum of its segments' spectra.
    """
    by = list(by)
    n, size = F.col("n"), F.col("_size")
    d = df.filter(n >= min_n).withColumn("_size", F.least(F.lit(int(seg_s * fs)).cast("long"), n))
    step = size - F.floor(size / 2)
    segs = F.floor((n - F.floor(size / 2)) / step)
    i = F.col(pos)
    lo = F.greatest(F.lit(0).cast("long"), F.floor((i - size) / step) + 1)
    hi = F.least(F.floor(i / step), segs - 1)
    blocks = F.sequence(F.floor(F.col("_lo") / BLOCK_SEGS), F.floor(F.col("_hi") / BLOCK_SEGS))
    rows = d.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    rows = rows.select(*by, "_size", pos, x, F.explode(blocks).alias("_block"))
    filled = F.coalesce(F.col(x), F.lit(float("nan")))
    vec = rows.groupBy(*by, "_block", "_size").agg(F.collect_list(F.struct(F.col(pos).alias("i"), filled.alias("x"))).alias("_v"))
    sums = vec.select(*by, "_size", _psd_udf(fs)(F.col("_v.i"), F.col("_v.x"), size).alias("_s"))
    spec = sums.select(*by, "_size", F.col("_s.segs").alias("_segs"), F.posexplode("_s.total").alias("k", "_p"))
    return spec.groupBy(*by, "_size", "k").agg((F.sum("_p") / F.nullif(F.sum("_segs"), F.lit(0))).alias("psd")).select(
        *by, "k", (F.col("k") * fs / F.col("_size")).alias("freq"), "psd")


def band_power(psd: DataFrame, by: Sequence[str], bands: dict[str, tuple[float, float]], empty_is_null: bool) -> DataFrame:
    """Trapezoid of the density over each band, both edges included; one row per group."""
    w = Window.partitionBy(*by).orderBy("k")
    p = psd.withColumns({"_pf": F.lag("freq").over(w), "_pp": F.lag("psd").over(w)})
    area = (F.col("psd") + F.col("_pp")) / 2 * (F.col("freq") - F.col("_pf"))
    aggs = []
    for name, (lo, hi) in bands.items():
        inside = F.col("freq").between(lo, hi)
        s = F.coalesce(F.sum(F.when(inside & F.col("_pf").between(lo, hi), area)), F.lit(0.0))
        s = F.when(F.count_if(inside) > 0, s) if empty_is_null else s
        aggs.append(F.nanvl(s, F.lit(None).cast("double")).alias(name))
    return p.groupBy(*by).agg(*aggs)


def positions(df: DataFrame, by: Sequence[str], chunk_s: float, name: str = "pos", total: str = "n") -> DataFrame:
    """0-based position in time order within a group, and the size of the group."""
    return row_index_and_total(with_time_chunk(df, T, chunk_s), list(by), [T], name, total).drop(CHUNK)


def stage_signal(df: DataFrame, chunk_s: float) -> DataFrame:
    """Mean of both channels per stage and over the whole night, as one row per channel with half its value.

    NULLs are dropped per channel, then the channels are paired by position, so the
    longer one is cut to the length of the shorter. ``welch`` adds up the halves of a position: nothing is joined.
    """
    groups = F.array_compact(F.array(F.when(F.col("stage").isin(*STAGES), F.col("stage")), F.lit(ALL)))
    base = df.select(KEY, T, F.explode(groups).alias("stage"), "EEG_LOC", "EEG_ROC")
    there = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("long")
    sides = {"l": "EEG_LOC", "r": "EEG_ROC"}
    counts = [Run(f"_{kind}_{k}", there(c), kind) for k, c in sides.items() for kind in ("sum", "total")]
    counted = running(with_time_chunk(base, T, chunk_s), [KEY, "stage"], [T], counts)
    halves = F.explode(F.array(*[F.struct((F.col(f"_sum_{k}") - 1).alias("pos"), (F.col(c) / 2).alias("x")) for k, c in sides.items()]))
    each = counted.select(KEY, "stage", F.least("_total_l", "_total_r").alias("n"), halves.alias("_h")).select(KEY, "stage", "n", "_h.*")
    return each.filter(F.col("x").isNotNull() & (F.col("pos") < F.col("n"))).select(KEY, "stage", "pos", "n", "x")


def context_signal(df: DataFrame, chunk_s: float, stage: Column | None = None) -> DataFrame:
    """Mean of both channels in REM, phasic REM and tonic REM; NULL counts as 0 when both channels exist."""
    has = df.groupBy(KEY).agg(F.count("EEG_LOC").alias("_nl"), F.count("EEG_ROC").alias("_nr"))
    kinds = F.array_compact(F.array(
        F.lit("rem"), F.when(F.col("EpochType") == "Phasic", "phasic"), F.when(F.col("EpochType") == "Tonic", "tonic")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = F.when((F.col("_nl") > 0) & (F.col("_nr") > 0), (zero("EEG_LOC") + zero("EEG_ROC")) / 2).when(
        F.col("_nl") > 0, F.col("EEG_LOC")).when(F.col("_nr") > 0, F.col("EEG_ROC"))
    rem = df.filter((F.col("stage") if stage is None else stage) == "REM").join(has.filter("_nl > 0 OR _nr > 0"), KEY)
    return positions(rem.select(KEY, T, F.explode(kinds).alias("context"), x.alias("x")), [KEY, "context"], chunk_s)


def psd_curve(df: DataFrame, fs: float, chunk_s: float, lo: float = 0.5, hi: float = 35.0, min_s: float = 10.0, seg_s: float = 4.0) -> DataFrame:
    """Density per stage and channel in a frequency range."""
    long = df.filter(F.col("stage").isin(*STAGES)).select(
        KEY, T, "stage", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in ("EEG_LOC", "EEG_ROC")])).alias("_s")
    ).select(KEY, T, "stage", "_s.*").filter(F.col("x").isNotNull())
    p = positions(long, [KEY, "stage", "channel"], chunk_s)
    return welch(p, [KEY, "stage", "channel"], "pos", "x", fs, seg_s, min_s * fs).filter(F.col("freq").between(lo, hi))
