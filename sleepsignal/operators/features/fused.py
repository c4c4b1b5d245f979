"""All features of a night from three scans of the merged timeline.

1. ``condense`` cuts every (session, chunk) into pieces: stretches of samples alike in stage run, sub-epoch, label and events.
   A piece carries its number of samples and the sums that features need, so a night of millions of samples is a few
   thousand rows. All counts, runs, bouts, events and latencies are then made from pieces by the same functions
   that take samples, with the piece's weight.
2. REM amplitudes, for the exact percentile, go to a table of their own.
3. Spectra of stages and contexts share one pass: a task splits its chunks into the series, as arrays. Where a chunk's
   values start in a series follows from sums of the pieces, so arrays are cut at half segments, and both channels meet in the
   segment. No sample is exploded or numbered on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.operators import runs
from sleepsignal.operators.clean import stage_normalise
from sleepsignal.operators.features import WEIGHT, bout, eeg, eog, extra, minutes, over
from sleepsignal.operators.spectral import ALL, CONTEXT_BANDS, STAGE_BANDS, densities
from sleepsignal.plans.chunked import CHUNK, with_time_chunk
from sleepsignal.schemas import KEY, PROB_COLS, STAGES, T, require
from sleepsignal.session import cut

NREM = ("prob_n1", "prob_n2", "prob_n3")
EVENT_COLS = (
    "event_Duration", "event_LOCAbsValPeak", "event_ROCAbsValPeak", "event_LOCAbsRiseSlope", "event_ROCAbsRiseSlope",
    "em_Duration", "em_MeanAbsValPeak", "em_LOCAbsValPeak", "em_ROCAbsValPeak", "em_LOCAbsRiseSlope", "em_ROCAbsRiseSlope",
    "em_LOCAbsFallSlope", "em_ROCAbsFallSlope",
)
LABELS = ("stage", "EpochType", "is_rem_event", "event_Start", "event_Peak", "is_em_event", "em_event_id", "EM_Type")
CONTEXTS = ("rem", "phasic", "tonic")
CHANNELS = ("EEG_LOC", "EEG_ROC")
SERIES = (KEY, "context", "stage", "size", "mode")
PAIR, MIX, LEFT, RIGHT = range(4)  # how the channels of a series make one signal


def condense(df: DataFrame, chunk_s: float, sub_s: float) -> DataFrame:
    """Pieces of the timeline, named and typed like its samples: time of the first, ``_weight`` samples, sums.

    Columns of an event are the same on all its samples, so a piece takes any of them.
    """
    df = with_time_chunk(df, T, chunk_s)
    w = Window.partitionBy(KEY, CHUNK).orderBy(T)
    turn = F.coalesce(~F.col("stage").eqNullSafe(F.lag("stage").over(w)), F.lit(True)).cast("long")
    df = df.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_bin", F.floor(F.col(T) / sub_s))
    nrem = reduce(Column.__add__, [F.col(c) for c in NREM])
    aggs = [F.min(T).alias(T), F.count(F.lit(1)).alias(WEIGHT), *[F.max(c).alias(c) for c in EVENT_COLS if c in df.columns]]
    for c, x in (*[(c, F.col(c)) for c in PROB_COLS], ("nrem", nrem)):
        aggs += [F.sum(x).alias(f"_s_{c}"), F.count(x).alias(f"_c_{c}")]
    aggs += [F.count_if(F.col("prob_rem") > 0.5).alias("_sure"), F.count_if(F.col("prob_w") > 0.2).alias("_wake"),
             F.count("EEG_LOC").alias("_l"), F.count("EEG_ROC").alias("_r")]
    return df.groupBy(KEY, CHUNK, "_run", "_bin", *[c for c in LABELS if c in df.columns]).agg(*aggs)


def probabilities(pieces: DataFrame, fs: float, chunk_s: float) -> DataFrame:
    """The twelve stage-probability features from sums of pieces."""
    rem = F.col("stage") == "REM"
    mean = lambda c, when: over(F.sum(F.when(when, F.col(f"_s_{c}"))), F.sum(F.when(when, F.col(f"_c_{c}"))))
    n_rem = F.sum(F.when(rem, F.col(WEIGHT)))
    share = lambda c: F.round(F.sum(F.when(rem, F.col(c))) / n_rem, 4)
    sums = pieces.groupBy(KEY).agg(
        *[F.round(mean(c, rem), 4).alias(f"rem_mean_{c}") for c in PROB_COLS], share("_sure").alias("rem_certainty"),
        F.round(mean("nrem", rem), 4).alias("rem_mean_prob_nrem"), share("_wake").alias("rem_high_wake_prob_frac"),
        F.round(mean("prob_rem", rem), 4).alias("rem_stability_index"),
        F.when(n_rem > 0, F.round(F.sum("_sure") / F.sum(WEIGHT), 4)).alias("amount_of_rem"), F.coalesce(n_rem, F.lit(0)).alias("_n_rem"))
    steps = runs.rem_exits(pieces, chunk_s)
    hours = minutes(F.col("_n_rem"), fs) / 60.0
    return sums.join(steps, KEY).withColumns({
        "rem_fragmentation_index": F.round(over(F.col("n_exits"), hours), 4),
        "rem_w_transition_frac": F.when(F.col("_n_rem") > 0, F.round(over(F.col("n_to_wake"), F.col("n_exits")), 4)),
    }).drop("_n_rem", "n_exits", "n_to_wake")


# -- spectra ---------------------------------------------------------------------------------------


def _starts(pieces: DataFrame) -> DataFrame:
    """Per (session, chunk): members of each series in earlier chunks (``_b_``) and in all (``_n_``)."""
    rem = F.coalesce(stage_normalise(F.col("stage")) == "REM", F.lit(False))
    here = {s: F.lit(True) if s == ALL else F.col("stage") == s for s in (*STAGES, ALL)}
    sums = {f"{s}_{c}": F.sum(F.when(at, F.col(f"_{c}"))) for s, at in here.items() for c in "lr"}
    sums |= {"rem": F.sum(F.when(rem, F.col(WEIGHT))), **{k.lower(): F.sum(F.when(rem & (F.col("EpochType") == k), F.col(WEIGHT))) for k in ("Phasic", "Tonic")}}
    per = pieces.groupBy(KEY, CHUNK).agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()])
    before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(KEY)
    return per.select(KEY, CHUNK, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(k).over(whole).alias(f"_n_{k}") for k in sums])


def chunk_series(df: DataFrame, chunk_s: float) -> DataFrame:
    """(session, chunk, context, stage, side, values): each series' samples of a chunk, in order, one row per channel.

    Stages and the night hold the channel's non-null values, contexts all of them (NaN for NULL). A task holds one batch of rows or one chunk at a time.
    """
    rem = F.coalesce(stage_normalise(F.col("stage")) == "REM", F.lit(False))
    label = F.col("EpochType") if "EpochType" in df.columns else F.lit(None).cast("string")
    rows = with_time_chunk(df.select(KEY, T, "stage", label.alias("label"), rem.alias("rem"), *CHANNELS), T, chunk_s)
    names = [KEY, CHUNK, "context", "stage", "side", "values"]

    def split(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole chunks: a series is one mask over all of them, cut where they begin."""
        chunks = pa.Table.from_batches(held).combine_chunks()
        turn = np.append(0, turns(chunks.column(KEY).combine_chunks(), chunks.column(CHUNK)))
        sides = [chunks.column(c).to_numpy() for c in CHANNELS]
        is_one = lambda c, name: pc.fill_null(pc.equal(chunks.column(c), name), False).to_numpy()
        rem = chunks.column("rem").to_numpy()
        made = [(False, s, k, here & ~np.isnan(x)) for s in (*STAGES, ALL) for here in [is_one("stage", s) if s != ALL else np.ones(len(rem), bool)] for k, x in enumerate(sides)]
        for name, kind in (("rem", None), ("phasic", "Phasic"), ("tonic", "Tonic")):
            here = rem if kind is None else rem & is_one("label", kind)
            made += [(True, name, k, here) for k in (0, 1)]
        for context, name, k, here in made:
            sizes = np.add.reduceat(here.astype(np.int64), turn)
            some = np.flatnonzero(sizes)
            if len(some):
                at = np.append(0, np.cumsum(sizes[some])).astype(np.int32)
                same = [chunks.column(c).combine_chunks().take(pa.array(turn[some])) for c in (KEY, CHUNK)]
                n = len(some)
                own = [pa.repeat(pa.scalar(v, t), n) for v, t in ((context, pa.bool_()), (name, pa.string()), (k, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, *own, pa.ListArray.from_arrays(pa.array(at), pa.array(sides[k][here]))], names)

    def turns(key: pa.Array, chunk: pa.Array) -> np.ndarray:
        """Rows, but the first, with which a chunk begins."""
        key = key.dictionary_encode().indices.to_numpy()
        return np.flatnonzero((np.diff(chunk.to_numpy()) != 0) | (np.diff(key) != 0)) + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, chunk = batch.column(KEY), batch.column(CHUNK)
            turn = turns(key, chunk)
            if held and (key[0].as_py(), chunk[0].as_py()) != last:
                yield from split(held)
                held = []
            if len(turn):  # the last chunk of a batch may go on in the next
                yield from split([*held, batch.slice(0, turn[-1])])
                held = []
            held.append(batch.slice(turn[-1] if len(turn) else 0))
            last = (key[batch.num_rows - 1].as_py(), chunk[batch.num_rows - 1].as_py())
        if held:
            yield from split(held)

    dealt = rows.filter(F.col(KEY).isNotNull()).repartition(KEY, CHUNK).sortWithinPartitions(KEY, CHUNK, T)
    return dealt.mapInArrow(make, f"{KEY} string, {CHUNK} long, context boolean, stage string, side int, values array<double>")


def fragments(series: DataFrame) -> DataFrame:
    """A chunk's values cut at the half segments of its series: (by..., size, pair, seg, side, at, values).

    ``start`` is the position of the row's first value in its series of ``n``. A fragment goes to the one or two segments that it lies in.
    """
    names = [KEY, "context", "stage", "size", "mode", "seg", "side", "at", "values"]
    types = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column("values")
            for i, (key, context, stage, side, start, n, size, mode) in enumerate(zip(*[batch.column(c).to_pylist() for c in (KEY, "context", "stage", "side", "start", "n", "size", "mode")], strict=True)):
                x = lists[i].values.to_numpy(zero_copy_only=False)
                step = size - size // 2
                segs = (n - size // 2) // step
                end = min(start + len(x), (segs - 1) * step + size)
                at = start
                while at < end:
                    block = at // step
                    stop = min(end, (block + 1) * step)
                    out += [(key, context, stage, size, mode, seg, side, at, x[at - start: stop - start]) for seg in (block - 1, block) if 0 <= seg < segs]
                    at = stop
            for a in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a: a + 2000], strict=True), types, strict=True)], names)

    return series.mapInArrow(make, f"{KEY} string, context boolean, stage string, size long, mode int, seg long, side int, at long, values array<double>")


def segment_sums(batch: pa.RecordBatch, fs: float) -> Iterator[pa.RecordBatch]:
    """(series..., segs, total): number and summed densities of each series' whole segments in a batch of (series..., values).

    Segments of one length and mode are one matrix, whatever series they are of: a batch has many series with few segments each.
    """
    keys = batch.select(list(SERIES))
    frame = keys.to_pandas()
    own = frame.groupby(list(SERIES), sort=False).ngroup().to_numpy()
    size, mode = frame["size"].to_numpy(), frame["mode"].to_numpy()
    lists = batch.column("values")
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    length = np.diff(at)
    for n, kind, long in np.unique(np.stack([size, mode, length]), axis=1).T.tolist():
        rows = np.flatnonzero((size == n) & (mode == kind) & (length == long))
        rows = rows[np.argsort(own[rows], kind="stable")]
        left, right = (flat[(at[rows] + side * (long // 2))[:, None] + np.arange(min(n, long // 2))] for side in (0, 1))
        if kind == MIX:
            left, right = np.nan_to_num(left, nan=0.0), np.nan_to_num(right, nan=0.0)
        x = left if kind == LEFT else right if kind == RIGHT else (left + right) / 2
        whole = ~np.isnan(x).any(axis=1)
        spec = densities(np.where(whole[:, None], x, 0.0), fs) * whole[:, None]
        first = np.flatnonzero(np.diff(own[rows], prepend=-1))
        segs, total = np.add.reduceat(whole.astype(np.int64), first), np.add.reduceat(spec, first, axis=0)
        values = pa.array(total.ravel(), mask=np.repeat(segs == 0, total.shape[1]))
        totals = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * total.shape[1], pa.int32()), values)
        yield pa.RecordBatch.from_arrays([*keys.take(pa.array(rows[first])).columns, pa.array(segs), totals], [*SERIES, "segs", "total"])


def spectra(df: DataFrame, pieces: DataFrame, fs: float, chunk_s: float, seg_s: float, stage_min_s: float, context_min_s: float) -> DataFrame:
    """(session, context?, stage, k, freq, psd) of all stages, the night and the REM contexts.

    Channels of a stage are paired by their position, the longer one is cut; in a context NULL counts as 0 if both
    channels have values, else segments with a NULL are left out.
    """
    starts = _starts(pieces)
    each = [(False, s, k, F.col(f"_b_{s}_{c}"), F.least(f"_n_{s}_l", f"_n_{s}_r"), stage_min_s) for s in (*STAGES, ALL) for k, c in enumerate("lr")]
    each += [(True, s, k, F.col(f"_b_{s}"), F.col(f"_n_{s}"), context_min_s) for s in CONTEXTS for k in (0, 1)]
    items = F.array(*[F.struct(F.lit(c).alias("context"), F.lit(s).alias("stage"), F.lit(k).alias("side"), b.alias("start"), n.alias("n"), F.lit(m * fs).alias("least")) for c, s, k, b, n, m in each])
    left, right = F.col(f"_n_{ALL}_l") > 0, F.col(f"_n_{ALL}_r") > 0
    mode = F.when(left & right, MIX).when(left, LEFT).when(right, RIGHT)
    spots = starts.select(KEY, CHUNK, mode.alias("_mode"), F.explode(items).alias("_i")).select(KEY, CHUNK, "_mode", "_i.*").filter("n >= least")
    spots = spots.withColumns({"size": F.least(F.lit(int(seg_s * fs)).cast("long"), F.col("n")), "mode": F.when(F.col("context"), F.col("_mode")).otherwise(PAIR)}).filter("mode IS NOT NULL")
    by = [KEY, CHUNK, "context", "stage", "side"]
    series = chunk_series(df, chunk_s).join(spots, by).select(*by, "values", "start", "n", "size", "mode")
    group = list(SERIES)
    whole = fragments(series).groupBy(*group, "seg").agg(F.array_sort(F.collect_list(F.struct("side", "at", "values"))).alias("_v"))
    whole = whole.select(*group, F.flatten(F.transform("_v", lambda x: x["values"])).alias("values"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from segment_sums(batch, fs)

    sums = whole.mapInArrow(add_up, f"{KEY} string, context boolean, stage string, size long, mode int, segs long, total array<double>")
    spec = sums.select(*group, "segs", F.posexplode("total").alias("k", "_p")).groupBy(*group, "k").agg(over(F.sum("_p"), F.sum("segs")).alias("psd"))
    return spec.select(KEY, "context", "stage", "k", (F.col("k") * fs / F.col("size")).alias("freq"), "psd")


def night_features(
    merged: DataFrame, fs: float = 250.0, chunk_s: float = runs.CHUNK_S, sub_s: float = 4.0, long_s: float = 30.0, chunk_bins: int = 4096,
    seg_s: float = 4.0, stage_min_s: float = 10.0, context_min_s: float = 2.0,
    stage_bands: eeg.Bands = STAGE_BANDS, context_bands: eeg.Bands = CONTEXT_BANDS, parallelism: int = 4,
) -> DataFrame:
    """One row per session with all 141 features and the wake after sleep onset.

    ``merged`` is read three times. What several features need is written once in the shared folder, and so is each
    group of features, one row per session: the driver never plans all of them as one query.
    """
    require(merged, [*eog.REQUIRED, *PROB_COLS, "EpochType", "em_event_id", "event_Peak", "EEG_LOC", "EEG_ROC"])
    pieces = cut(condense(merged, chunk_s, sub_s))
    rem = cut(merged.filter(F.col("stage") == "REM").select(KEY, "stage", "LOC", "ROC"))
    psd = cut(spectra(merged, pieces, fs, chunk_s, seg_s, stage_min_s, context_min_s))
    parts = [
        eog.rem_epoch_duration(pieces, fs, chunk_s), eog.rem_event_features(pieces, fs, chunk_s), eog.em_classification(pieces, fs),
        eog.em_stage_counts(pieces), eog.phasic_tonic(pieces, sub_s), eog.eog_amplitude(rem), probabilities(pieces, fs, chunk_s),
        eeg.stage_columns(psd.filter("NOT context"), stage_bands), bout.bout_features(pieces, fs, sub_s, chunk_bins=chunk_bins),
        eeg.context_columns(psd.filter("context").withColumn("context", F.col("stage")), context_bands), bout.bout_structure(pieces, fs, sub_s, long_s, chunk_bins),
        extra.em_morphology(pieces), extra.sleep_architecture(pieces, chunk_s), extra.waso(pieces, fs),
    ]
    # Most of a group's steps are shorter than their planning, so a few groups are written at a time.
    with ThreadPoolExecutor(parallelism) as pool:
        first, *rest = pool.map(cut, [eog.stage_distribution(pieces, fs, chunk_s), *parts])
    return reduce(lambda out, p: out.join(p, KEY, "left"), rest, first)
