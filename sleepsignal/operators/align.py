"""Time alignment of samples with epochs, events, sub-epochs and other signals.

All feeds are unioned with the samples and looked up by running ``last`` / ``next``
columns, so any number of feeds costs one shuffle by (session, time chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators.spans import disjoint_spans
from sleepsignal.plans.chunked import CHUNK, Run, running, with_time_chunk
from sleepsignal.schemas import KEY, T, require

CHUNK_S = 3600.0


@dataclass(frozen=True)
class Feed:
    """Rows to look up from each sample: ``{name}_back`` and / or ``{name}_ahead``.

    The result is a struct ``(at, payload...)``, or the plain time when there is no payload.
    """

    name: str
    df: DataFrame
    at: str
    payload: Sequence[str] = field(default_factory=tuple)
    order: str | None = None
    look: str = "back"


def align(samples: DataFrame, feeds: Sequence[Feed], chunk_s: float = CHUNK_S, neighbours: bool = False) -> DataFrame:
    """Samples plus the row found per feed and direction.

    At an equal time a feed row counts as both behind and ahead of the sample.  With
    ``neighbours`` the times of the adjacent samples are added as ``_prev_t``, ``_next_t``.
    """
    u = samples.select(
        F.col(KEY), F.col(T).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_ord"),
        F.struct(*samples.columns).alias("_row"),
    )
    for f in feeds:
        require(f.df, [KEY, f.at, *f.payload])
        tie = F.lit(0) if f.order is None else F.col(f.order)
        body = F.struct(F.col(f.at).alias("at"), *[F.col(c) for c in f.payload]) if f.payload else F.col(f.at)
        u = u.unionByName(
            f.df.filter(F.col(f.at).isNotNull()).select(
                KEY, F.col(f.at).alias("_t"), F.lit(0).alias("_kind"), tie.cast("long").alias("_ord"), body.alias(f.name)
            ),
            allowMissingColumns=True,
        )
    runs = []
    for f in feeds:
        there = {"where": f"{f.name} IS NOT NULL", "monotone": not f.payload}
        if f.look in ("back", "both"):
            runs.append(Run(f"{f.name}_back", F.col(f.name), "last", **there))
        if f.look in ("ahead", "both"):
            runs.append(Run(f"{f.name}_ahead", F.col(f.name), "next", **there))
    if neighbours:
        here = F.when(F.col("_kind") == 1, F.col("_t"))
        runs += [Run("_prev_t", here, "last_before", monotone=True), Run("_next_t", here, "next_after", monotone=True)]
    out = running(
        with_time_chunk(u, "_t", chunk_s),
        [KEY],
        ["_t", "_kind", "_ord"],
        runs,
        order_ahead=[F.desc("_t"), F.asc("_kind"), F.desc("_ord")],
    )
    return out.filter("_kind = 1").select("_row.*", *[r.name for r in runs])


def spread(prefix: str, struct: str, cols: Sequence[str], when: Column | None = None) -> list[Column]:
    """Struct fields as flat columns, NULL where ``when`` does not hold."""
    body = F.col(struct)
    return [
        (body.getField(c) if when is None else F.when(when, body.getField(c))).alias(f"{prefix}{c}") for c in cols
    ]


def asof_backward(samples: DataFrame, epochs: DataFrame, at: str, payload: Sequence[str], chunk_s: float = CHUNK_S) -> DataFrame:
    """Each sample gets the latest row with ``at`` <= t; NULL before the first one."""
    a = align(samples, [Feed("_f", epochs, at, payload)], chunk_s)
    return a.select(*samples.columns, F.col("_f_back.at").alias(at), *spread("", "_f_back", payload))


def asof_interval(
    samples: DataFrame, events: DataFrame, prefix: str, flag: str, payload: Sequence[str], chunk_s: float = CHUNK_S
) -> DataFrame:
    """The latest started event, kept only while t <= End (both ends closed)."""
    cols = [c for c in payload if c not in ("Start", "event_id")]
    a = align(samples, [Feed("_f", events, "Start", ["End", "event_id", *[c for c in cols if c != "End"]], "event_id")], chunk_s)
    inside = F.col(T) <= F.col("_f_back.End")
    return a.select(
        *samples.columns,
        F.coalesce(inside, F.lit(False)).alias(flag),
        F.when(inside, F.col("_f_back.at")).alias(f"{prefix}Start"),
        *spread(prefix, "_f_back", ["event_id", *cols], inside),
    )


def _closest(back: Column, ahead: Column) -> tuple[Column, Column]:
    """(peak behind is nearest here, peak ahead is nearest here), first sample on ties."""
    t, prev, nxt = F.col(T), F.col("_prev_t"), F.col("_next_t")
    behind = back.isNotNull() & (prev.isNull() | ((back > prev) & (t - back < back - prev)))
    before = ahead.isNotNull() & (nxt.isNull() | ((ahead < nxt) & (ahead - t <= nxt - ahead)))
    return behind, before


def is_nearest(back: Column, ahead: Column) -> Column:
    behind, before = _closest(back, ahead)
    return F.coalesce(behind, F.lit(False)) | F.coalesce(before, F.lit(False))


def nearest_sample_flag(samples: DataFrame, events: DataFrame, name: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """True on the sample nearest to an event peak."""
    a = align(samples, [Feed("_p", events, "Peak", look="both")], chunk_s, neighbours=True)
    return a.select(*samples.columns, is_nearest(F.col("_p_back"), F.col("_p_ahead")).alias(name))


def interval_label(
    samples: DataFrame, spans: DataFrame, start: str, end: str, label: str, chunk_s: float = CHUNK_S, order: str | None = None
) -> DataFrame:
    """Label of the span with start <= t < end; where spans overlap, of the one listed last (see ``disjoint_spans``)."""
    flat = disjoint_spans(spans, start, end, label, order, chunk_s)
    a = align(samples, [Feed("_f", flat, start, [end, label])], chunk_s)
    return a.select(*samples.columns, *spread("", "_f_back", [label], F.col(T) < F.col("_f_back").getField(end)))


def asof_nearest(samples: DataFrame, other: DataFrame, at: str, payload: Sequence[str], chunk_s: float = CHUNK_S) -> DataFrame:
    """The nearest row by time, earlier one on ties."""
    a = align(samples, [Feed("_f", other, at, payload, look="both")], chunk_s)
    return a.select(*samples.columns, *nearest("_f", payload))


def nearest(name: str, payload: Sequence[str]) -> list[Column]:
    back, ahead = F.col(f"{name}_back"), F.col(f"{name}_ahead")
    t = F.col(T)
    use_back = ahead.isNull() | (t - back.getField("at") <= ahead.getField("at") - t)
    return [F.when(use_back, back.getField(c)).otherwise(ahead.getField(c)).alias(c) for c in payload]


def merged_timeline(
    eog: DataFrame,
    staging: DataFrame,
    rem_events: DataFrame,
    em_events: DataFrame,
    subepochs: DataFrame,
    eeg: DataFrame,
    chunk_s: float = CHUNK_S,
    order: str | None = None,
) -> DataFrame:
    """Every input on the sample timeline: one union, one shuffle by (session, chunk).

    Sub-epochs may overlap: the one listed last, by the column ``order``, gives the label.
    """
    require(eog, [KEY, T])
    require(rem_events, ["Start", "End"])
    require(em_events, ["Start", "End", "EM_Type"])
    require(subepochs, ["SubEpochStart", "SubEpochEnd", "EpochType"])
    require(eeg, ["EEG_LOC", "EEG_ROC"])
    stage_cols = [c for c in staging.columns if c not in (KEY, "epoch_start")]
    rem_cols = [c for c in rem_events.columns if c not in (KEY, "Start")]
    em_cols = [c for c in em_events.columns if c not in (KEY, "Start")]
    a = align(
        eog,
        [
            Feed("stg", staging, "epoch_start", stage_cols),
            Feed("rem", rem_events, "Start", rem_cols, "event_id"),
            Feed("em", em_events, "Start", em_cols, "event_id"),
            Feed("sub", disjoint_spans(subepochs, "SubEpochStart", "SubEpochEnd", "EpochType", order, chunk_s), "SubEpochStart", ["SubEpochEnd", "EpochType"]),
            Feed("eeg", eeg, T, ["EEG_LOC", "EEG_ROC"], look="both"),
            Feed("rpk", rem_events, "Peak", look="both"),
            Feed("epk", em_events, "Peak", look="both"),
        ],
        chunk_s,
        neighbours=True,
    )
    in_rem = F.col(T) <= F.col("rem_back.End")
    in_em = F.col(T) <= F.col("em_back.End")
    return a.select(
        *eog.columns,
        F.col("stg_back.at").alias("epoch_start"),
        *spread("", "stg_back", stage_cols),
        F.coalesce(in_rem, F.lit(False)).alias("is_rem_event"),
        F.when(in_rem, F.col("rem_back.at")).alias("event_Start"),
        *spread("event_", "rem_back", rem_cols, in_rem),
        is_nearest(F.col("rpk_back"), F.col("rpk_ahead")).alias("event_is_peak"),
        F.coalesce(in_em, F.lit(False)).alias("is_em_event"),
        F.when(in_em, F.col("em_back.at")).alias("em_Start"),
        *spread("em_", "em_back", [c for c in em_cols if c != "EM_Type"], in_em),
        is_nearest(F.col("epk_back"), F.col("epk_ahead")).alias("em_is_peak"),
        F.when(in_em, F.col("em_back.EM_Type")).alias("EM_Type"),
        *spread("", "sub_back", ["EpochType"], F.col(T) < F.col("sub_back.SubEpochEnd")),
        *nearest("eeg", ["EEG_LOC", "EEG_ROC"]),
    )


def mask_event_ranges(
    samples: DataFrame, events: DataFrame, idx: str, fs: float, limit: float = 300.0,
    cols: Sequence[str] = ("LOC", "ROC"), chunk_rows: int = 900_000,
) -> DataFrame:
    """NULL out samples idx in [floor(Start*fs), ceil(End*fs)) of events above ``limit``.

    Coverage is a running count of opened minus closed ranges, so overlapping
    events need no range join.
    """
    bad = events.filter((F.col("LOCAbsValPeak") > limit) | (F.col("ROCAbsValPeak") > limit))
    lo = F.greatest(F.lit(0), F.floor(F.col("Start") * fs)).cast("long")
    hi = F.ceil(F.col("End") * fs).cast("long")
    edges = bad.select(KEY, F.explode(F.array(
        F.struct(lo.alias("_i"), F.lit(1).cast("long").alias("_open")),
        F.struct(hi.alias("_i"), F.lit(-1).cast("long").alias("_open")),
    )).alias("_e")).select(KEY, "_e.*").groupBy(KEY, "_i").agg(F.sum("_open").alias("_open"))
    u = samples.select(KEY, F.col(idx).cast("long").alias("_i"), F.lit(1).alias("_kind"),
                       F.struct(*samples.columns).alias("_row"))
    u = u.unionByName(edges.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    u = with_time_chunk(u, "_i", chunk_rows)
    out = running(u, [KEY], ["_i", "_kind"], [Run("_cover", F.col("_open"), "sum")]).filter("_kind = 1")
    clean = F.col("_cover") <= 0
    return out.select(*[
        F.when(clean, F.col(f"_row.{c}")).alias(c) if c in cols else F.col(f"_row.{c}") for c in samples.columns
    ])
