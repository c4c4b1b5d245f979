"""Alignment joins on the night tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.fixtures import CHUNK_S, DAY, EPOCH_S, FS, SQL, SUB_S, _sql_peak, with_views
from sleepsignal.catalog.registry import query
from sleepsignal.operators import align, clean, events, runs
from sleepsignal.schemas import KEY, T

MERGED_COLS = [
    "session_id", "time_sec", "LOC", "ROC", "epoch_start", "stage", "prob_w", "prob_n1", "prob_n2", "prob_n3", "prob_rem",
    "is_rem_event", "event_Start", "event_event_id", "event_Peak", "event_End", "event_Duration", "event_LOCAbsValPeak",
    "event_ROCAbsValPeak", "event_is_peak", "is_em_event", "em_Start", "em_event_id", "em_Peak", "em_End", "em_Duration",
    "em_MeanAbsValPeak", "em_is_peak", "EM_Type", "EpochType", "EEG_LOC", "EEG_ROC",
]


@query("merged_timeline", with_views("merged", body=f"SELECT {', '.join(MERGED_COLS)} FROM merged"))
def merged_timeline(spark, sf):
    return fx.merged(spark, sf).select(*MERGED_COLS)


@query("asof_backward", with_views("night", "staging", body="""
SELECT n.session_id, n.time_sec, s.epoch_start, s.stage, s.prob_rem
FROM night n ASOF LEFT JOIN staging s ON n.session_id = s.session_id AND n.time_sec >= s.epoch_start"""))
def asof_backward(spark, sf):
    return align.asof_backward(fx.eog(spark, sf).select(KEY, T), fx.staging(spark, sf), "epoch_start", ["stage", "prob_rem"], CHUNK_S)


@query("asof_interval", with_views("night", "rem_events", body="""
SELECT n.session_id, n.time_sec, coalesce(n.time_sec <= r."End", false) AS is_rem_event,
  CASE WHEN n.time_sec <= r."End" THEN r.Start END AS event_Start, CASE WHEN n.time_sec <= r."End" THEN r.event_id END AS event_event_id,
  CASE WHEN n.time_sec <= r."End" THEN r."End" END AS "event_End", CASE WHEN n.time_sec <= r."End" THEN r.Duration END AS event_Duration
FROM night n ASOF LEFT JOIN rem_events r ON n.session_id = r.session_id AND n.time_sec >= r.Start"""))
def asof_interval(spark, sf):
    return align.asof_interval(
        fx.eog(spark, sf).select(KEY, T), fx.rem_events(spark, sf), "event_", "is_rem_event", ["End", "Duration"], CHUNK_S
    )


@query("nearest_sample_flag", with_views("night", "rem_events", body=f"""
SELECT n.session_id, n.time_sec, (n.session_id, n.time_sec) IN (SELECT (session_id, time_sec) FROM ({_sql_peak('rem_events')})) AS is_peak
FROM night n"""))
def nearest_sample_flag(spark, sf):
    return align.nearest_sample_flag(fx.eog(spark, sf).select(KEY, T), fx.rem_events(spark, sf), "is_peak", CHUNK_S)


@query("interval_label", with_views("night", "subepochs", body="""
SELECT n.session_id, n.time_sec, max(u.EpochType) AS EpochType
FROM night n LEFT JOIN subepochs u ON n.session_id = u.session_id AND n.time_sec >= u.SubEpochStart AND n.time_sec < u.SubEpochEnd
GROUP BY 1, 2"""))
def interval_label(spark, sf):
    return align.interval_label(
        fx.eog(spark, sf).select(KEY, T), fx.subepochs(spark, sf), "SubEpochStart", "SubEpochEnd", "EpochType", CHUNK_S
    )


@query("interval_label_overlapping", with_views("night", "rem_events", body="""
SELECT n.session_id, n.time_sec, arg_max(r.Stage, r.event_id) AS EpochType
FROM night n LEFT JOIN rem_events r ON n.session_id = r.session_id AND n.time_sec >= r.Start AND n.time_sec < r."End"
GROUP BY 1, 2"""))
def interval_label_overlapping(spark, sf):
    """Events as spans: many overlap, some cover whole chunks; the last listed event gives the label."""
    return align.interval_label(
        fx.eog(spark, sf).select(KEY, T), fx.rem_events(spark, sf).withColumnRenamed("Stage", "EpochType"), "Start", "End", "EpochType", DAY / 4, "event_id"
    )


@query("asof_nearest", with_views("night", "eeg", body="""
SELECT n.session_id, n.time_sec,
  CASE WHEN a.time_sec IS NULL OR n.time_sec - b.time_sec <= a.time_sec - n.time_sec THEN b.EEG_LOC ELSE a.EEG_LOC END AS EEG_LOC,
  CASE WHEN a.time_sec IS NULL OR n.time_sec - b.time_sec <= a.time_sec - n.time_sec THEN b.EEG_ROC ELSE a.EEG_ROC END AS EEG_ROC
FROM night n ASOF LEFT JOIN eeg b ON n.session_id = b.session_id AND n.time_sec >= b.time_sec
ASOF LEFT JOIN eeg a ON n.session_id = a.session_id AND n.time_sec <= a.time_sec"""))
def asof_nearest(spark, sf):
    return align.asof_nearest(fx.eog(spark, sf).select(KEY, T), fx.eeg(spark, sf), T, ["EEG_LOC", "EEG_ROC"], CHUNK_S)


@query("positional_concat", with_views("night", "indexed", "staging", body="""
SELECT i.session_id, i.sample_idx, i.LOC, g.stage FROM indexed i JOIN (
  SELECT n.session_id, row_number() OVER (PARTITION BY n.session_id ORDER BY n.time_sec) - 1 AS sample_idx, s.stage
  FROM night n ASOF LEFT JOIN staging s ON n.session_id = s.session_id AND n.time_sec >= s.epoch_start) g
USING (session_id, sample_idx)"""))
def positional_concat(spark, sf):
    left = fx.indexed(spark, sf).select(KEY, "sample_idx", T, "LOC")
    up = align.asof_backward(left.select(KEY, "sample_idx", T), fx.staging(spark, sf), "epoch_start", ["stage"], CHUNK_S)
    return left.select(KEY, "sample_idx", "LOC").join(up.select(KEY, "sample_idx", "stage"), [KEY, "sample_idx"])


@query("event_range_mask", with_views("indexed", "rem_events", body="""
SELECT i.session_id, i.sample_idx, CASE WHEN count(r.event_id) = 0 THEN any_value(i.raw) END AS LOC
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_sec) - 1 AS sample_idx, LOC AS raw FROM night) i
LEFT JOIN (SELECT *, greatest(0, floor(Start * 0.00001)) AS lo, ceil("End" * 0.00001) AS hi FROM rem_events
           WHERE LOCAbsValPeak > 100 OR ROCAbsValPeak > 100) r
  ON r.session_id = i.session_id AND i.sample_idx >= r.lo AND i.sample_idx < r.hi
GROUP BY 1, 2"""))
def event_range_mask(spark, sf):
    n = fx.indexed(spark, sf).select(KEY, "sample_idx").join(
        runs.with_time_chunk(fx.night(spark, sf), T, CHUNK_S).transform(
            lambda d: fx.row_index(d, [KEY], [T], "sample_idx")).select(KEY, "sample_idx", "LOC"), [KEY, "sample_idx"])
    return align.mask_event_ranges(n, fx.rem_events(spark, sf), "sample_idx", 0.00001, 100.0, ["LOC"], 16)


@query("subepoch_em_sum", with_views("subepochs", body="SELECT session_id, SubEpochStart, SubEpochEnd, EpochIdx, EpochType FROM subepochs"))
def subepoch_em_sum(spark, sf):
    return fx.subepochs(spark, sf)


TRANSITIONS = """
tr AS (SELECT session_id, time_sec, stage AS from_stage, nxt AS to_stage FROM
  (SELECT *, lead(stage) OVER (PARTITION BY session_id ORDER BY time_sec) AS nxt FROM night) WHERE nxt IS NOT NULL AND stage <> nxt)"""


@query("anchor_window", with_views("night", body=f"""
SELECT n.session_id, n.time_sec, a.anchor_t, n.LOC, round(n.time_sec - a.anchor_t, 6) AS rel_t FROM night n JOIN
 (SELECT session_id, time_sec AS anchor_t FROM (SELECT *, lag(stage) OVER (PARTITION BY session_id ORDER BY time_sec) AS p FROM night)
  WHERE stage = 'REM' AND p IS DISTINCT FROM 'REM') a
ON n.session_id = a.session_id AND n.time_sec >= a.anchor_t AND n.time_sec < a.anchor_t + {DAY}"""))
def anchor_window(spark, sf):
    n = fx.night(spark, sf).select(KEY, T, "stage", "LOC")
    out = runs.crop_windows(n.select(KEY, T, "LOC"), runs.stage_anchors(n, "REM", CHUNK_S), 0.0, DAY)
    return out.withColumn("rel_t", F.round("rel_t", 6))


@query("transition_window", with_views("night", body=f"""
, {TRANSITIONS}
SELECT n.session_id, n.time_sec, a.time_sec AS anchor_t, a.from_stage, a.to_stage, n.stage, round(n.time_sec - a.time_sec, 6) AS rel_t
FROM night n JOIN tr a ON n.session_id = a.session_id AND a.to_stage = 'REM'
 AND n.time_sec >= a.time_sec - {DAY} AND n.time_sec < a.time_sec + {DAY}"""))
def transition_window(spark, sf):
    n = fx.night(spark, sf).select(KEY, T, "stage")
    tr = runs.stage_transitions(n, to_stage="REM", chunk_s=CHUNK_S).withColumnRenamed(T, "anchor_t")
    return runs.crop_windows(n, tr, -DAY, DAY).withColumn("rel_t", F.round("rel_t", 6))


