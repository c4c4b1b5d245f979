"""Runs, bouts, ranks and other sequence operators on the night tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.fixtures import CHUNK_S, DENSE_FS, EPOCH_S, SUB_S, with_views
from sleepsignal.catalog.joins import TRANSITIONS
from sleepsignal.catalog.registry import query
from sleepsignal.operators import events, runs
from sleepsignal.plans.chunked import join_per_key, with_time_chunk
from sleepsignal.schemas import KEY, T

LABELLED = """
lab AS (SELECT *, lag(stage) OVER w AS prev, lead(stage) OVER w AS nxt, row_number() OVER w AS rn FROM night
        WINDOW w AS (PARTITION BY session_id ORDER BY time_sec)),
runs AS (SELECT *, sum(CASE WHEN rn > 1 AND stage IS DISTINCT FROM prev THEN 1 ELSE 0 END)
         OVER (PARTITION BY session_id ORDER BY time_sec) + 1 AS run_id FROM lab)"""

# Sub-epoch series on the merged timeline, with its runs.
SERIES = f"""
ser AS (SELECT session_id, CAST(floor(time_sec / {SUB_S}) AS BIGINT) AS bin, arg_min(EpochType, time_sec) AS EpochType
        FROM merged WHERE stage = 'REM' AND EpochType IS NOT NULL GROUP BY 1, 2),
sruns AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> EpochType THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY bin) AS run_id
          FROM (SELECT *, lag(EpochType) OVER (PARTITION BY session_id ORDER BY bin) AS p FROM ser)),
bouts AS (SELECT session_id, run_id, EpochType, count(*) AS length FROM sruns GROUP BY 1, 2, 3)"""


def night(spark, sf):
    return fx.night(spark, sf).select(KEY, T, "stage", "LOC")


@query("stage_runs", with_views("night", body=f", {LABELLED} SELECT session_id, time_sec, stage, CAST(run_id AS BIGINT) AS run_id FROM runs"))
def stage_runs(spark, sf):
    return runs.stage_runs(night(spark, sf), chunk_s=CHUNK_S).select(KEY, T, "stage", "run_id")


@query("stage_spans", with_views("night", body=f""", {LABELLED}
SELECT session_id, CAST(run_id AS BIGINT) AS run_id, min(time_sec) AS t_start, max(time_sec) AS t_end, any_value(stage) AS stage, count(*) AS n
FROM runs GROUP BY 1, 2"""))
def stage_spans(spark, sf):
    return runs.spans(night(spark, sf), F.col("stage"), CHUNK_S)


@query("epochtype_spans", with_views("merged", body="""
, lab AS (SELECT session_id, time_sec, coalesce(EpochType, 'None') AS e,
  lag(coalesce(EpochType, 'None')) OVER (PARTITION BY session_id ORDER BY time_sec) AS p FROM merged),
r AS (SELECT *, sum(CASE WHEN p <> e THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY time_sec) + 1 AS run_id FROM lab)
SELECT session_id, CAST(run_id AS BIGINT) AS run_id, min(time_sec) AS t_start, max(time_sec) AS t_end, any_value(e) AS EpochType, count(*) AS n
FROM r GROUP BY 1, 2"""))
def epochtype_spans(spark, sf):
    return runs.epochtype_spans(fx.merged_table(spark, sf).select(KEY, T, "EpochType"), CHUNK_S)


@query("mask_runs", with_views("indexed", body="""
, m AS (SELECT session_id, sample_idx, coalesce(abs(LOC) > 40, false) AS m FROM indexed),
g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id ORDER BY sample_idx) AS grp FROM m WHERE m)
SELECT session_id, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx FROM g GROUP BY session_id, grp"""))
def mask_runs(spark, sf):
    return runs.mask_runs(fx.indexed(spark, sf).select(KEY, "sample_idx", "LOC"), F.abs("LOC") > 40, "sample_idx", 16)


@query("stage_transitions", with_views("night", body=f", {TRANSITIONS} SELECT * FROM tr"))
def stage_transitions(spark, sf):
    return runs.stage_transitions(night(spark, sf), chunk_s=CHUNK_S)


@query("rem_exits", with_views("night", body=f""", {LABELLED}
SELECT session_id, count(*) FILTER (WHERE prev = 'REM' AND stage IS DISTINCT FROM 'REM') AS n_exits,
  count(*) FILTER (WHERE prev = 'REM' AND stage = 'W') AS n_to_wake FROM lab GROUP BY 1"""))
def rem_exits(spark, sf):
    return runs.rem_exits(night(spark, sf), CHUNK_S)


@query("first_n_epochs", with_views("night", body=f""", {TRANSITIONS}
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_sec) AS rn FROM tr) WHERE rn <= 5"""))
def first_n_epochs(spark, sf):
    return runs.first_n(runs.stage_transitions(night(spark, sf), chunk_s=CHUNK_S), 5).drop("rn")


@query("first_per_key", with_views("merged", body="""
SELECT session_id, event_Peak, arg_min(event_Duration, time_sec) AS event_Duration, arg_min(stage, time_sec) AS stage
FROM (SELECT * FROM merged) GROUP BY 1, 2""".replace("arg_min(event_Duration", "arg_min_null(event_Duration").replace("arg_min(stage", "arg_min_null(stage")))
def first_per_key(spark, sf):
    return runs.first_per_key(fx.merged_table(spark, sf), "event_Peak", ["event_Duration", "stage"])


@query("subepoch_dedupe", with_views("merged", body=f", {SERIES} SELECT * FROM ser"))
def subepoch_dedupe(spark, sf):
    return runs.subepoch_series(fx.merged_table(spark, sf), SUB_S)


@query("bouts", with_views("merged", body=f", {SERIES} SELECT session_id, CAST(run_id AS BIGINT) AS run_id, EpochType, length FROM bouts"))
def bouts(spark, sf):
    return runs.bouts(runs.subepoch_series(fx.merged_table(spark, sf), SUB_S), chunk_bins=32)


@query("label_changes", with_views("merged", body=f", {SERIES} SELECT session_id, CAST(max(run_id) - 1 AS BIGINT) AS n_changes FROM sruns GROUP BY 1"))
def label_changes(spark, sf):
    return runs.label_changes(runs.subepoch_series(fx.merged_table(spark, sf), SUB_S), chunk_bins=32)


DENSE = f"""
amp AS (SELECT *, abs(roc_clean - loc_clean) AS amp FROM dense),
thr AS (SELECT session_id, round(avg(q), 4) AS threshold FROM (SELECT session_id, ch, avg(q) AS q FROM (
   SELECT session_id, stage, 0 AS ch, quantile_cont(abs(LOC), 0.92) AS q FROM dense GROUP BY 1, 2
   UNION ALL SELECT session_id, stage, 1, quantile_cont(abs(ROC), 0.92) FROM dense GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT amp.*, threshold, lag(amp) OVER w AS pa, lead(amp) OVER w AS na, lag(loc_clean) OVER w AS pl, lag(roc_clean) OVER w AS pr,
         lead(loc_clean) OVER w AS nl, lead(roc_clean) OVER w AS nr, lag(stage) OVER w AS ps FROM amp JOIN thr USING (session_id)
       WINDOW w AS (PARTITION BY session_id ORDER BY sample_idx)),
mn AS (SELECT * FROM st WHERE (pa IS NULL OR na IS NULL OR sign(na - amp) > sign(amp - pa)) AND amp < threshold / 2),
cand AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id ORDER BY sample_idx) AS run FROM st WHERE amp < 600 AND amp > threshold),
cruns AS (SELECT session_id, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx FROM cand GROUP BY session_id, run),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY amp DESC, sample_idx) AS rn FROM cand) WHERE rn = 1),
ev AS (SELECT pk.session_id, pk.sample_idx AS i, pk.loc_clean AS l, pk.roc_clean AS r,
   coalesce(b.sample_idx, greatest(pk.sample_idx - 1, 0)) AS li, CASE WHEN b.sample_idx IS NOT NULL THEN b.loc_clean ELSE coalesce(pk.pl, pk.loc_clean) END AS ll,
   CASE WHEN b.sample_idx IS NOT NULL THEN b.roc_clean ELSE coalesce(pk.pr, pk.roc_clean) END AS lr,
   CASE WHEN b.sample_idx IS NOT NULL THEN b.stage ELSE coalesce(pk.ps, pk.stage) END AS Stage,
   CASE WHEN a.sample_idx IS NOT NULL THEN a.sample_idx - 1 ELSE CASE WHEN pk.na IS NULL THEN pk.sample_idx ELSE pk.sample_idx + 1 END END AS ri,
   CASE WHEN a.sample_idx IS NOT NULL THEN a.pl ELSE coalesce(pk.nl, pk.loc_clean) END AS rl,
   CASE WHEN a.sample_idx IS NOT NULL THEN a.pr ELSE coalesce(pk.nr, pk.roc_clean) END AS rr
 FROM pk ASOF LEFT JOIN mn b ON pk.session_id = b.session_id AND pk.sample_idx > b.sample_idx
 ASOF LEFT JOIN mn a ON pk.session_id = a.session_id AND pk.sample_idx < a.sample_idx)"""


def dense(spark, sf):
    return fx.dense_table(spark, sf).select(KEY, "sample_idx", T, "stage", "LOC", "ROC", "loc_clean", "roc_clean")


def threshold(d):
    """Rounded, so that both engines put samples at the threshold on the same side."""
    return events.stagewise_threshold(d).withColumn("threshold", F.round("threshold", 4))


CHUNK = 128


@query("stagewise_threshold", with_views("dense", body=f", {DENSE} SELECT session_id, threshold FROM thr"))
def stagewise_threshold(spark, sf):
    return threshold(dense(spark, sf))


@query("difference_threshold", with_views("dense", body="""
SELECT session_id, round(quantile_cont(abs(roc_clean - loc_clean), 0.92), 6) AS threshold FROM dense
WHERE abs(roc_clean - loc_clean) < 600 GROUP BY 1"""))
def difference_threshold(spark, sf):
    return events.difference_threshold(dense(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query("local_minima", with_views("dense", body=f", {DENSE} SELECT session_id, sample_idx, round(amp, 6) AS amp FROM mn"))
def local_minima(spark, sf):
    d = dense(spark, sf)
    return events.local_minima(d, threshold(d), chunk_rows=CHUNK).withColumn("amp", F.round("amp", 6))


@query("movement_runs", with_views("dense", body=f", {DENSE} SELECT session_id, start_idx, end_idx FROM cruns"))
def movement_runs(spark, sf):
    d = dense(spark, sf)
    return events.movement_runs(d, threshold(d), chunk_rows=CHUNK)


@query("peak_in_run", with_views("dense", body=f", {DENSE} SELECT session_id, sample_idx AS peak_idx, round(amp, 6) AS peak_value FROM pk"))
def peak_in_run(spark, sf):
    d = dense(spark, sf)
    s = join_per_key(with_time_chunk(d.withColumn("amp", F.abs(F.col("roc_clean") - F.col("loc_clean"))), "sample_idx", CHUNK), threshold(d), [KEY])
    r = runs.true_runs(s, events.em_candidates(F.col("threshold")), "sample_idx", CHUNK, dealt=True)
    return events.peak_in_run(r, "amp", "sample_idx", [KEY, "run_id"]).select(KEY, "peak_idx", F.round("peak_value", 6).alias("peak_value"))


@query("nearest_minimum", with_views("dense", body=f", {DENSE} SELECT session_id, i AS peak_idx, li AS left_idx, ri AS right_idx FROM ev"))
def nearest_minimum(spark, sf):
    d = dense(spark, sf)
    return events.bases(d, threshold(d), chunk_rows=CHUNK)


_SLOPES = f"""
round(abs((l - ll) / nullif((i - li) / {DENSE_FS}, 0)), 4) AS LOCAbsRiseSlope, round(abs((r - lr) / nullif((i - li) / {DENSE_FS}, 0)), 4) AS ROCAbsRiseSlope,
round(abs((rl - l) / nullif((ri - i) / {DENSE_FS}, 0)), 4) AS LOCAbsFallSlope, round(abs((rr - r) / nullif((ri - i) / {DENSE_FS}, 0)), 4) AS ROCAbsFallSlope"""


def _event_cols(df):
    return df.select(*[F.round(c, 4).alias(c) if c.endswith(("Slope", "Peak")) and c != "Peak" else F.col(c) for c in df.columns])


@query("detect_movements", with_views("dense", body=f""", {DENSE}
SELECT session_id, li / {DENSE_FS} AS Start, i / {DENSE_FS} AS Peak, ri / {DENSE_FS} AS "End", ri / {DENSE_FS} - li / {DENSE_FS} AS Duration,
  round(abs(l), 4) AS LOCAbsValPeak, round(abs(r), 4) AS ROCAbsValPeak, {_SLOPES}, Stage FROM ev"""))
def detect_movements(spark, sf):
    d = dense(spark, sf)
    return _event_cols(events.detect_movements(d, threshold(d), DENSE_FS, chunk_rows=CHUNK))


_EM = f"""
SELECT ev.session_id, i / {DENSE_FS} AS Peak, ri / {DENSE_FS} - li / {DENSE_FS} AS Duration,
  round((abs(d.LOC) + abs(d.ROC)) / 2, 4) AS MeanAbsValPeak, CASE WHEN ri / {DENSE_FS} - li / {DENSE_FS} > 0.5 THEN 'SEM' ELSE 'REM' END AS EM_Type
FROM ev JOIN dense d ON d.session_id = ev.session_id AND d.sample_idx = ev.i"""


@query("detect_em", with_views("dense", body=f", {DENSE} {_EM}"))
def detect_em(spark, sf):
    d = dense(spark, sf)
    e = events.detect_em(d, DENSE_FS, threshold=threshold(d), chunk_rows=CHUNK)
    return e.select(KEY, "Peak", "Duration", F.round("MeanAbsValPeak", 4).alias("MeanAbsValPeak"), "EM_Type")


@query("em_type", with_views("em_events", body="SELECT session_id, event_id, CASE WHEN Duration > 20000 THEN 'SEM' ELSE 'REM' END AS EM_Type FROM em_events"))
def em_type(spark, sf):
    return fx.em_events(spark, sf).select(KEY, "event_id", events.em_type(F.col("Duration"), 20000.0).alias("EM_Type"))


@query("em_mean_amplitude", with_views("dense", body=f""", {DENSE}
SELECT ev.session_id, i AS peak_idx, round((abs(d.LOC) + abs(d.ROC)) / 2, 4) AS MeanAbsValPeak FROM ev JOIN dense d
ON d.session_id = ev.session_id AND d.sample_idx = ev.i"""))
def em_mean_amplitude(spark, sf):
    d = dense(spark, sf)
    e = events.bases(d, threshold(d), chunk_rows=CHUNK).withColumn("Peak", F.col("peak_idx") / F.lit(DENSE_FS))
    return events.em_mean_amplitude(e, d, DENSE_FS).select(KEY, "peak_idx", F.round("MeanAbsValPeak", 4).alias("MeanAbsValPeak"))


@query("rolling_max_min", with_views("dense", body="""
, m AS (SELECT session_id, sample_idx, abs(LOC) > 200 AS m FROM dense),
d AS (SELECT *, max(m) OVER (PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS d FROM m)
SELECT session_id, sample_idx, min(d) OVER (PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS is_em FROM d"""))
def rolling_max_min(spark, sf):
    return events.rolling_mask(dense(spark, sf), F.abs("LOC") > 200, DENSE_FS, chunk_rows=CHUNK).select(KEY, "sample_idx", "is_em")


@query("hypnogram_upsample", with_views("indexed", "hypno", body="""
SELECT i.session_id, i.sample_idx, h.epoch_idx, h.stage_code FROM indexed i JOIN hypno h
ON h.session_id = i.session_id AND h.epoch_idx = CAST(floor(i.sample_idx / 4.0) AS BIGINT)"""))
def hypnogram_upsample(spark, sf):
    s = fx.indexed(spark, sf).select(KEY, "sample_idx")
    return runs.hypnogram_upsample(s, fx.hypno(spark, sf), 4.0 / EPOCH_S, EPOCH_S).select(KEY, "sample_idx", "epoch_idx", "stage_code")


TWO = """
e AS (SELECT * FROM rem_events WHERE Stage = 'REM'),
b AS (SELECT session_id, min(Start) AS t0, max(Start) AS t1 FROM e GROUP BY 1),
g AS (SELECT session_id, t0, unnest(range(CAST(ceil((t1 - t0) / 86400.0) AS BIGINT))) AS slot FROM b),
c AS (SELECT g.session_id, g.slot, g.t0 + g.slot * 86400.0 AS es, e.Start, (LOCAbsValPeak > 30 OR ROCAbsValPeak > 30) AND Duration < 40000 AS c,
        NOT (LOCAbsValPeak < 15 AND ROCAbsValPeak < 15) AS loud, e.Start - g.t0 - g.slot * 86400.0 < 43200 AS h1
      FROM g LEFT JOIN e ON e.session_id = g.session_id AND CAST(floor((e.Start - g.t0) / 86400.0) AS BIGINT) = g.slot),
w AS (SELECT session_id, slot, round(any_value(es), 4) AS EpochStart, round(any_value(es) + 86400.0, 4) AS EpochEnd,
  CASE WHEN coalesce(bool_or(c AND h1), false) AND coalesce(bool_or(c AND NOT h1), false) THEN 'Phasic'
       WHEN NOT coalesce(bool_or(loud), false) THEN 'Tonic' ELSE 'Unclassified' END AS REM_Type, count(Start) AS EM_count FROM c GROUP BY 1, 2)"""


def two_window(spark, sf):
    return events.two_window_rule(fx.rem_events(spark, sf), 86400.0, 30.0, 40000.0, 15.0)


@query("two_window_rule", with_views("rem_events", body=f", {TWO} SELECT * FROM w"))
def two_window_rule(spark, sf):
    return two_window(spark, sf)


@query("min_spacing", with_views("rem_events", body=f""", {TWO}, nx AS (SELECT a.session_id, a.slot, min(b.slot) AS nxt FROM w a JOIN w b ON b.session_id = a.session_id AND b.slot >= a.slot + 2 GROUP BY 1, 2),
k AS (SELECT session_id, min(slot) AS slot FROM w GROUP BY 1 UNION ALL SELECT k.session_id, nx.nxt FROM k JOIN nx ON nx.session_id = k.session_id AND nx.slot = k.slot)
SELECT w.* FROM w JOIN k USING (session_id, slot)""").replace("WITH ", "WITH RECURSIVE ", 1))
def min_spacing(spark, sf):
    """Two epochs is the least distance."""
    return events.min_spacing(two_window(spark, sf), 2 * 86400.0, 86400.0)


@query("onset_latency", with_views("night", body="""
SELECT session_id, round(min(time_sec) FILTER (WHERE stage = 'REM') - min(time_sec) FILTER (WHERE stage IN ('N1', 'N2', 'N3', 'REM')), 6) AS latency_s
FROM night GROUP BY 1"""))
def onset_latency(spark, sf):
    c = F.col("stage")
    return runs.onset_latency(night(spark, sf), c.isin("N1", "N2", "N3", "REM"), c == "REM", "latency_s").withColumn("latency_s", F.round("latency_s", 6))
