"""Per-night feature groups on the merged timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.fixtures import CHUNK_S, DENSE_FS, FS, SUB_S, with_views
from sleepsignal.catalog.registry import query
from sleepsignal.catalog.sequences import SERIES
from sleepsignal.operators import clean, spectral
from sleepsignal.operators.features import bout, eeg, eog, extra, stage_prob
from sleepsignal.schemas import KEY, STAGES, T

BINS = 32


def mins(n: str) -> str:
    return f"{n} / {FS}e0 / 60e0"


def ratio(a: str, b: str, d: int = 4) -> str:
    return f"round({a} / nullif(CAST({b} AS DOUBLE), 0), {d})"


LAG = "lab AS (SELECT *, lag(stage) OVER (PARTITION BY session_id ORDER BY time_sec) AS prev FROM merged)"
BASE = "base AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE stage = 'REM') AS n_rem FROM merged GROUP BY 1)"


@query("stage_distribution", with_views("merged", body=f""", {LAG}
SELECT session_id, round({mins('count(*)')}, 3) AS total_recording_min, {', '.join(
    f"round({mins(f'''count(*) FILTER (WHERE stage='{s}')''')}, 3) AS {s.lower()}_duration_min, round(count(*) FILTER (WHERE stage='{s}') / count(*), 4) AS {s.lower()}_fraction" for s in STAGES)},
  count(*) FILTER (WHERE stage = 'REM' AND prev IS DISTINCT FROM 'REM') AS n_rem_epochs FROM lab GROUP BY 1"""))
def stage_distribution(spark, sf):
    return eog.stage_distribution(fx.merged_table(spark, sf), FS, CHUNK_S)


@query("rem_epoch_duration", with_views("merged", body=f""", {LAG}, {BASE},
r AS (SELECT session_id, stage, sum(CASE WHEN stage IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY time_sec) AS run FROM lab),
d AS (SELECT session_id, {mins('count(*)')} AS d FROM r WHERE stage = 'REM' GROUP BY session_id, run)
SELECT session_id, nullif(count(d), 0) AS rem_epoch_count, round(avg(d), 3) AS rem_epoch_mean_duration_min, round(stddev_samp(d), 3) AS rem_epoch_std_duration_min,
  round(min(d), 3) AS rem_epoch_min_duration_min, round(max(d), 3) AS rem_epoch_max_duration_min FROM base LEFT JOIN d USING (session_id) GROUP BY 1"""))
def rem_epoch_duration(spark, sf):
    return eog.rem_epoch_duration(fx.merged_table(spark, sf), FS, CHUNK_S)


@query("rem_event_features", with_views("merged", body=f""", {BASE},
e AS (SELECT session_id, event_Peak, any_value(event_Duration) AS d, any_value(event_LOCAbsValPeak) AS la, any_value(event_ROCAbsValPeak) AS ra,
   any_value(event_LOCAbsRiseSlope) AS ls, any_value(event_ROCAbsRiseSlope) AS rs FROM merged WHERE stage = 'REM' AND event_Peak IS NOT NULL GROUP BY 1, 2)
SELECT session_id, count(event_Peak) AS rem_event_count, {ratio('count(event_Peak)', mins('any_value(n_rem)'))} AS rem_event_rate_per_min,
  round(avg(d), 4) AS rem_event_mean_duration_s, round(median(d), 4) AS rem_event_median_duration_s, round(avg(la), 4) AS rem_event_mean_loc_amp_uv,
  round(avg(ra), 4) AS rem_event_mean_roc_amp_uv, round(avg(ls), 4) AS rem_event_mean_loc_rise_slope, round(avg(rs), 4) AS rem_event_mean_roc_rise_slope
FROM base LEFT JOIN e USING (session_id) GROUP BY 1"""))
def rem_event_features(spark, sf):
    return eog.rem_event_features(fx.merged_table(spark, sf), FS, CHUNK_S)


@query("em_classification", with_views("merged", body=f""", {BASE},
e AS (SELECT session_id, em_event_id, any_value(EM_Type) AS k, any_value(em_Duration) AS d, any_value(em_MeanAbsValPeak) AS a
      FROM merged WHERE stage = 'REM' AND em_event_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT session_id, any_value(n_rem) AS n_rem, count(*) FILTER (WHERE k = 'SEM') AS s, count(*) FILTER (WHERE k = 'REM') AS r,
   round(avg(d) FILTER (WHERE k = 'SEM'), 4) AS sem_mean_duration_s, round(avg(d) FILTER (WHERE k = 'REM'), 4) AS rem_em_mean_duration_s,
   round(avg(a) FILTER (WHERE k = 'SEM'), 4) AS sem_mean_amp_uv, round(avg(a) FILTER (WHERE k = 'REM'), 4) AS rem_em_mean_amp_uv
   FROM base LEFT JOIN e USING (session_id) GROUP BY 1)
SELECT session_id, CASE WHEN n_rem > 0 THEN s END AS sem_count_rem_sleep, CASE WHEN n_rem > 0 THEN r END AS rem_em_count_rem_sleep,
  {ratio('s', mins('n_rem'))} AS sem_rate_per_min, {ratio('r', mins('n_rem'))} AS rem_em_rate_per_min, {ratio('s', 's + r')} AS sem_fraction,
  {ratio('r', 's + r')} AS rem_em_fraction, sem_mean_duration_s, rem_em_mean_duration_s, sem_mean_amp_uv, rem_em_mean_amp_uv FROM g"""))
def em_classification(spark, sf):
    return eog.em_classification(fx.merged_table(spark, sf), FS)


@query("em_stage_counts", with_views("merged", body=f""", {BASE},
e AS (SELECT session_id, em_event_id, arg_min(stage, time_sec) AS stage FROM merged WHERE em_event_id IS NOT NULL GROUP BY 1, 2)
SELECT session_id, {', '.join(f"count(*) FILTER (WHERE stage = '{s}') AS em_count_{n}" for s, n in (('N1', 'n1'), ('N2', 'n2'), ('N3', 'n3'), ('REM', 'rem'), ('W', 'wake')))}
FROM base LEFT JOIN e USING (session_id) GROUP BY 1"""))
def em_stage_counts(spark, sf):
    return eog.em_stage_counts(fx.merged_table(spark, sf))


@query("phasic_tonic", with_views("merged", body=f""", {SERIES}, {BASE}
SELECT session_id, count(*) FILTER (WHERE EpochType = 'Phasic') AS phasic_epoch_count, count(*) FILTER (WHERE EpochType = 'Tonic') AS tonic_epoch_count,
  {ratio("count(*) FILTER (WHERE EpochType = 'Phasic')", 'count(EpochType)')} AS phasic_fraction,
  {ratio("count(*) FILTER (WHERE EpochType = 'Tonic')", 'count(EpochType)')} AS tonic_fraction FROM base LEFT JOIN ser USING (session_id) GROUP BY 1"""))
def phasic_tonic(spark, sf):
    return eog.phasic_tonic(fx.merged_table(spark, sf), SUB_S)


@query("phasic_tonic_percentages", with_views("subepochs", body="""
SELECT session_id, count(*) AS n_subepochs, round(count(*) FILTER (WHERE EpochType = 'Phasic') * 100e0 / count(*), 2) AS phasic_pct,
  round(count(*) FILTER (WHERE EpochType = 'Tonic') * 100e0 / count(*), 2) AS tonic_pct, 0e0 AS unclassified_pct FROM subepochs GROUP BY 1"""))
def phasic_tonic_percentages(spark, sf):
    return eog.epoch_type_percentages(fx.subepochs(spark, sf))


@query("eog_amplitude", with_views("merged", body=f""", {BASE}
SELECT b.session_id, {', '.join(f"round(avg(abs({c})), 4) AS rem_{c.lower()}_mean_abs_uv, round(stddev_samp({c}), 4) AS rem_{c.lower()}_std_uv, round(quantile_cont(abs({c}), 0.95), 4) AS rem_{c.lower()}_p95_uv" for c in ('LOC', 'ROC'))}
FROM base b LEFT JOIN merged m ON b.session_id = m.session_id AND m.stage = 'REM' GROUP BY 1"""))
def eog_amplitude(spark, sf):
    return eog.eog_amplitude(fx.merged_table(spark, sf))


@query("stage_probability", with_views("merged", body=f""", {BASE}
SELECT b.session_id, {', '.join(f'round(avg(prob_{s}), 4) AS rem_mean_prob_{s}' for s in ('w', 'n1', 'n2', 'n3', 'rem'))},
  round(avg(CASE WHEN m.time_sec IS NULL THEN NULL WHEN prob_rem > 0.5 THEN 1 ELSE 0 END), 4) AS rem_certainty,
  round(avg(prob_n1 + prob_n2 + prob_n3), 4) AS rem_mean_prob_nrem,
  round(avg(CASE WHEN m.time_sec IS NULL THEN NULL WHEN prob_w > 0.2::DOUBLE THEN 1 ELSE 0 END), 4) AS rem_high_wake_prob_frac
FROM base b LEFT JOIN merged m ON b.session_id = m.session_id AND m.stage = 'REM' GROUP BY 1"""))
def stage_probability(spark, sf):
    return stage_prob.stage_probability(fx.merged_table(spark, sf))


@query("rem_stability", with_views("merged", body=f""", {LAG},
g AS (SELECT session_id, count(*) FILTER (WHERE stage = 'REM') AS r, count(*) FILTER (WHERE prev = 'REM' AND stage IS DISTINCT FROM 'REM') AS o,
  count(*) FILTER (WHERE prev = 'REM' AND stage = 'W') AS w, avg(prob_rem) FILTER (WHERE stage = 'REM') AS s,
  avg(CASE WHEN prob_rem > 0.5 THEN 1 ELSE 0 END) AS a FROM lab GROUP BY 1)
SELECT session_id, round(s, 4) AS rem_stability_index, round(o / nullif({mins('r')} / 60e0, 0), 4) AS rem_fragmentation_index,
  CASE WHEN r > 0 THEN {ratio('w', 'o')} END AS rem_w_transition_frac, CASE WHEN r > 0 THEN round(a, 4) END AS amount_of_rem FROM g"""))
def rem_stability(spark, sf):
    return stage_prob.rem_stability(fx.merged_table(spark, sf), FS, CHUNK_S)


BOUT = f"""
b AS (SELECT session_id, EpochType, length * {SUB_S}e0 AS d FROM bouts),
tr AS (SELECT session_id, CAST(max(run_id) - 1 AS BIGINT) AS n_changes FROM sruns GROUP BY 1)"""


def _bout_cols(lab: str) -> str:
    f = f"FILTER (WHERE EpochType = '{lab}')"
    p = lab.lower()
    return f"""nullif(count(*) {f}, 0) AS {p}_bout_count, round(avg(d) {f}, 4) AS {p}_bout_mean_duration_s, round(max(d) {f}, 4) AS {p}_bout_max_duration_s,
  round(min(d) {f}, 4) AS {p}_bout_min_duration_s, CASE WHEN count(*) {f} > 0 THEN round(coalesce(stddev_samp(d) {f}, 0), 4) END AS {p}_bout_std_duration_s,
  round(median(d) {f}, 4) AS {p}_bout_median_duration_s, round(nullif(count(*) {f}, 0) / ({mins('any_value(n_rem)')}), 4) AS {p}_bout_rate_per_min,
  round(sum(d) {f}, 4) AS {p}_bout_total_duration_s"""


@query("bout_features", with_views("merged", body=f""", {SERIES}, {BASE}, {BOUT}
SELECT session_id, {_bout_cols('Phasic')}, {_bout_cols('Tonic')}, any_value(n_changes) AS phasic_tonic_transitions
FROM base LEFT JOIN b USING (session_id) LEFT JOIN tr USING (session_id) GROUP BY 1"""))
def bout_features(spark, sf):
    return bout.bout_features(fx.merged_table(spark, sf), FS, SUB_S, chunk_bins=BINS)


def _struct_cols(lab: str) -> str:
    f = f"FILTER (WHERE EpochType = '{lab}')"
    p = lab.lower()
    q = ", ".join(f"round(quantile_cont(d, {v}) {f}, 4) AS {p}_bout_p{n}_s" for n, v in ((25, 0.25), (75, 0.75), (90, 0.9)))
    return f"""{q}, round(max(d) {f}, 4) AS {p}_longest_run_s, CASE WHEN count(*) {f} > 0 THEN
  round(coalesce(sum(d) FILTER (WHERE EpochType = '{lab}' AND d > 30000), 0) / ({mins('any_value(n_rem)')} * 60), 4) END AS {p}_long_bout_fraction"""


@query("bout_structure", with_views("merged", body=f""", {SERIES}, {BASE}, {BOUT},
lat AS (SELECT session_id, round(min(time_sec) FILTER (WHERE EpochType = 'Phasic') - min(time_sec), 4) AS phasic_first_latency_s FROM merged WHERE stage = 'REM' GROUP BY 1)
SELECT session_id, {ratio('any_value(n_changes)', mins('any_value(n_rem)'))} AS pt_transitions_per_min, {_struct_cols('Phasic')}, {_struct_cols('Tonic')},
  any_value(phasic_first_latency_s) AS phasic_first_latency_s
FROM base LEFT JOIN b USING (session_id) LEFT JOIN tr USING (session_id) LEFT JOIN lat USING (session_id) GROUP BY 1"""))
def bout_structure(spark, sf):
    return bout.bout_structure(fx.merged_table(spark, sf), FS, SUB_S, 30000.0, chunk_bins=BINS)


@query("em_morphology", with_views("merged", body=f""", {BASE},
e AS (SELECT session_id, em_event_id, any_value(EM_Type) AS k, any_value(em_MeanAbsValPeak) AS a, any_value((em_LOCAbsRiseSlope + em_ROCAbsRiseSlope) / 2) AS r,
   any_value((em_LOCAbsFallSlope + em_ROCAbsFallSlope) / 2) AS f FROM merged WHERE is_em_event GROUP BY 1, 2)
SELECT session_id, round(avg(r), 6) AS em_mean_rise_slope, round(avg(f), 6) AS em_mean_fall_slope, round(var_samp(a), 6) AS em_amplitude_variance,
  {ratio("count(*) FILTER (WHERE k = 'SEM')", 'count(k)')} AS em_sem_fraction FROM base LEFT JOIN e USING (session_id) GROUP BY 1"""))
def em_morphology(spark, sf):
    return extra.em_morphology(fx.merged_table(spark, sf))


@query("sleep_architecture", with_views("merged", body=f""", {LAG}
SELECT session_id, round((min(time_sec) FILTER (WHERE stage = 'REM') - min(time_sec) FILTER (WHERE stage IN ('N1','N2','N3','REM'))) / 60, 4) AS rem_latency_min,
  nullif(count(*) FILTER (WHERE stage = 'REM' AND prev IS DISTINCT FROM 'REM'), 0) AS n_rem_cycles FROM lab GROUP BY 1"""))
def sleep_architecture(spark, sf):
    return extra.sleep_architecture(fx.merged_table(spark, sf), CHUNK_S)


@query("waso", with_views("merged", body=f"""
, o AS (SELECT session_id, min(time_sec) FILTER (WHERE stage IN ('N1','N2','N3','REM')) AS t0 FROM merged GROUP BY 1)
SELECT session_id, CASE WHEN any_value(t0) IS NOT NULL THEN round({mins("count(*) FILTER (WHERE stage = 'W' AND time_sec > t0)")}, 4) END AS waso_min
FROM merged JOIN o USING (session_id) GROUP BY 1"""))
def waso(spark, sf):
    return extra.waso(fx.merged_table(spark, sf), FS)


# Bands that fit a 16 Hz signal.
BANDS = {"delta": (0.5, 2.0), "theta": (2.0, 4.0), "alpha": (4.0, 6.0), "beta": (6.0, 8.0)}
CTX = {"delta": (0.5, 2.0), "theta": (2.0, 4.0), "gamma": (5.0, 8.0)}
SEG_S, MIN_S = 2.0, 4.0


def welch_sql(src: str, by: str, min_n: float) -> str:
    """Views ``psd`` (and its parts) from ``src`` with columns by..., pos, x."""
    return f"""
cnt AS (SELECT {by}, count(*) AS n, least({int(SEG_S * DENSE_FS)}, count(*)) AS sz FROM {src} GROUP BY {by} HAVING count(*) >= {min_n}),
sg AS (SELECT *, sz - sz // 2 AS step, (n - sz // 2) // (sz - sz // 2) AS segs FROM cnt),
pt AS (SELECT {src}.*, sz, step, unnest(range(greatest(0, CAST(floor((pos - sz) / step) AS BIGINT) + 1), least(pos // step, segs - 1) + 1)) AS seg
       FROM {src} JOIN sg USING ({by})),
mn AS (SELECT {by}, seg, avg(x) AS mu FROM pt GROUP BY {by}, seg),
wd AS (SELECT {by}, seg, sz, pos - seg * step AS j, (x - mu) * (0.5 - 0.5 * cos(2 * pi() * (pos - seg * step) / sz)) AS v,
         pow(0.5 - 0.5 * cos(2 * pi() * (pos - seg * step) / sz), 2) AS w2 FROM pt JOIN mn USING ({by}, seg)),
fk AS (SELECT {by}, seg, sz, k, pow(sum(v * cos(2 * pi() * k * j / sz)), 2) + pow(sum(v * sin(2 * pi() * k * j / sz)), 2) AS p, sum(w2) AS w2
       FROM wd, range({int(SEG_S * DENSE_FS)} // 2 + 1) r(k) WHERE k <= sz // 2 GROUP BY {by}, seg, sz, k),
psd AS (SELECT {by}, k, k * {DENSE_FS}e0 / sz AS freq, avg(p / ({DENSE_FS} * w2) * CASE WHEN k = 0 OR k * 2 = sz THEN 1 ELSE 2 END) AS psd FROM fk GROUP BY {by}, k, sz),
pl AS (SELECT *, lag(freq) OVER w AS pf, lag(psd) OVER w AS pp FROM psd WINDOW w AS (PARTITION BY {by} ORDER BY k))"""


def band_sql(lo: float, hi: float) -> str:
    return f"coalesce(sum((psd + pp) / 2 * (freq - pf)) FILTER (WHERE freq BETWEEN {lo} AND {hi} AND pf BETWEEN {lo} AND {hi}), 0)"


STAGE_SIG = """
gr AS (SELECT session_id, time_sec, unnest([stage, 'ALL']) AS stage, EEG_LOC, EEG_ROC FROM dense),
sl AS (SELECT session_id, stage, EEG_LOC, row_number() OVER (PARTITION BY session_id, stage ORDER BY time_sec) - 1 AS pos FROM gr WHERE EEG_LOC IS NOT NULL),
sr AS (SELECT session_id, stage, EEG_ROC, row_number() OVER (PARTITION BY session_id, stage ORDER BY time_sec) - 1 AS pos FROM gr WHERE EEG_ROC IS NOT NULL),
sig AS (SELECT session_id, stage, pos, (EEG_LOC + EEG_ROC) / 2 AS x FROM sl JOIN sr USING (session_id, stage, pos))"""


def _stage_cols() -> str:
    out = []
    for s in STAGES:
        for c in (*BANDS, "total", "theta_ratio"):
            out.append(f"max(round({c}, 6)) FILTER (WHERE stage = '{s}') AS eeg__{s.lower()}__{c}")
    return ", ".join(out)


def dense(spark, sf):
    return fx.dense_table(spark, sf)


DCHUNK = 16.0


@query("band_power_stage", with_views("dense", body=f""", {STAGE_SIG}, {welch_sql('sig', 'session_id, stage', MIN_S * DENSE_FS)},
bp AS (SELECT session_id, stage, {', '.join(f'{band_sql(*v)} AS {b}' for b, v in BANDS.items())} FROM pl GROUP BY 1, 2),
tt AS (SELECT *, delta + theta + alpha + beta AS total, CASE WHEN delta + theta + alpha + beta > 0 THEN round(theta, 6) / (delta + theta + alpha + beta) END AS theta_ratio FROM bp)
SELECT session_id, {_stage_cols()}, max(round(theta / beta, 6)) FILTER (WHERE stage = 'ALL' AND beta > 0) AS eeg__overall__theta_beta_ratio
FROM (SELECT DISTINCT session_id FROM dense) LEFT JOIN tt USING (session_id) GROUP BY 1"""))
def band_power_stage(spark, sf):
    return eeg.stage_power(dense(spark, sf), DENSE_FS, DCHUNK, BANDS, SEG_S, MIN_S)


CTX_SIG = """
cx AS (SELECT session_id, time_sec, unnest(CASE WHEN EpochType IS NULL THEN ['rem'] ELSE ['rem', lower(EpochType)] END) AS context,
  (coalesce(EEG_LOC, 0) + coalesce(EEG_ROC, 0)) / 2 AS x FROM dense WHERE stage = 'REM'),
sig AS (SELECT session_id, context, x, row_number() OVER (PARTITION BY session_id, context ORDER BY time_sec) - 1 AS pos FROM cx)"""


@query("band_power_context", with_views("dense", body=f""", {CTX_SIG}, {welch_sql('sig', 'session_id, context', 2.0 * DENSE_FS)},
bp AS (SELECT session_id, context, {', '.join(f'{band_sql(*v)} AS {b}' for b, v in CTX.items())} FROM pl GROUP BY 1, 2)
SELECT session_id, {', '.join(f"max(round({b}, 6)) FILTER (WHERE context = '{c}') AS eeg_{b}_{c}_power" for c in ('rem', 'phasic', 'tonic') for b in CTX)},
  {', '.join(f"max(round(theta / delta, 6)) FILTER (WHERE context = '{c}' AND delta > 0) AS eeg_theta_delta_ratio_{c}" for c in ('rem', 'phasic', 'tonic'))}
FROM (SELECT DISTINCT session_id FROM dense) LEFT JOIN bp USING (session_id) GROUP BY 1"""))
def band_power_context(spark, sf):
    out = eeg.context_power(dense(spark, sf), DENSE_FS, DCHUNK, CTX, SEG_S, 2.0)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_power") else F.col(c) for c in out.columns])


LONG_SIG = """
sig AS (SELECT session_id, stage, channel, x, row_number() OVER (PARTITION BY session_id, stage, channel ORDER BY time_sec) - 1 AS pos
  FROM (SELECT session_id, stage, time_sec, 'EEG_LOC' AS channel, EEG_LOC AS x FROM dense UNION ALL
        SELECT session_id, stage, time_sec, 'EEG_ROC', EEG_ROC FROM dense) WHERE x IS NOT NULL)"""


@query("psd_curve", with_views("dense", body=f""", {LONG_SIG}, {welch_sql('sig', 'session_id, stage, channel', MIN_S * DENSE_FS)}
SELECT session_id, stage, channel, CAST(k AS INTEGER) AS k, freq, round(psd, 6) AS psd FROM psd WHERE freq BETWEEN 0.5 AND 7.5"""))
def psd_curve(spark, sf):
    return spectral.psd_curve(dense(spark, sf), DENSE_FS, DCHUNK, 0.5, 7.5, MIN_S, SEG_S).withColumn("psd", F.round("psd", 6))


@query("welch_bands", with_views("dense", body=f"""
, sig AS (SELECT session_id, 'LOC' AS channel, sample_idx AS pos, LOC AS x FROM dense UNION ALL SELECT session_id, 'ROC', sample_idx, ROC FROM dense), {welch_sql('sig', 'session_id, channel', 1)}
SELECT session_id, channel, {', '.join(f'round({band_sql(*v)}, 6) AS {b}' for b, v in BANDS.items())} FROM pl GROUP BY 1, 2"""))
def welch_bands(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in ("LOC", "ROC")]))
    d = spectral.positions(dense(spark, sf).select(KEY, T, each.alias("_s")).select(KEY, T, "_s.*"), [KEY, "channel"], DCHUNK)
    p = spectral.band_power(spectral.welch(d, [KEY, "channel"], "pos", "x", DENSE_FS, SEG_S), [KEY, "channel"], BANDS, False)
    return p.select(KEY, "channel", *[F.round(b, 6).alias(b) for b in BANDS])


TAPS = spectral.fir_taps(DENSE_FS, 0.1, 4.0, 41)


@query("bandpass_filter", with_views("dense", body=f"""
, taps AS (SELECT unnest(range(41)) - 20 AS o, unnest([{', '.join(repr(float(x)) for x in TAPS)}]) AS w)
SELECT a.session_id, a.sample_idx, round(sum(w * b.LOC), 6) AS LOC_clean, round(sum(w * b.ROC), 6) AS ROC_clean
FROM dense a, taps JOIN dense b ON b.session_id = a.session_id AND b.sample_idx = a.sample_idx - o GROUP BY 1, 2"""))
def bandpass_filter(spark, sf):
    f = spectral.bandpass_filter(fx.dense(spark, sf), TAPS, ["LOC", "ROC"], chunk_rows=128)
    return f.select(KEY, "sample_idx", F.round("LOC_clean", 6).alias("LOC_clean"), F.round("ROC_clean", 6).alias("ROC_clean"))


@query("resample_down", with_views("night", body="""
SELECT session_id, CAST(floor(time_sec / 40000e0) AS BIGINT) AS sample_idx, round(avg(LOC), 6) AS LOC, round(avg(ROC), 6) AS ROC, floor(time_sec / 40000e0) * 40000e0 AS time_sec
FROM night GROUP BY session_id, floor(time_sec / 40000e0)"""))
def resample_down(spark, sf):
    d = spectral.resample_down(fx.night(spark, sf), 1 / 40000.0, ["LOC", "ROC"])
    return d.select(KEY, "sample_idx", F.round("LOC", 6).alias("LOC"), F.round("ROC", 6).alias("ROC"), (F.col("sample_idx") * 40000.0).alias(T))


@query("resample_up", with_views("night", body="""
, b AS (SELECT session_id, CAST(ceil(min(time_sec) / 8192e0) AS BIGINT) AS lo, CAST(floor(max(time_sec) / 8192e0) AS BIGINT) AS hi FROM night GROUP BY 1),
g AS (SELECT session_id, unnest(range(lo, hi + 1)) AS sample_idx FROM b), h AS (SELECT *, sample_idx * 8192e0 AS t FROM g)
SELECT h.session_id, h.sample_idx, h.t AS time_sec, round(p.LOC + (q.LOC - p.LOC) * CASE WHEN q.time_sec > p.time_sec THEN (h.t - p.time_sec) / (q.time_sec - p.time_sec) ELSE 0 END, 6) AS LOC,
  round(p.ROC + (q.ROC - p.ROC) * CASE WHEN q.time_sec > p.time_sec THEN (h.t - p.time_sec) / (q.time_sec - p.time_sec) ELSE 0 END, 6) AS ROC
FROM h ASOF LEFT JOIN night p ON p.session_id = h.session_id AND h.t >= p.time_sec ASOF LEFT JOIN night q ON q.session_id = h.session_id AND h.t <= q.time_sec"""))
def resample_up(spark, sf):
    u = spectral.resample_up(fx.night(spark, sf), 1 / 8192.0, ["LOC", "ROC"], CHUNK_S)
    return u.withColumns({c: F.round(c, 6) for c in ("LOC", "ROC")})


def _interpolated(c: str, low: str) -> str:
    """One channel's values that meet ``low``, the others interpolated between them."""
    known = f"(SELECT session_id, sample_idx AS i, {c} AS v FROM indexed WHERE {c} {low})"
    return f"""(SELECT n.session_id, n.sample_idx, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN b.v IS NULL THEN a.v WHEN a.v IS NULL THEN b.v
  ELSE b.v + (a.v - b.v) / (a.i - b.i) * (n.sample_idx - b.i) END, 6) AS {c}
FROM (SELECT session_id, sample_idx, CASE WHEN {c} {low} THEN {c} END AS v FROM indexed) n
ASOF LEFT JOIN {known} b ON b.session_id = n.session_id AND n.sample_idx >= b.i
ASOF LEFT JOIN {known} a ON a.session_id = n.session_id AND n.sample_idx <= a.i)"""


@query("interpolate_nulls", with_views("indexed", body=f"SELECT * FROM {_interpolated('LOC', '< 60')} JOIN {_interpolated('ROC', '> -40')} USING (session_id, sample_idx)"))
def interpolate_nulls(spark, sf):
    n = fx.indexed(spark, sf).select(KEY, "sample_idx", F.when(F.col("LOC") < 60, F.col("LOC")).alias("LOC"), F.when(F.col("ROC") > -40, F.col("ROC")).alias("ROC"))
    return clean.interpolate_nulls(n, "sample_idx", ["LOC", "ROC"], 16).withColumns({c: F.round(c, 6) for c in ("LOC", "ROC")})


@query("residual_signal", with_views("dense", body="""
SELECT session_id, time_sec, round(LOC - loc_clean, 6) AS EEG_LOC, round(ROC - roc_clean, 6) AS EEG_ROC FROM dense"""))
def residual_signal(spark, sf):
    r = clean.residual_signal(dense(spark, sf), fs=DENSE_FS)
    return r.withColumns({c: F.round(c, 6) for c in ("EEG_LOC", "EEG_ROC")})

