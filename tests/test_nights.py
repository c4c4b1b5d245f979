"""Hand-made nights with known answers for each boundary rule."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sleepsignal import schemas
from sleepsignal.operators import align, clean, cohort, events, runs, spectral
from sleepsignal.operators.features import bout, eeg, eog, extra, patient, stage_prob
from sleepsignal.plans import night

KEY, T = schemas.KEY, schemas.T


def samples(spark, n=10, stage=None, **cols):
    stage = stage or ["REM"] * n
    return spark.createDataFrame(pd.DataFrame({KEY: "n", T: [float(i) for i in range(n)], "stage": stage, **cols}))


def event_rows(spark, rows):
    return spark.createDataFrame(rows, "session_id string, event_id long, Start double, Peak double, End double")


def col(df, name, order=T):
    return [r[name] for r in df.orderBy(order).collect()]


def test_latest_started_event_wins_and_end_is_closed(spark):
    ev = event_rows(spark, [("n", 0, 1.0, 2.0, 8.0), ("n", 1, 3.0, 3.5, 5.0)])
    out = align.asof_interval(samples(spark).select(KEY, T), ev, "event_", "inside", ["End"], 2.0)
    assert col(out, "event_event_id") == [None, 0, 0, 1, 1, 1, None, None, None, None]
    assert col(out, "inside") == [False, True, True, True, True, True, False, False, False, False]


def test_peak_flag_ties_go_to_the_first_sample(spark):
    ev = event_rows(spark, [("n", 0, 1.0, 2.5, 3.0), ("n", 1, 5.0, 6.6, 7.0), ("n", 2, 9.0, 40.0, 41.0), ("n", 3, -9.0, -5.0, -4.0)])
    out = align.nearest_sample_flag(samples(spark).select(KEY, T), ev, "peak", 3.0)
    assert [i for i, f in enumerate(col(out, "peak")) if f] == [0, 2, 7, 9]


def test_no_stage_before_the_first_epoch_and_half_open_labels(spark):
    ep = spark.createDataFrame([("n", 3.0, "W"), ("n", 6.0, "REM")], "session_id string, epoch_start double, stage string")
    out = align.asof_backward(samples(spark).select(KEY, T), ep, "epoch_start", ["stage"], 4.0)
    assert col(out, "stage") == [None] * 3 + ["W"] * 3 + ["REM"] * 4
    sub = spark.createDataFrame([("n", 2.0, 4.0, "Phasic"), ("n", 4.0, 6.0, "Tonic")], "session_id string, a double, b double, EpochType string")
    lab = align.interval_label(samples(spark).select(KEY, T), sub, "a", "b", "EpochType", 4.0)
    assert col(lab, "EpochType") == [None, None, "Phasic", "Phasic", "Tonic", "Tonic", None, None, None, None]


def test_nearest_prefers_the_earlier_row_on_ties(spark):
    e = spark.createDataFrame([("n", 1.0, 10.0), ("n", 3.0, 30.0)], "session_id string, time_sec double, EEG_LOC double")
    out = align.asof_nearest(samples(spark, 5).select(KEY, T), e, T, ["EEG_LOC"], 1.5)
    assert col(out, "EEG_LOC") == [10.0, 10.0, 10.0, 30.0, 30.0]


def test_artefact_limit_and_range_mask(spark):
    d = samples(spark, 4, LOC=[300.0, 300.1, -301.0, 1.0], ROC=[1.0, 2.0, 3.0, 4.0])
    m = clean.mask_artefacts(d)
    assert col(m, "LOC") == [300.0, None, None, 1.0] and col(m, "ROC") == [1.0, None, None, 4.0]
    ev = spark.createDataFrame(
        [("n", 1.2, 2.5, 400.0, 1.0), ("n", 2.0, 3.1, 1.0, 400.0), ("n", 6.0, 7.0, 1.0, 1.0)],
        "session_id string, Start double, End double, LOCAbsValPeak double, ROCAbsValPeak double")
    s = samples(spark, 8, LOC=[1.0] * 8, ROC=[1.0] * 8).withColumn("i", F.col(T).cast("long"))
    out = align.mask_event_ranges(s, ev, "i", 1.0, chunk_rows=3)
    assert col(out, "LOC") == [1.0, None, None, None, 1.0, 1.0, 1.0, 1.0]


def test_night_without_rem(spark):
    d = samples(spark, 6, ["W", "N1", "N2", "N2", "W", "W"], LOC=[1.0] * 6, ROC=[1.0] * 6).withColumns({
        "EpochType": F.lit(None).cast("string"), "event_Peak": F.lit(None).cast("double"), "em_event_id": F.lit(None).cast("long"),
        "is_rem_event": F.lit(False), "is_em_event": F.lit(False), "EM_Type": F.lit(None).cast("string"),
        **{c: F.lit(None).cast("double") for c in (
            "event_Duration", "event_LOCAbsValPeak", "event_ROCAbsValPeak", "event_LOCAbsRiseSlope", "event_ROCAbsRiseSlope", "em_Duration",
            "em_MeanAbsValPeak", "prob_w", "prob_n1", "prob_n2", "prob_n3", "prob_rem")}})
    r = eog.eog_features(d, 1.0, 2.0).first().asDict()
    assert r["n_rem_epochs"] == 0 and r["rem_epoch_count"] is None and r["rem_event_count"] == 0 and r["rem_event_rate_per_min"] is None
    assert r["sem_count_rem_sleep"] is None and r["em_count_n1"] == 0 and r["phasic_epoch_count"] == 0 and r["rem_loc_p95_uv"] is None
    assert len(r) - 1 == 50
    p = stage_prob.stage_prob_features(d, 1.0, 2.0).first().asDict()
    assert len(p) - 1 == 12 and set(v for k, v in p.items() if k != KEY) == {None}
    assert extra.sleep_architecture(d, 2.0).first()["n_rem_cycles"] is None
    assert extra.waso(d, 1.0).first()["waso_min"] == pytest.approx(2 / 60, abs=1e-4)
    assert bout.bout_features(d, 1.0).first()["phasic_tonic_transitions"] is None


def test_one_run_has_no_spread_and_a_single_bout_has_zero(spark):
    d = samples(spark, 12, ["W"] * 2 + ["REM"] * 8 + ["W"] * 2, EpochType=[None] * 2 + ["Phasic"] * 8 + [None] * 2)
    r = eog.rem_epoch_duration(d, 1.0, 3.0).first()
    assert r["rem_epoch_count"] == 1 and r["rem_epoch_std_duration_min"] is None and r["rem_epoch_mean_duration_min"] == round(8 / 60, 3)
    b = bout.bout_features(d, 1.0, 4.0).first()
    assert b["phasic_bout_count"] == 1 and b["phasic_bout_std_duration_s"] == 0.0 and b["tonic_bout_count"] is None
    assert b["phasic_bout_total_duration_s"] == 12.0 and b["phasic_tonic_transitions"] == 0


def test_latency_of_half_a_digit_is_rounded_up(spark):
    """The times differ by 983888.69755 s; what their subtraction leaves is a little less."""
    d = spark.createDataFrame([("n", 21870.321604, "REM", "Tonic"), ("n", 1005759.019154, "REM", "Phasic")], "session_id string, time_sec double, stage string, EpochType string")
    assert bout.bout_structure(d, 1.0).first()["phasic_first_latency_s"] == 983888.6976


def test_bouts_ignore_gaps_unless_told(spark):
    s = spark.createDataFrame([("n", b, t) for b, t in [(0, "Phasic"), (1, "Phasic"), (9, "Phasic"), (10, "Tonic")]], "session_id string, bin long, EpochType string")
    assert sorted(r["length"] for r in runs.bouts(s, chunk_bins=4).collect()) == [1, 3]
    assert sorted(r["length"] for r in runs.bouts(s, break_on_gap=True, chunk_bins=4).collect()) == [1, 1, 2]


def test_subepoch_rule(spark):
    hyp = spark.createDataFrame([("n", 0, 0), ("n", 1, 4)], "session_id string, epoch_idx long, stage_code int")
    dur = spark.createDataFrame([("n", 58.0)], "session_id string, duration_s double")
    ev = spark.createDataFrame([("n", 33.0, 0.6), ("n", 35.9, 0.4), ("n", 36.0, 0.9)], "session_id string, Peak double, Duration double")
    out = events.classify_subepochs(hyp, dur, ev).orderBy("SubEpochStart").collect()
    assert [(r["SubEpochStart"], r["EpochType"]) for r in out] == [(32.0, "Phasic")] + [(float(s), "Tonic") for s in range(36, 54, 4)]


def brute_movements(loc, roc, stage, th, fs, limit=600.0):
    """The detection rules in plain loops."""
    a, n, out = np.abs(roc - loc), len(loc), []
    cand = (a < limit) & (a > th)
    low = [i for i in range(n) if a[i] < th / 2 and (i in (0, n - 1) or np.sign(a[i + 1] - a[i]) > np.sign(a[i] - a[i - 1]))]
    i = 0
    while i < n:
        if not cand[i]:
            i += 1
            continue
        j = i
        while j < n and cand[j]:
            j += 1
        p = i + int(np.argmax(a[i:j]))
        left = [m for m in low if m < p]
        right = [m for m in low if m > p]
        lo, hi = left[-1] if left else max(p - 1, 0), right[0] - 1 if right else min(p + 1, n - 1)
        out.append((lo / fs, p / fs, hi / fs, stage[lo]))
        i = j
    return out


@pytest.mark.parametrize("chunk", [5, 37, 1000])
def test_detection_equals_plain_loops(spark, chunk):
    r = np.random.default_rng(7)
    n = 300
    loc = np.cumsum(r.normal(0, 20, n)) % 300
    roc = -loc * r.uniform(0.2, 0.9, n)
    stage = r.choice(["W", "N2", "REM"], n)
    pdf = pd.DataFrame({KEY: "n", "sample_idx": np.arange(n), "stage": stage, "loc_clean": loc, "roc_clean": roc})
    th = spark.createDataFrame([("n", 250.0)], "session_id string, threshold double")
    got = events.detect_movements(spark.createDataFrame(pdf), th, 128.0, chunk_rows=chunk).orderBy("Peak", "Start").collect()
    want = brute_movements(loc, roc, stage, 250.0, 128.0)
    assert [(g["Start"], g["Peak"], g["End"], g["Stage"]) for g in got] == want and len(want) > 10


def test_two_window_rule(spark):
    rows = [("n", 0.0, 200.0, 0.2), ("n", 2.5, 10.0, 0.2), ("n", 3.0, 160.0, 0.1), ("n", 5.0, 10.0, 0.1), ("n", 9.0, 200.0, 0.9), ("n", 16.0, 1.0, 0.1)]
    d = spark.createDataFrame(rows, "session_id string, Start double, LOCAbsValPeak double, Duration double").withColumns(
        {"ROCAbsValPeak": F.lit(1.0), "Stage": F.lit("REM")})
    out = events.two_window_rule(d).orderBy("slot")
    assert [(r["REM_Type"], r["EM_count"]) for r in out.collect()] == [("Phasic", 3), ("Tonic", 1), ("Unclassified", 1), ("Tonic", 0)]
    assert [r["slot"] for r in events.min_spacing(out).orderBy("slot").collect()] == [0, 2]


def test_min_spacing_is_greedy_on_a_grid_with_holes(spark, monkeypatch):
    monkeypatch.setattr(events, "SPACING_CHUNK", 7)
    r = np.random.default_rng(3)
    rows = [("a", s) for s in (0, 3, 4, 6)] + [("b", int(s)) for s in np.flatnonzero(r.random(120) < 0.6)] + [("c", 5)]
    want = []
    for key in "abc":
        last = None
        for s in sorted(s for k, s in rows if k == key):
            if last is None or s - last >= 3:
                want.append((key, s))
                last = s
    got = events.min_spacing(spark.createDataFrame(rows, "session_id string, slot long"), 12.0, 4.0).collect()
    assert sorted((g["session_id"], g["slot"]) for g in got) == want


def test_sessions_without_lights_are_kept_whole(spark):
    samples = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 1.0), ("c", 9.0)], "session_id string, time_sec double")
    lights = spark.createDataFrame([("a", 2.0, 6.0), ("c", None, 8.0)], "session_id string, lights_off double, lights_on double")
    assert sorted(map(tuple, clean.trim_lights(samples, lights).collect())) == [("a", 5.0), ("b", 1.0)]
    assert sorted(map(tuple, clean.time_offset(samples, lights, ["time_sec"]).collect())) == [("a", 3.0), ("a", 7.0), ("b", 1.0), ("c", 9.0)]


def test_sine_power_lands_in_its_band(spark):
    fs, n = 64.0, 64 * 20
    t = np.arange(n) / fs
    x = 3.0 * np.sin(2 * np.pi * 6.0 * t)
    d = spark.createDataFrame(pd.DataFrame({KEY: "n", T: t, "stage": "REM", "EEG_LOC": x, "EEG_ROC": x}))
    r = eeg.stage_power(d, fs, 3.0).first()
    assert r["eeg__rem__theta"] == pytest.approx(4.5, rel=1e-3) and r["eeg__rem__delta"] < 1e-3 and r["eeg__w__theta"] is None
    assert len(r) - 1 == 31
    c = eeg.context_power(d, fs, 3.0).first()
    assert c["eeg_theta_rem_power"] == pytest.approx(4.5, rel=1e-3) and c["eeg_gamma_phasic_power"] is None and len(c) - 1 == 12


@pytest.mark.parametrize("chunk", [32, 100, 5000])
def test_bandpass_has_no_seams(spark, chunk):
    r = np.random.default_rng(2)
    x = r.normal(size=500)
    taps = spectral.fir_taps(64.0, 0.1, 4.0, 41)
    d = spark.createDataFrame(pd.DataFrame({KEY: "n", "sample_idx": np.arange(500), "LOC": x}))
    out = spectral.bandpass_filter(d, taps, ["LOC"], chunk_rows=chunk).orderBy("sample_idx").toPandas()
    np.testing.assert_allclose(out["LOC_clean"], np.convolve(x, taps, mode="full")[20:520], atol=1e-12)


def test_group_rules(spark):
    d = spark.createDataFrame([(1, 0, 0, 1, 1), (0, 0, 1, 1, 0), (0, 1, 0, 0, 0), (0, 0, 0, 0, 0)], "Control int, `PD(-RBD)` int, `PD(+RBD)` int, iRBD int, PLM int")
    g = [r[0] for r in d.select(cohort.assign_group(d)).collect()]
    assert g == ["Control", "iRBD", "PD(-RBD)", "Unknown"]
    assert [r[0] for r in d.select(cohort.assign_group(d, "info")).collect()][3] == "Control"


def test_patient_labels_default_to_zero(spark):
    s = spark.createDataFrame([("DCSM_1_a_merged",), ("zzz",)], "subject_id string")
    p = spark.createDataFrame([("DCSM_1_a", 2, 0), ("DCSM_1_a", 1, 1)], "patient_id string, row_id int, iRBD int")
    out = {r["subject_id"]: r for r in patient.patient_features(s, p).collect()}
    assert out["DCSM_1_a_merged"]["iRBD"] == 1 and out["zzz"]["iRBD"] == 0 and out["zzz"]["Control"] == 0


def test_required_columns(spark):
    with pytest.raises(ValueError, match="is_rem_event"):
        eog.eog_features(samples(spark))
    with pytest.raises(ValueError, match="unknown modules"):
        night.extract(samples(spark), ["nope"])


def test_process_trims_shifts_and_merges(spark):
    s = samples(spark, 20, LOC=[float(i) for i in range(20)], ROC=[0.0] * 20).drop("stage")
    lights = spark.createDataFrame([("n", 4.0, 15.0)], "session_id string, lights_off double, lights_on double")
    stg = spark.createDataFrame([("n", 0.0, "W"), ("n", 5.0, "REM")], "session_id string, epoch_start double, stage string")
    ev = spark.createDataFrame([("n", 0, 1.0, 2.0, 3.0)], "session_id string, event_id long, Start double, Peak double, End double")
    sub = spark.createDataFrame([("n", 4.0, 8.0, "Tonic")], "session_id string, SubEpochStart double, SubEpochEnd double, EpochType string")
    e = spark.createDataFrame([("n", 0.0, 1.0, 2.0)], "session_id string, time_sec double, EEG_LOC double, EEG_ROC double")
    m = night.process(s, stg, ev, ev.withColumn("EM_Type", F.lit("SEM")), sub, e, lights).orderBy(T).collect()
    assert [r[T] for r in m] == [float(i) for i in range(4, 16)]
    assert m[0]["stage"] is None and m[1]["stage"] == "REM" and [r[T] for r in m if r["is_em_event"]] == [5.0, 6.0, 7.0]
    assert [r[T] for r in m if r["event_is_peak"]] == [6.0] and [r[T] for r in m if r["EpochType"] == "Tonic"] == [8.0, 9.0, 10.0, 11.0]
    assert math.isclose(m[3]["EEG_ROC"], 2.0)
