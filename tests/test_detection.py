"""Raw signal to movements: independent of chunks, and the movement that was put in is found."""

import numpy as np
from pyspark.sql import functions as F

from sleepsignal.catalog import sequences
from sleepsignal.operators import events, spectral
from sleepsignal.plans import night
from sleepsignal.plans.chunked import running
from sleepsignal.schemas import KEY
from sleepsignal.session import cut

FS = 32.0


def signal(spark):
    t = np.arange(0, 64, 1 / FS)
    rng = np.random.default_rng(4)
    loc, roc = rng.normal(0, 2, len(t)), rng.normal(0, 2, len(t))
    for at in (20.0, 41.5):  # eyes move together: the channels go apart
        bump = 90 * np.exp(-((t - at) / 0.15) ** 2)
        loc, roc = loc + bump, roc - bump
    both = 90 * np.exp(-((t - 55.0) / 0.15) ** 2)  # an artefact, alike in both channels
    rows = [("n", i, float(a + b), float(r + b), "REM") for i, (a, r, b) in enumerate(zip(loc, roc, both, strict=True))]
    rows.append(("short", 0, 1.0, -1.0, "REM"))
    return spark.createDataFrame(rows, "session_id string, sample_idx long, LOC double, ROC double, stage string").repartition(4)


def test_raw_to_events(spark):
    d = signal(spark)
    hypnogram = spark.createDataFrame([("n", 0, 4), ("n", 1, 4), ("n", 2, 0)], "session_id string, epoch_idx long, stage_code int")
    s = night.Settings(detect_fs=FS)
    taps = spectral.fir_taps(FS, 0.1, 5.0, 65)
    found = []
    for chunk_rows in (40, 1000, 65_536):
        em, sub = night.detect(d, hypnogram, s, taps, chunk_rows=chunk_rows)
        found.append((sorted(map(tuple, em.collect())), sorted(map(tuple, sub.collect()))))
    assert found[0] == found[1] == found[2]
    em, sub = night.detect(d, hypnogram, s, taps)
    peaks = em.filter((F.col("LOCAbsValPeak") > 30) & (F.col(KEY) == "n")).orderBy("Peak").collect()
    assert [round(r["Peak"]) for r in peaks] == [20, 42] or [round(r["Peak"], 1) for r in peaks] == [20.0, 41.5]
    assert all(r["Start"] < r["Peak"] < r["End"] and r["MeanAbsValPeak"] > 80 and r["EM_Type"] in ("SEM", "REM") and r["Stage"] == "REM" for r in peaks)
    assert sub.filter("SubEpochStart >= 60").isEmpty() and sub.count() == 15


def test_filter_hands_columns_on(spark):
    d = signal(spark)
    f = spectral.bandpass_filter(d, spectral.fir_taps(FS, 0.1, 5.0, 65), ["LOC"], chunk_rows=40, keep=["stage", "ROC"])
    assert f.columns == [KEY, "sample_idx", "LOC_clean", "stage", "ROC"]
    assert f.join(d.select(KEY, "sample_idx", F.col("ROC").alias("_r")), [KEY, "sample_idx"]).filter("ROC <> _r").isEmpty() and f.count() == d.count()


def test_only_minima_and_candidates_are_written_with_neighbours(spark, monkeypatch):
    d = signal(spark).withColumnsRenamed({"LOC": "loc_clean", "ROC": "roc_clean"})
    written = []
    monkeypatch.setattr(events, "cut", lambda df: written.append(cut(df)) or written[-1])
    th = d.select(KEY).distinct().withColumn("threshold", F.lit(30.0))
    found = events.detect_movements(d, th, FS, chunk_rows=40)
    assert found.count() >= 2
    s = written[0]
    assert not {"amp", "threshold"} & set(s.columns)
    assert s.filter("(prev is not null and not (_cand or _low)) or (next is not null and not _cand)").isEmpty()
    assert s.count() == d.count() and not s.filter("_cand and next is not null").isEmpty()


def test_second_pass_reads_minima_and_candidates_only(spark, monkeypatch):
    d = signal(spark).withColumnsRenamed({"LOC": "loc_clean", "ROC": "roc_clean"})
    seen = []
    monkeypatch.setattr(events, "running", lambda df, *a, **k: seen.append(df) or running(df, *a, **k))
    th = d.select(KEY).distinct().withColumn("threshold", F.lit(30.0))
    assert events.detect_movements(d, th, FS, chunk_rows=40).count() >= 2
    assert seen[1].filter("not (_cand or _low)").isEmpty() and seen[1].count() < d.count()

def test_threshold_comes_with_the_carried_values(spark):
    d = signal(spark).withColumnsRenamed({"LOC": "loc_clean", "ROC": "roc_clean"})
    th = d.select(KEY).distinct().filter(F.col(KEY) == "n").withColumn("threshold", F.lit(30.0))
    low = events.local_minima(d, th, chunk_rows=40)
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert low.filter(F.col(KEY) == "short").isEmpty() and low.count() > 100

def test_runs_on_dealt_rows(spark):
    d = signal(spark).withColumnsRenamed({"LOC": "loc_clean", "ROC": "roc_clean"})
    th = d.select(KEY).distinct().withColumn("threshold", F.lit(3.0))
    found = events.movement_runs(d, th, chunk_rows=7)
    assert "RepartitionByExpression" not in found._jdf.queryExecution().optimizedPlan().toString()
    amp = {r["sample_idx"]: abs(r["roc_clean"] - r["loc_clean"]) for r in d.filter(F.col(KEY) == "n").collect()}
    want, start = set(), None
    for i in range(len(amp) + 1):
        on = i in amp and 3.0 < amp[i] < events.AMP_LIMIT
        if on and start is None:
            start = i
        elif not on and start is not None:
            want.add((start, i - 1))
            start = None
    assert {(r["start_idx"], r["end_idx"]) for r in found.filter(F.col(KEY) == "n").collect()} == want

def test_peaks_of_runs_deal_the_samples_once(spark):
    found = sequences.peak_in_run(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    assert found.count() == found.select(KEY, "peak_idx").distinct().count() > 0

def test_rolling_mask_in_one_sort(spark):
    on = {3, 4, 40, 44, 60, 61, 99}
    there = [i for i in range(100) if i not in (42, 43, 70)]  # a window goes by index, so holes count
    d = spark.createDataFrame([("a", i, i in on) for i in there] + [("b", 0, True)], "session_id string, sample_idx long, m boolean").repartition(4)
    for hole, em in ((8.0, 10.0), (3.0, 0.0), (1.0, 5.0)):
        h, k, h2, k2 = int(hole) // 2, max(0, int(hole) - int(hole) // 2 - 1), int(em) // 2, max(0, int(em) - int(em) // 2 - 1)
        wide = {i: any(i - h <= j <= i + k for j in on & set(there)) for i in there}
        want = {i: all(wide[j] for j in there if i - h2 <= j <= i + k2) for i in there}
        for chunk_rows in (3, 16, 1000):
            found = events.rolling_mask(d, F.col("m"), 1.0, hole, em, chunk_rows=chunk_rows)
            assert found.columns == [*d.columns, "is_em"] and found.count() == len(there) + 1
            assert {r["sample_idx"]: r["is_em"] for r in found.filter(F.col(KEY) == "a").collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan
