"""Overlapping spans: the last listed one holds, as when each is painted over those before it."""

import random

import numpy as np
import pytest

from sleepsignal.operators import align, spans
from sleepsignal.schemas import KEY, T

SPAN = "session_id string, a double, b double, label string, n long, extra int"


def painted(rows, times):
    out = {}
    for s, a, b, label, *_ in sorted(rows, key=lambda r: r[4]):
        for t in times:
            if a is not None and b is not None and a <= t < b:
                out[s, t] = label
    return out


def labelled(spark, rows, times, chunk_s, sessions=("s", "t")):
    grid = spark.createDataFrame([(s, float(t)) for s in sessions for t in times], "session_id string, time_sec double")
    got = align.interval_label(grid, spark.createDataFrame([(*r, 1) for r in rows], SPAN), "a", "b", "label", chunk_s, "n").collect()
    assert len(got) == len(times) * len(sessions)
    return {(r[KEY], r[T]): r["label"] for r in got}


def test_inner_span_listed_later(spark):
    rows = [("s", 0.0, 6.0, "Phasic", 1), ("s", 2.0, 3.0, "Tonic", 2)]
    got = labelled(spark, rows, range(7), 100.0, ["s"])
    assert [got["s", float(t)] for t in range(7)] == ["Phasic", "Phasic", "Tonic", "Phasic", "Phasic", "Phasic", None]
    swapped = labelled(spark, [(*r[:4], 3 - r[4]) for r in rows], range(7), 100.0, ["s"])
    assert [swapped["s", float(t)] for t in range(7)] == ["Phasic"] * 6 + [None]


@pytest.mark.parametrize("chunk_s", [1.0, 7.0, 50.0, 1000.0])
def test_painting(spark, chunk_s):
    rng = random.Random(int(chunk_s))
    times = [k / 2 for k in range(-60, 200)]
    rows = [(rng.choice("st"), a, a + rng.choice([0.5, 1.0, 3.0, 20.0, 90.0]), rng.choice(["P", "T", None]), k) for k in range(150) for a in [rng.randint(-50, 160) / 2]]
    rows += [("s", None, 3.0, "P", 200), ("s", 1.0, None, "P", 201), ("s", 5.0, 5.0, "P", 202), ("s", 9.0, 4.0, "P", 203), ("t", -1000.0, 1000.0, "all", -1)]
    want = painted(rows, times)
    assert labelled(spark, rows, times, chunk_s) == {(s, t): want.get((s, t)) for s in "st" for t in times}


def test_later_start_holds_without_a_listing(spark):
    rows = [("s", 0.0, 9.0, "long", 0, 1), ("s", 2.0, 4.0, "short", 0, 1), ("s", 2.0, 3.0, "shorter", 0, 1)]
    got = sorted(map(tuple, spans.disjoint_spans(spark.createDataFrame(rows, SPAN), "a", "b", "label").collect()))
    assert got == [("s", 0.0, 2.0, "long"), ("s", 2.0, 4.0, "short"), ("s", 4.0, 9.0, "long")]


def test_no_spans(spark):
    assert labelled(spark, [], range(3), 10.0) == {(s, float(t)): None for s in "st" for t in range(3)}


def test_many_spans_in_one_chunk(spark):
    rows = [("s", float(k % 997), float(k % 997 + 1 + k % 13), f"l{k}", k, 1) for k in range(30_000)]
    got = spans.disjoint_spans(spark.createDataFrame(rows, SPAN).repartition(8), "a", "b", "label", "n", 1e6).collect()
    want = painted(rows[-14 * 997:], range(1010))
    assert {("s", float(t)): r["label"] for r in got for t in range(int(r["a"]), int(r["b"]))} == {(s, float(t)): v for (s, t), v in want.items()}


def test_highest_cover_is_a_maximum_over_ranges():
    rng = np.random.default_rng(1)
    lo = rng.integers(0, 50, 200)
    hi = np.minimum(lo + rng.integers(0, 40, 200), 60)
    want = np.full(60, -1)
    for k in range(200):
        want[lo[k]:hi[k]] = np.maximum(want[lo[k]:hi[k]], k)
    assert (spans.highest_cover(lo, hi, np.arange(200), 60) == want).all()


def test_merged_timeline_with_overlapping_subepochs(spark):
    grid = spark.createDataFrame([("s", float(t), 1.0, 2.0) for t in range(8)], "session_id string, time_sec double, LOC double, ROC double")
    none = spark.createDataFrame([], "session_id string, event_id long, Start double, Peak double, End double, Duration double, EM_Type string")
    epochs = spark.createDataFrame([("s", 0.0, "REM")], "session_id string, epoch_start double, stage string")
    eeg = spark.createDataFrame([("s", 0.0, 1.0, 1.0)], "session_id string, time_sec double, EEG_LOC double, EEG_ROC double")
    sub = spark.createDataFrame([("s", 0.0, 6.0, "Phasic", 0), ("s", 2.0, 3.0, "Tonic", 1)], "session_id string, SubEpochStart double, SubEpochEnd double, EpochType string, EpochIdx int")
    out = align.merged_timeline(grid, epochs, none.drop("EM_Type"), none, sub, eeg, 4.0, order="EpochIdx").orderBy(T).collect()
    assert [r["EpochType"] for r in out] == ["Phasic", "Phasic", "Tonic", "Phasic", "Phasic", "Phasic", None, None]
