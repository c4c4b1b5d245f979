"""Spectra in blocks of segments: equal to one pass over the series, wherever the blocks are cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleepsignal.operators import spectral
from sleepsignal.operators.features import fused
from sleepsignal.schemas import KEY, T

FS = 16.0


def night(spark):
    r = np.random.default_rng(7)
    rows = []
    for s, n in (("long", 700), ("short", 100)):
        for i in range(n):
            left, right = (None if r.random() < 0.1 else float(v) for v in r.normal(0, 5, 2))
            rows.append((s, i / FS, "REM" if i % 90 < 60 else "N2", left, right))
    return rows, spark.createDataFrame(rows, f"{KEY} string, {T} double, stage string, EEG_LOC double, EEG_ROC double").repartition(3)


def brute(x, seg):
    size = min(seg, len(x))
    step = size - size // 2
    return np.mean([*spectral.density([x[a:a + size] for a in range(0, len(x) - size + 1, step)], FS)], axis=0)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks_give_what_one_pass_gives(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK_SEGS", block)
    rows, df = night(spark)
    signal = spectral.stage_signal(df, 5.0)
    got = spectral.welch(signal, [KEY, "stage"], "pos", "x", FS, 2.0).orderBy("k").collect()
    for s in ("long", "short"):
        for stage in ("REM", "N2", spectral.ALL):
            mine = [r for r in rows if r[0] == s and stage in (r[2], spectral.ALL)]
            left, right = ([r[c] for r in mine if r[c] is not None] for c in (3, 4))
            x = np.array([(a + b) / 2 for a, b in zip(left, right)])
            np.testing.assert_allclose([r["psd"] for r in got if (r[KEY], r["stage"]) == (s, stage)], brute(x, 32), rtol=1e-9)


def test_channels_are_paired_without_a_join_and_rows_sent_once(spark):
    _, df = night(spark)
    signal = spectral.stage_signal(df, 5.0)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(signal).count("Join ") == 1  # of the counts carried over chunks
    one = spark.range(0, 32 * 16).select(F.lit("n").alias(KEY), F.col("id").alias("pos"), F.rand(1).alias("x"), F.lit(512).cast("long").alias("n"))
    spec = spectral.welch(one, [KEY], "pos", "x", FS, 2.0)
    assert "_block" in plan(spec) and "_seg#" not in plan(spec) and spec.count() == 17


def test_segments_of_many_series_are_one_matrix(monkeypatch):
    """300 series of one or two segments in a batch: one pass per length and mode, the same sums; a segment with a hole is left out."""
    r, calls = np.random.default_rng(1), []
    rows = [(f"s{i % 300}", i % 2 == 0, "N2", size, fused.MIX if i % 2 == 0 else fused.PAIR, r.normal(size=2 * size)) for i in range(450) for size in [8 + 8 * (i % 300 > 200)]]
    rows[7][5][3] = np.nan
    types = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*fused.SERIES, "values"])
    one = fused.densities
    monkeypatch.setattr(fused, "densities", lambda x, fs: calls.append(len(x)) or one(x, fs))
    got = {tuple(g[c] for c in fused.SERIES): g for out in fused.segment_sums(batch, FS) for g in out.to_pylist()}
    assert len(calls) == 4 and sum(calls) == 450 and len(got) == len({r[:5] for r in rows}) == 300
    for key, g in got.items():
        mine = [(v[:len(v) // 2] + v[len(v) // 2:]) / 2 for *k, v in rows if tuple(k) == key]
        mine = [x for x in mine if not np.isnan(x).any()]
        assert g["segs"] == len(mine)
        np.testing.assert_allclose(g["total"], np.sum([*spectral.density(mine, FS)], axis=0), rtol=1e-12)


def test_segments_with_a_hole_are_left_out(spark):
    """One channel only: NULLs stay, so the mean is over the segments without one."""
    x = [None if i == 40 else float(v) for i, v in enumerate(np.random.default_rng(3).normal(size=160))]
    df = spark.createDataFrame([("n", i, v, 160) for i, v in enumerate(x)], f"{KEY} string, pos long, x double, n long")
    got = spectral.welch(df, [KEY], "pos", "x", FS, 2.0).orderBy("k").collect()
    whole = [x[a:a + 32] for a in range(0, 129, 16) if None not in x[a:a + 32]]
    np.testing.assert_allclose([r["psd"] for r in got], np.mean([*spectral.density(whole, FS)], axis=0), rtol=1e-9)
    none = spectral.welch(df.filter("pos < 64").withColumn("n", spectral.F.lit(64).cast("long")).withColumn("x", spectral.F.lit(None).cast("double")), [KEY], "pos", "x", FS, 2.0)
    assert [r["psd"] for r in none.collect()] == [None] * 17
