"""Bootstrap by ranks against plain resampling, whatever the sizes of blocks and draws; fused features against the modules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.operators import compare, resample
from sleepsignal.operators.features import fused
from sleepsignal.plans import night
from sleepsignal.schemas import KEY


def plain_auc(y, s, w):
    ok = ~np.isnan(s)
    p, q = (y == 1) & ok, (y == 0) & ok
    total = w[p].sum() * w[q].sum()
    if not total:
        return None
    over = (s[p][:, None] > s[q]) + (s[p][:, None] == s[q]) / 2
    return float((w[p][:, None] * w[q] * over).sum() / total)


@pytest.mark.parametrize("n, block, draws, groups", [(1, 4, 8, 2), (7, 2, 3, 3), (60, 16, 7, 2), (60, 1 << 16, 1 << 20, 64)])
def test_every_replicate(spark, n, block, draws, groups):
    rng = np.random.default_rng(n)
    y, a, b = rng.integers(0, 2, n), rng.integers(0, 6, n) / 2, rng.normal(size=n)
    a[rng.random(n) < 0.1] = np.nan
    rows = [(i, int(y[i]), None if np.isnan(a[i]) else float(a[i]), float(b[i])) for i in range(n)]
    num = spark.createDataFrame(rows, "i long, y_true int, a double, b double").repartition(3)
    got = {(r["replicate"], r["model"]): r["auc"] for r in resample.replicate_aucs(num, ["a", "b"], n, 25, 5, block, draws, groups).collect()}
    for r in range(25):
        w = np.bincount(resample.drawn(np.arange(n), r, n, 5), minlength=n)
        for k, s in enumerate((a, b)):
            want = plain_auc(y, s, w)
            assert got.get((r, k)) == (None if want is None else pytest.approx(want, abs=1e-12))


def test_arrays_draw_as_columns_do(spark):
    d = spark.range(50).select("id", *[compare.draw(F.col("id"), F.lit(b).cast("long"), F.lit(50).cast("long"), 42).alias(f"b{b}") for b in (0, 9, 9999)]).orderBy("id").toPandas()
    for b in (0, 9, 9999):
        assert (d[f"b{b}"].to_numpy() == resample.drawn(np.arange(50), b, 50, 42)).all()


def test_draws_do_not_travel(spark):
    """What tasks send is the subjects, once per group, and a few rows per replicate, not a count per subject and replicate."""
    num = spark.range(2000).selectExpr("id AS i", "int(id % 2) AS y_true", "double(id * 7919 % 2003) AS a", "double(id * 31 % 1999) AS b")

    def sent(n_boot):
        auc = resample.replicate_aucs(num, ["a", "b"], 2000, n_boot, groups=4)
        assert len(auc.collect()) == 2 * n_boot
        found, walk = 0, [auc._jdf.queryExecution().executedPlan().executedPlan()]
        while walk:
            p = walk.pop()
            while "QueryStage" in p.nodeName():
                p = p.plan()
            if p.nodeName() == "Exchange":
                found += p.metrics().apply("dataSize").value()
            walk += [p.children().apply(k) for k in range(p.children().size())]
        return found

    small = sent(4)
    assert small > 0 and sent(200) - small < 196 * 2 * 500


def test_no_subjects(spark):
    none = spark.createDataFrame([], "id long, y_true int, a double, b double")
    assert compare.bootstrap_deltas(none, "a", "b", 5).count() == 0


def test_fused_features_equal_the_modules(spark):
    """All features on three sessions, one of them without REM and one without a channel."""
    m = fx.dense_night(spark, "/root/testdata/sf0.001").filter(F.col(KEY).isin("D1", "D2", "D3")).cache()
    m = m.withColumn("stage", F.when(F.col(KEY) == "D2", F.when(F.col("stage") == "REM", "N1").otherwise(F.col("stage"))).otherwise(F.col("stage")))
    m = m.withColumn("EEG_ROC", F.when(F.col(KEY) != "D3", F.col("EEG_ROC")))
    s = night.Settings(fs=16.0, sub_s=0.5, chunk_s=7.0)
    few = {"seg_s": 2.0, "min_s": 4.0}
    old, failed = night.extract(m, s=s, options={"eeg": few, "bout": {"chunk_bins": 32}, "extra": {"long_s": 1.5, "seg_s": 2.0, "min_s": 2.0}})
    new = fused.night_features(m, 16.0, 7.0, 0.5, 1.5, 32, 2.0, 4.0, 2.0)
    assert not failed and set(new.columns) == set(old.columns) and len(new.columns) == 142
    want = old.select(sorted(old.columns)).orderBy(KEY).toPandas().set_index(KEY)
    got = new.select(sorted(new.columns)).orderBy(KEY).toPandas().set_index(KEY)
    assert list(got.index) == ["D1", "D2", "D3"]
    for c in want.columns:
        x, y = want[c].astype(float).to_numpy(), got[c].astype(float).to_numpy()
        assert np.allclose(x, y, atol=2e-4, rtol=1e-6, equal_nan=True), (c, x, y)


def test_three_scans_of_the_timeline(spark):
    """The stage tables are written from one scan each, and nothing else reads the timeline."""
    m = fx.dense_night(spark, "/root/testdata/sf0.001")
    pieces = fused.condense(m, 16.0, 0.5)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == m._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    out = fused.night_features(m, 16.0, 16.0, 0.5, 1.5, 32, 2.0, 4.0, 2.0)
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all("lineitem" not in f for f in out.inputFiles())


def test_features_are_not_planned_as_one_query(spark):
    """The joined features read written groups: one scan each, nothing grouped or windowed again."""
    out = fused.night_features(fx.dense_night(spark, "/root/testdata/sf0.001").filter(F.col(KEY) == "D1"), 16.0, 16.0, 0.5, 1.5, 32, 2.0, 4.0, 2.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and plan.count("parquet") == 15
    assert out.count() == 1
