"""Running functions: every chunk length must give what one long pass gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.functions.ranks import rank_sums
from sleepsignal.plans.chunked import CHUNK, Run, row_index_and_total, run_ids, running, with_time_chunk, with_value_chunk


def series(seed=1, n=400):
    """Three sessions, one of them holding most of the rows."""
    r = np.random.default_rng(seed)
    s = r.choice(["hot", "a", "b"], size=n, p=[0.8, 0.1, 0.1])
    return pd.DataFrame({
        "s": s, "t": np.sort(r.uniform(0, 100, n)).round(6), "v": np.where(r.random(n) < 0.3, np.nan, r.integers(0, 9, n)),
        "lab": r.choice(["x", "y", None], n)})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf, df


@pytest.mark.parametrize("length", [0.5, 7.0, 1000.0])
def test_running_matches_one_pass(frame, length):
    pdf, df = frame
    runs = [
        Run("total", F.coalesce("v", F.lit(0.0)), "sum"), Run("last", F.col("v"), "last"), Run("next", F.col("v"), "next"),
        Run("before", F.col("v"), "last_before"), Run("lag", F.col("v"), "lag"), Run("lead", F.col("v"), "lead"),
    ]
    got = running(with_time_chunk(df, "t", length), ["s"], ["t"], runs).toPandas().sort_values(["s", "t"]).reset_index(drop=True)
    p = pdf.sort_values(["s", "t"]).reset_index(drop=True)
    g = p.groupby("s")["v"]
    want = pd.DataFrame({
        "total": p["v"].fillna(0).groupby(p["s"]).cumsum(), "last": g.ffill(), "next": g.bfill(), "before": g.ffill().groupby(p["s"]).shift(),
        "lag": g.shift(), "lead": g.shift(-1)})
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, err_msg=c)


@pytest.mark.parametrize("length", [0.5, 7.0, 1000.0])
def test_run_ids_and_positions(frame, length):
    pdf, df = frame
    d = run_ids(with_time_chunk(df, "t", length), ["s"], ["t"], F.col("lab"))
    got = row_index_and_total(d, ["s"], ["t"], "i", "n").drop(CHUNK).toPandas().sort_values(["s", "t"]).reset_index(drop=True)
    p = pdf.sort_values(["s", "t"]).reset_index(drop=True)
    lab = p["lab"].fillna("-")
    turn = (lab != lab.groupby(p["s"]).shift()).astype(int)
    assert got["run_id"].tolist() == turn.groupby(p["s"]).cumsum().tolist()
    assert got["i"].tolist() == p.groupby("s").cumcount().tolist()
    assert got["n"].tolist() == p.groupby("s")["t"].transform("size").tolist()


@pytest.mark.parametrize("buckets", [1, 3, 64, 4096])
def test_exact_quantiles(spark, buckets):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": r.choice(["a", "b"], 999, p=[0.9, 0.1]), "v": np.exp(r.normal(0, 3, 999)).round(2)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"lo": 0.0, "p": 0.37, "q": 0.95, "hi": 1.0}, buckets).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["lo", "p", "q", "hi"]].astype(float), np.quantile(part["v"], [0, 0.37, 0.95, 1]), rtol=1e-12)


@pytest.mark.parametrize("small", [0, 200, 4096])
def test_small_groups_carry_no_cuts(spark, small):
    """Groups on either side of the limit give the same quantiles; many small ones need no approximate cuts."""
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": r.choice(["a", "b", None], 2999, p=[0.9, 0.05, 0.05]), "v": np.where(r.random(2999) < 0.1, np.nan, r.normal(0, 3, 2999).round(1))})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    out = exact_quantiles(df, ["g"], "v", {"lo": 0.0, "p": 0.37, "hi": 1.0}, 16, small)
    got = out.toPandas().set_index("g")
    assert sorted(got.index) == ["a", "b"]
    for g, part in pdf.dropna().groupby("g"):
        np.testing.assert_allclose(got.loc[g].astype(float), np.quantile(part["v"], [0, 0.37, 1]), rtol=1e-12)
    assert ("percentile_approx" in out._jdf.queryExecution().optimizedPlan().toString()) == (small < 4096)


def test_rank_sums_equal_pair_counts(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": "m", "v": r.integers(0, 12, 80).astype(float), "y": r.integers(0, 2, 80)})
    row = rank_sums(spark.createDataFrame(pdf), ["k"], "v", "y").first()
    pos, neg = pdf.v[pdf.y == 1].to_numpy(), pdf.v[pdf.y == 0].to_numpy()
    u = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert row["u"] == u and row["auc"] == pytest.approx(u / len(pos) / len(neg))


def test_value_chunks_are_monotone(frame):
    _, df = frame
    p = with_value_chunk(df, ["s"], "t", 16).toPandas().sort_values(["s", "t"])
    assert (p.groupby("s")[CHUNK].diff().dropna() >= 0).all() and p[CHUNK].nunique() > 8


def test_a_value_that_fills_half_a_key_is_dealt_over_chunks(spark):
    r = np.random.default_rng(4)
    v = np.concatenate([np.zeros(10_000), r.normal(0, 1, 10_000), np.full(2_000, 9.0)])
    df = spark.createDataFrame(pd.DataFrame({"k": "f", "v": v, "h": r.random(len(v)), "id": np.arange(len(v))}))
    got = with_value_chunk(df, ["k"], "v", 64, ties="h")
    sizes = got.groupBy(CHUNK).count().toPandas()["count"]
    assert sizes.max() <= 3 * len(v) / 64
    p = got.toPandas().sort_values(["v", "h", "id"])
    assert (p[CHUNK].diff().dropna() >= 0).all()
    placed = row_index_and_total(got, ["k"], ["v", "h", "id"], "i", "n").toPandas().sort_values(["v", "h", "id"])
    assert (placed["i"].to_numpy() == np.arange(len(v))).all() and (placed["n"] == len(v)).all()


def test_an_outlier_or_a_heavy_tail_does_not_fill_a_chunk(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.lognormal(0, 2, 40_000), [1e12, -1e15]])
    df = spark.createDataFrame(pd.DataFrame({"k": "f", "v": v}))
    sizes = [x["count"] for x in with_value_chunk(df, ["k"], "v", 64).groupBy(CHUNK).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 3 * len(v) / 64
    low = with_value_chunk(df, ["k"], "v", 64).groupBy(CHUNK).agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy(CHUNK).collect()
    assert all(x["b"] < y["a"] for x, y in zip(low, low[1:]))
    q = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.999}, 32).first()
    assert (q["a"], q["b"]) == pytest.approx(tuple(np.quantile(v, [0.25, 0.999])))


def test_no_sort_holds_what_is_carried(frame):
    """The carried values are joined above the windows, and what the windows read is made after the rows are dealt."""
    _, df = frame
    runs = [Run("lag", F.struct("v", "lab"), "lag"), Run("next", F.when(F.col("v") > 3, F.struct("v", "lab")), "next")]
    out = running(with_time_chunk(df, "t", 7.0), ["s"], ["t"], runs)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = {w: next(i for i, line in enumerate(lines) if w in line) for w in ("Join LeftOuter", "Window [", "RepartitionByExpression")}
    assert first["Join LeftOuter"] < first["Window ["] < first["RepartitionByExpression"]
    assert not any("named_struct" in line for line in lines[first["RepartitionByExpression"]:first["RepartitionByExpression"] + 2])
