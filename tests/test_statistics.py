"""Distributions, tests and model comparison against published or brute-force values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sleepsignal.functions.distributions import _small_u, _small_u_by_table, beta_inc, exact_u_two_sided, norm_sf, shapiro_wilk, t_two_sided
from sleepsignal.operators import compare, ml, report, stats
from sleepsignal.plans import training


def test_known_probabilities():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-7)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert 2 * norm_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_shapiro_published_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)


def test_t_tail_keeps_its_digits_for_many_degrees():
    """Against the normal tail with the first terms of its expansion in 1 / df."""
    for t in (0.5, 2.0, 4.0):
        for df in (1e6, 1e9, 1e12):
            pdf = np.exp(-t * t / 2) / np.sqrt(2 * np.pi)
            want = 2 * (norm_sf(t) + pdf * (t**3 + t) / (4 * df))
            assert t_two_sided(t, df) == pytest.approx(want, rel=1e-9)
    assert t_two_sided(2.0, 999.9) == pytest.approx(t_two_sided(2.0, 1000.1), rel=1e-5)


@pytest.mark.parametrize("sizes", [(3, 4), (5, 6), (7, 12), (40, 6000)])
def test_shapiro_sums_over_all_values(spark, sizes):
    r = np.random.default_rng(sum(sizes))
    rows = [("s", "f", y, f"{y}-{i}", float(v)) for y, n in enumerate(sizes) for i, v in enumerate(r.exponential(1.0, n).round(2 if n < 100 else 9))]
    rows.append(("s", "f", 1, "x", None))
    got = {g["class"]: g for g in stats.shapiro_summary(spark.createDataFrame(rows, "split string, feature string, y int, subject_id string, value double")).collect()}
    for y, name in enumerate(("negative", "positive")):
        w, p = shapiro_wilk(np.array([v for _, _, k, _, v in rows if k == y and v is not None]))
        assert got[name]["n"] == sizes[y] and (got[name]["W"], got[name]["p"]) == pytest.approx((w, p), rel=1e-8, abs=1e-12)


@pytest.mark.parametrize("n,m", [(3, 4), (5, 4), (2, 7)])
def test_exact_u_by_enumeration(n, m):
    u = [sum(a > b for a in c for b in set(range(n + m)) - set(c)) for c in itertools.combinations(range(n + m), n)]
    for x in sorted(set(u)):
        big = max(x, n * m - x)
        want = min(1.0, 2 * sum(v >= big for v in u) / len(u))
        assert exact_u_two_sided(x, n, m) == pytest.approx(want)


def test_exact_u_in_closed_form_and_by_table_agree():
    for n, m in ((1, 9), (2, 40), (5, 31), (7, 30), (8, 25)):
        for s in range(0, n * m + 1, 3):
            assert _small_u(s, n, m) == _small_u_by_table(s, n, m)
        assert _small_u(n * m, n, m) == math.comb(n + m, n)


def test_exact_u_against_ten_million():
    n, m = 8, 10**7
    sd = math.sqrt(n * m * (n + m + 1) / 12)
    assert exact_u_two_sided(0, n, m) == pytest.approx(2 / math.comb(n + m, n))
    assert exact_u_two_sided(n * m / 2, n, m) == 1.0
    for z in (0.5, 1.0, 2.0):
        assert exact_u_two_sided(round(n * m / 2 + z * sd), n, m) == pytest.approx(2 * norm_sf(z), abs=0.01)
    # with the other sample that large, U / m is a sum of n uniform numbers
    small = 0.5
    assert exact_u_two_sided(int(small * m), n, m) == pytest.approx(2 * small**n / math.factorial(n), rel=1e-4)
    with pytest.raises(ValueError, match="asymptotic"):
        exact_u_two_sided(5, 1000, 10**6)


def test_normality_and_places_with_half_zeros(spark):
    """A value that half of a class shares changes nothing in W; the places are those of the sorted values."""
    r = np.random.default_rng(8)
    v = np.concatenate([np.zeros(1500), r.normal(0, 1, 1500)])
    df = spark.createDataFrame([("s", "f", 1, f"p{i}", float(x)) for i, x in enumerate(v)], "split string, feature string, y int, subject_id string, value double")
    (got,) = stats.shapiro_summary(df).collect()
    assert (got["W"], got["p"]) == pytest.approx(shapiro_wilk(v), rel=1e-8, abs=1e-12)
    points = sorted((q["i"], q["ordered"]) for q in stats.qq_points(df).collect())
    assert [i for i, _ in points] == list(range(3000)) and np.allclose([x for _, x in points], np.sort(v))


@pytest.fixture(scope="module")
def oof(spark):
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 60)
    return pd.DataFrame({"id": np.arange(60), "y_true": y, "a": (y + r.normal(0, 1, 60)).round(1), "b": r.normal(0, 1, 60).round(1)})


def test_delong_equals_all_pairs(spark, oof):
    got = compare.delong_test(spark.createDataFrame(oof), "a", "b").first()

    def parts(c):
        p, n = oof[c][oof.y_true == 1].to_numpy(), oof[c][oof.y_true == 0].to_numpy()
        psi = (p[:, None] > n) + 0.5 * (p[:, None] == n)
        return psi.mean(), psi.mean(axis=1), psi.mean(axis=0)

    (ua, a1, a0), (ub, b1, b0) = parts("a"), parts("b")
    va, vb = a1.var(ddof=1) / len(a1) + a0.var(ddof=1) / len(a0), b1.var(ddof=1) / len(b1) + b0.var(ddof=1) / len(b0)
    cov = np.cov(a1, b1)[0, 1] / len(a1) + np.cov(a0, b0)[0, 1] / len(a0)
    z = (ua - ub) / math.sqrt(va + vb - 2 * cov)
    for k, v in {"auc_a": ua, "auc_b": ub, "var_a": va, "var_b": vb, "cov_ab": cov, "z": z, "p_value": 2 * norm_sf(abs(z))}.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_bootstrap_is_paired_and_repeatable(spark, oof):
    d = spark.createDataFrame(oof)
    w = compare.bootstrap_weights(compare.numbered(d), 20).groupBy("replicate").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()
    assert (w["n"] == 60).all() and 30 < w["k"].mean() < 46
    same = compare.bootstrap_deltas(d.withColumn("b", F.col("a")), "a", "b", 20).toPandas()
    assert np.allclose(same["delta"], 0)


def test_folds_are_balanced(spark):
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "y": [0] * 150 + [1] * 50}))
    n = compare.stratified_folds(d, 5).groupBy("fold", "y").count().toPandas()
    assert set(n[n.y == 0]["count"]) == {30} and set(n[n.y == 1]["count"]) == {10}


def test_bh_is_never_below_p_and_matches_hand_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    d = spark.createDataFrame([("s", f"f{i}", v) for i, v in enumerate(p)], "split string, feature string, p double")
    q = {r["feature"]: r["p_bh_fdr"] for r in stats.bh_fdr(d).collect()}
    assert [q[f"f{i}"] for i in range(5)] == [pytest.approx(0.02), pytest.approx(0.04), pytest.approx(0.04), pytest.approx(0.02), None]


def test_univariate_small_groups_and_label_swap(spark):
    rows = [("f", g, float(v)) for g, vs in (("iRBD", [1, 2, 5, 9]), ("Control", [2, 3, 4])) for v in vs] + [("g", "iRBD", 1.0), ("g", "Control", 2.0)]
    long = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "subject_id string, feature string, group string, value double")
    t = {r["feature"]: r for r in stats.univariate_table(stats.binary_split(long, {"s": (("iRBD",), ("Control",))})).collect()}
    u = {r["feature"]: r for r in stats.univariate_table(stats.binary_split(long, {"s": (("Control",), ("iRBD",))})).collect()}
    assert t["g"]["test"] == "n/a" and t["g"]["p"] is None
    assert t["f"]["auc"] == pytest.approx(u["f"]["auc"]) and t["f"]["cliffs_delta"] == pytest.approx(-u["f"]["cliffs_delta"])


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_imputation_by_brute_force(spark, block):
    r = np.random.default_rng(9)
    x = r.normal(size=(40, 4)).round(3)
    x[r.random(x.shape) < 0.25] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(40))
    d = spark.createDataFrame(pdf)
    d = d.select("id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abcd"])
    got = ml.impute_knn(d, d, list("abcd"), block=block).toPandas().sort_values("id")[list("abcd")].to_numpy(float)
    want = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        cand = []
        for q in range(40):
            both = ~np.isnan(x[i]) & ~np.isnan(x[q])
            if not np.isnan(x[q, j]) and both.any():
                cand.append((math.sqrt(((x[i] - x[q])[both] ** 2).sum() * 4 / both.sum()), q))
        top = [x[q, j] for _, q in sorted(cand)[:5]]
        want[i, j] = np.mean(top) if top else np.nanmean(x[:, j])
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_cross_validation_learns_a_separable_class(spark):
    r = np.random.default_rng(11)
    y = np.arange(90) % 2
    pdf = pd.DataFrame({"id": np.arange(90), "y": y, "a": y * 4 + r.normal(size=90), "b": r.normal(size=90)})
    preds = ml.cross_validate(spark.createDataFrame(pdf), ["a", "b"], {"Logistic Regression": {}}, k=3)
    m = {x["model"]: x for x in compare.cv_summary(compare.classification_metrics(preds)).collect()}
    assert m["Logistic Regression"]["balanced_accuracy_mean"] > 0.9 and m["Baseline (majority)"]["balanced_accuracy_mean"] == 0.5
    assert preds.filter("model = 'Logistic Regression'").count() == 90


def test_histogram_edges(spark):
    d = spark.createDataFrame([("f", float(v)) for v in range(11)] + [("one", 1.0), ("flat", 2.0), ("flat", 2.0)], "feature string, value double")
    h = report.histogram(d).toPandas()
    assert set(h.feature) == {"f", "flat"}
    f = h[h.feature == "f"].sort_values("bin")
    assert f["count"].tolist() == [2, 2, 2, 2, 3] and f["left"].iloc[0] == 0.0 and f["right"].iloc[-1] == 10.0
    assert h[h.feature == "flat"]["count"].sum() == 2


def test_training_writes_fold_and_summary_tables(spark, tmp_path):
    r = np.random.default_rng(12)
    g = np.array(["Control", "iRBD", "PD(-RBD)"])[np.arange(60) % 3]
    x = (g == "iRBD") * 3 + r.normal(size=60)
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "group": g, "a": np.where(np.arange(60) % 7 == 0, np.nan, x), "b": r.normal(size=60)}))
    d = d.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    out = str(tmp_path)
    folds, summary = training.run_training(d, ["a", "b"], ("control_vs_irbd",), ("kfold",), {"Logistic Regression": {}}, k=2, out=out, repeats=1)
    assert sorted(r["feature"] for r in spark.read.parquet(f"{out}/importance").filter("task = 'control_vs_irbd'").collect()) == ["a", "b"]
    assert folds.count() == 4 and summary.columns[:3] == ["task", "method", "model"]
    assert spark.read.parquet(f"{out}/predictions").filter("model = 'Logistic Regression'").count() == 40
    assert summary.first()["model"] == "Logistic Regression" and spark.read.parquet(f"{out}/summary").count() == 2
    with pytest.raises(ValueError, match="unknown task"):
        training.run_training(d, ["a"], ("nope",))
