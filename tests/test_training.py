"""Tuning without a leak, and importances that single out the column that matters."""

import numpy as np
import pandas as pd

from sleepsignal.catalog import studies
from sleepsignal.operators import forest, ml, report
from sleepsignal.plans import training


def data(spark, n=120, prefix="s"):
    rng = np.random.default_rng(2)
    y = np.arange(n) % 2
    pdf = pd.DataFrame({"id": [f"{prefix}{i}" if prefix else i for i in range(n)], "y": y, "a": y * 4 + rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    pdf.loc[::17, "b"] = np.nan
    return spark.createDataFrame(pdf)


def test_permutation_importance(spark, tmp_path):
    d = data(spark)
    table = training.importances(d, ["a", "b", "c"], {"Logistic Regression": {}, "SVM": {}}, "task", repeats=2)
    rows = {(r["run_tag"], r["feature"]): r for r in table.collect()}
    assert len(rows) == 6
    for run in ("task Logistic Regression", "task SVM"):
        assert rows[run, "a"]["importance"] > 0.3 and all(abs(rows[run, c]["importance"]) < 0.1 for c in "bc") and rows[run, "a"]["std"] >= 0
    again = training.importances(d.repartition(5), ["a", "b", "c"], {"SVM": {}}, "task", repeats=2).collect()
    assert all(abs(r["importance"] - rows[r["run_tag"], r["feature"]]["importance"]) < 1e-9 for r in again)
    stable = report.importance_stability(table.select("feature", "run_tag", "importance")).orderBy("mean_rank").first()
    assert stable["feature"] == "a" and stable["mean_rank"] == 1.0


def test_inner_folds_are_prepared_on_their_own_rows(spark, monkeypatch):
    seen = []
    prepare = ml.prepare_fold
    monkeypatch.setattr(ml, "prepare_fold", lambda tr, va, *a: seen.append((tr.count(), va.count(), tr.join(va, "id").count(), tr.filter("b IS NULL").count())) or prepare(tr, va, *a))
    preds = ml.nested_cross_validate(data(spark, prefix=""), ["a", "b", "c"], ["Logistic Regression"], 2, 3, 2, spaces={"Logistic Regression": {"C": [0.1, 1.0]}})
    assert [s[:3] for s in seen] == [(60, 60, 0), *[(40, 20, 0)] * 3] * 2
    assert any(s[3] for s in seen[1:4])  # inner rows come as they are, holes and all
    assert preds.filter("model = 'Logistic Regression'").count() == 120
    assert preds.filter("model = 'Logistic Regression' AND y_true = y_pred").count() > 105


def test_a_deep_forest_is_grown_and_asked_in_groups(spark, monkeypatch):
    """Nine trees of unlimited depth over 120 rows, two to a group: all of them vote, and none is kept on the driver."""
    monkeypatch.setattr(ml, "NODES_AT_ONCE", 240)
    d = data(spark).fillna(0.0)
    forest = ml.fit(d, ["a", "b", "c"], "Random Forest", {"n_estimators": 9})
    assert [n for _, n in forest.groups] == [2, 2, 2, 2, 1]
    p = ml.predict(forest, d, "Random Forest").collect()
    assert len({r["id"] for r in p}) == 120 and all(abs(sum(r["probs"]) - 1) < 1e-9 and r["y_pred"] == int(r["probs"][1] > r["probs"][0]) for r in p)
    assert {round(r["probs"][1] * 9, 6) for r in p} <= {float(i) for i in range(10)} and sum(r["y_true"] == r["y_pred"] for r in p) > 110
    top = ml.mdi_importance(forest, spark, ["a", "b", "c"]).collect()
    assert top[0]["feature"] == "a" and abs(sum(r["importance"] for r in top) - 1) < 1e-9


def test_a_forest_of_many_rows_has_few_passes(spark, monkeypatch):
    """Nine deep trees over 120 rows, each grown in one task: all of them vote, and no level of a tree is a job of its own."""
    monkeypatch.setattr(ml, "MANY_ROWS", 100)
    d = data(spark).fillna(0.0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forest", "forest")
    grown = ml.fit(d, ["a", "b", "c"], "Random Forest", {"n_estimators": 9})
    jobs = len(tracker.getJobIdsForGroup("forest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert isinstance(grown, forest.Grown) and len(grown.cells) == 9 and 0 < jobs < 30
    p = ml.predict(grown, d, "Random Forest").collect()
    assert len(p) == 120 and all(abs(sum(r["probs"]) - 1) < 1e-9 and r["y_pred"] == int(r["probs"][1] > r["probs"][0]) for r in p)
    assert {round(r["probs"][1] * 9, 6) for r in p} <= {float(i) for i in range(10)} and sum(r["y_true"] == r["y_pred"] for r in p) > 110
    top = ml.mdi_importance(grown, spark, ["a", "b", "c"]).collect()
    assert top[0]["feature"] == "a" and abs(sum(r["importance"] for r in top) - 1) < 1e-9
    again = ml.predict(ml.fit(d, ["a", "b", "c"], "Random Forest", {"n_estimators": 9}), d, "Random Forest").collect()
    assert sorted(again) == sorted(p)


def test_large_nodes_are_split_by_histograms(spark):
    """Cells of at most 60 of 600 rows: every drawn row ends in one cell or leaf, and every row gets the vote of each tree."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int) + (x[:, 2] > 1)
    d = spark.createDataFrame(pd.DataFrame({"id": range(600), "y": y, **{f"x{i}": x[:, i] for i in range(5)}}))
    cols = [f"x{i}" for i in range(5)]
    w = ml.cut(ml.class_weights(d))
    whole, parts = (forest.grow(w, ml.VectorAssembler(inputCols=cols, outputCol="features"), 12, 30, 7, most=most) for most in (1000, 60))
    assert len(whole.cells) == 12 and len(parts.cells) > 60 and all(len(t.feature) > 3 for t in parts.tops)
    for grown in (whole, parts):
        p = ml.predict(grown, d, "Random Forest").collect()
        assert len({r["id"] for r in p}) == len(p) == 600 and all(len(r["probs"]) == 3 and abs(sum(r["probs"]) - 1) < 1e-9 for r in p)
        assert np.mean([r["y_true"] == r["y_pred"] for r in p]) > 0.97
        i = grown.importances()
        assert abs(i.sum() - 1) < 1e-9 and min(i[:3]) > max(i[3:])
    none = ml.predict(parts, d.limit(0), "Random Forest")
    assert none.count() == 0


def test_a_cell_is_the_tree_that_brute_force_gives():
    """One level, every feature tried: the split of least Gini impurity; and a deep tree tells all drawn rows apart."""
    rng = np.random.default_rng(3)
    x, y, times = rng.integers(0, 32, (80, 1)).astype(np.uint8), rng.integers(0, 3, 80).astype(np.uint8), rng.integers(1, 4, 80).astype(float)
    weight = np.array([1.0, 2.0, 0.5])
    tree = forest.grow_cell(x, y, times, weight, 1, 1, 0, 0)

    def impurity(at):
        total = 0.0
        for side in (x[:, 0] <= at, x[:, 0] > at):
            c = np.bincount(y[side], times[side], 3) * weight
            total += c.sum() - (c**2).sum() / c.sum() if c.sum() else np.inf
        return total

    assert tree.feature.tolist() == [0, -1, -1] and abs(impurity(tree.bin[0]) - min(map(impurity, range(31)))) < 1e-9
    x = np.arange(32, dtype=np.uint8)[:, None]
    deep = forest.grow_cell(x, y[:32], times[:32], weight, 30, 1, 0, 0)
    assert (deep.shares[deep.leaf_of(x)].argmax(axis=1) == y[:32]).all() and (deep.shares[deep.feature < 0].max(axis=1) == 1).all()


def test_kfold_query_runs_every_model(spark, monkeypatch):
    """The query hands all four models with their defaults to the cross-validation."""
    seen = []
    monkeypatch.setattr(ml, "cross_validate", lambda df, cols, models, **rest: seen.append((len(cols), models, rest)))
    studies.kfold_cv(spark, "/root/testdata/sf0.001")
    assert seen == [(64, ml.DEFAULTS, {"k": 5})] and len(ml.DEFAULTS) == 4


def test_comparison_query_runs_every_model(spark, monkeypatch):
    """All four models on both feature sets, with 10 000 resamples."""
    seen = []
    monkeypatch.setattr(training, "compare_models", lambda df, a, b, models, **rest: seen.append((len(a), len(b), models, rest)))
    studies.compare_models(spark, "/root/testdata/sf0.001")
    assert seen == [(64, 32, ml.DEFAULTS, {"k": 5, "n_boot": 10_000})]


def test_the_longest_fits_begin_first(spark, monkeypatch):
    """One fit at a time: boosted trees of all folds, then forests, then the rest; predictions keep the order of the models."""
    begun = []
    fit = ml.fit
    monkeypatch.setattr(ml, "fit", lambda tr, cols, name, *a: begun.append(name) or fit(tr, cols, "Logistic Regression", None, *a[1:]))
    names = ("Logistic Regression", "Random Forest", "Boosted Trees")
    p = ml.cross_validate(data(spark, 40, ""), ["a", "b", "c"], {name: {} for name in names}, k=2, parallelism=1)
    assert begun == [name for name in reversed(names) for _ in range(2)]
    assert {r["model"]: r["count"] for r in p.groupBy("model").count().collect()} == {"Baseline (majority)": 40, **dict.fromkeys(names, 40)}
