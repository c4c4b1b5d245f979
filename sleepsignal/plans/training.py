"""Cross-validated training over tasks, and the comparison of two feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import cohort, compare, ml
from sleepsignal.session import cut


def run_training(
    features: DataFrame, cols: Sequence[str], tasks: Sequence[str] = ("control_vs_all",), methods: Sequence[str] = ("kfold",),
    models: dict[str, dict] | None = None, k: int = 5, seed: int = 42, imputer: str = "median", out: str | None = None, repeats: int = 0, **nested,
) -> tuple[DataFrame, DataFrame]:
    """Fold metrics and their summary for every (task, method); tables are written when ``out`` is given.

    With ``repeats``, each model is fitted once more on all rows of a task, and ``out`` gets the table of permutation
    importances (run_tag, feature, importance, std) that the stability and join operators read.

    Tasks are the binary tasks or ``multiclass``.  ``features`` needs ``id`` and ``group``.
    """
    models = models or ml.DEFAULTS
    folds = None
    for task in tasks:
        multi = task == "multiclass"
        data = cohort.make_labels(features, "multiclass" if multi else "binary", task)
        for method in methods:
            if method == "kfold":
                preds = ml.cross_validate(data, cols, models, k, seed, imputer)
            elif method == "nested":
                preds = ml.nested_cross_validate(data, cols, list(models), k, seed=seed, imputer=imputer, **nested)
            else:
                raise ValueError(f"unknown method {method!r}; use 'kfold' or 'nested'")
            m = compare.classification_metrics(preds, average="weighted" if multi else "binary")
            m = m.select(F.lit(task).alias("task"), F.lit(method).alias("method"), *m.columns)
            folds = m if folds is None else folds.unionByName(m)
            if out is not None:
                preds.write.mode("overwrite").parquet(f"{out}/predictions/task={task}/method={method}")
        if out is not None and repeats:
            importances(data, cols, models, task, seed, imputer, repeats, "weighted" if multi else "binary").write.mode("overwrite").parquet(f"{out}/importance/task={task}")
    folds = cut(folds)
    summary = compare.cv_summary(folds, ("task", "method", "model"))
    if out is not None:
        folds.write.mode("overwrite").parquet(f"{out}/folds")
        summary.write.mode("overwrite").parquet(f"{out}/summary")
    return folds, summary


def importances(
    data: DataFrame, cols: Sequence[str], models: dict[str, dict], task: str, seed: int = 42, imputer: str = "median", repeats: int = 3, average: str = "binary"
) -> DataFrame:
    """(run_tag, feature, importance, std) of every model refitted on all rows; a run is a task and a model."""
    rows = cut(ml.prepare_fold(data, data, cols, imputer)[0])
    out = None
    for name, params in models.items():
        model = ml.fit(rows, cols, name, params, seed)
        p = ml.permutation_importance(model, rows, cols, name, repeats, seed, average)
        p = p.select(F.lit(f"{task} {name}").alias("run_tag"), "feature", F.col("mean").alias("importance"), "std")
        out = p if out is None else out.unionByName(p)
    return out


def compare_models(
    data: DataFrame, cols_1: Sequence[str], cols_2: Sequence[str] | None = None, models: dict[str, dict] | None = None, k: int = 5,
    seed: int = 42, imputer: str = "median", n_boot: int = 10_000,
) -> DataFrame:
    """Same folds, two feature sets: pooled AUCs of each classifier and the paired bootstrap of their difference.

    Without ``cols_2`` the second set is the clinical baseline columns that are present.
    """
    if cols_2 is None:
        wanted = [*cohort.SPECTRAL_BASELINE, *cohort.MACRO_BASELINE]
        cols_2 = [c for c in wanted if c in data.columns]
    models = models or {m: ml.DEFAULTS[m] for m in ("Logistic Regression", "Random Forest", "Boosted Trees")}
    d = cut(compare.stratified_folds(data, k, seed))
    score = lambda cols: ml.cross_validate(d, cols, models, k, seed, imputer).filter(F.col("probs").isNotNull()).select("model", "id", "y_true", F.col("probs")[1].alias("s"))
    both = cut(score(cols_1).withColumnRenamed("s", "score_a").join(score(cols_2).select("model", "id", F.col("s").alias("score_b")), ["model", "id"]))
    out = None
    for name in models:
        r = compare.bootstrap_auc(both.filter(F.col("model") == name), "score_a", "score_b", n_boot, seed).select(F.lit(name).alias("model"), "*")
        out = r if out is None else out.unionByName(r)
    return out
