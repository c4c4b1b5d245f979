"""Imputation, scaling, classifiers and cross-validation on pyspark.ml."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators import forest
from sleepsignal.operators.compare import classification_metrics, majority_baseline, stratified_folds
from sleepsignal.plans.chunked import join_salted, row_index, with_value_chunk
from sleepsignal.session import cut, run_folder

Scaler = dict[str, tuple[float, float]]
# Candidates of the hyper-parameter search.
SEARCH = {
    "Logistic Regression": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
    "SVM": {"C": [0.1, 1.0, 10.0, 100.0]},
    "Random Forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 3, 5, 10]},
    "Boosted Trees": {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 6, 8], "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.7, 0.8, 1.0]},
}
DEFAULTS = {
    "Logistic Regression": {"C": 1.0}, "SVM": {"C": 1.0}, "Random Forest": {"n_estimators": 100, "max_depth": None},
    "Boosted Trees": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0},
}
#: ``max_depth`` None means this deep, which is the deepest tree pyspark.ml can grow.
UNLIMITED_DEPTH = 30
#: Trees deeper than this can have a node per row; their forests are grown in groups, each written before the next.
SHALLOW = 10
#: Rows times trees of a group: a tree has about as many nodes as rows at most. A group has one tree at least.
NODES_AT_ONCE = 200_000
#: Deep forests of more rows are grown by ``forest.grow``: a pass per level over all nodes, as pyspark.ml makes it, takes a histogram for each node.
MANY_ROWS = 2_000
#: Rows of a solver's task at least.
ROWS_A_TASK = 20_000
#: Models by the time a fit takes, longest first.
LONGEST = ("Boosted Trees", "Random Forest", "SVM", "Logistic Regression")


def impute_simple(train: DataFrame, other: DataFrame, cols: Sequence[str], strategy: str = "mean") -> tuple[DataFrame, DataFrame]:
    """Fit on the training rows only; apply to both."""
    how = {"most_frequent": "mode"}.get(strategy, strategy)
    model = Imputer(strategy=how, inputCols=list(cols), outputCols=list(cols), relativeError=0.0001).fit(train)
    return model.transform(train), model.transform(other)


def impute_knn(rows: DataFrame, train: DataFrame, cols: Sequence[str], subject: str = "id", k: int = 5, block: int = 4096) -> DataFrame:
    """Missing cells become the mean of the k nearest training rows that have the value.

    Distance: root of the summed squares over features both rows have, scaled by
    total / shared features.  Rows and donors are cut into blocks that are paired block by
    block; each pair hands on only its k best donors per cell.  Cells without any
    comparable donor take the column mean.
    """
    cols = list(cols)
    need = rows.filter(" OR ".join(f"`{c}` IS NULL" for c in cols))
    n_rows, n_train = max(1, -(-need.count() // block)), max(1, -(-train.count() // block))
    block_of = lambda n: F.pmod(F.xxhash64(subject), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = need.select(subject, *cols, block_of(n_rows).alias("_a"), spread(n_train).alias("_b"))
    # Fresh names, because training rows are often the rows themselves.
    right = train.select(
        F.col(subject).alias("_donor"), *[F.col(c).alias(f"_d_{c}") for c in cols], block_of(n_train).alias("_rb"), spread(n_rows).alias("_ra"))
    kind = rows.schema[subject].dataType.simpleString()

    def best(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values("_donor")
        x, y = lp[cols].to_numpy(float), rp[[f"_d_{c}" for c in cols]].to_numpy(float)
        hx, hy = ~np.isnan(x), ~np.isnan(y)
        x0, y0 = np.where(hx, x, 0.0), np.where(hy, y, 0.0)
        shared = hx.astype(float) @ hy.T.astype(float)
        sq = (x0**2) @ hy.T - 2 * x0 @ y0.T + hx.astype(float) @ (y0**2).T
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.sqrt(np.maximum(sq, 0.0) * len(cols) / shared)
        dist[shared == 0] = np.inf
        out = []
        for j, c in enumerate(cols):
            who = np.flatnonzero(~hx[:, j])
            donors = np.flatnonzero(hy[:, j])
            if not len(who) or not len(donors):
                continue
            d = dist[np.ix_(who, donors)]
            pick = np.argsort(d, axis=1, kind="stable")[:, :k]
            for r, p in zip(who, pick):
                for q in p:
                    if np.isfinite(dist[r, donors[q]]):
                        out.append((lp[subject].iloc[r], c, float(dist[r, donors[q]]), rp["_donor"].iloc[donors[q]], float(y[donors[q], j])))
        return pd.DataFrame(out, columns=[subject, "feature", "dist", "donor", "value"])

    schema = f"{subject} {kind}, feature string, dist double, donor {kind}, value double"
    near = left.groupBy("_a", "_b").cogroup(right.groupBy("_ra", "_rb")).applyInPandas(best, schema)
    top = near.groupBy(subject, "feature").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "donor", "value"))), 1, k).alias("_t"))
    fill = top.select(subject, "feature", (F.aggregate("_t", F.lit(0.0), lambda a, t: a + t["value"]) / F.size("_t")).alias("_f"))
    wide = fill.groupBy(subject).agg(*[F.max(F.when(F.col("feature") == c, F.col("_f"))).alias(f"_f_{c}") for c in cols])
    means = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]).withColumn("_one", F.lit(1))
    out = rows.join(wide, subject, "left").withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")
    return out.select(*[F.coalesce(c, f"_f_{c}", f"_m_{c}").alias(c) if c in cols else F.col(c) for c in rows.columns])


def standardise(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """z-scores with the mean and population standard deviation of the training rows."""
    stats = train.agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]).withColumn("_one", F.lit(1))

    def apply(d: DataFrame) -> DataFrame:
        j = d.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
        z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(1.0))
        return j.select(*[z(c).alias(c) if c in set(cols) else F.col(c) for c in d.columns])

    return [apply(d) for d in (train, *others)]


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds ``weight`` = n / (classes * n of the class)."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    t = c.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
    w = c.withColumn("_one", F.lit(1)).join(F.broadcast(t), "_one").select(y, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return join_salted(df, w, [y])


def build(name: str, params: dict, seed: int, n_classes: int, total_weight: float):
    """Unfitted classifier on columns ``features``, ``y``, ``weight``."""
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    depth = lambda d: UNLIMITED_DEPTH if d is None else d
    if name == "Logistic Regression":
        return LogisticRegression(**common, maxIter=2000, tol=1e-4, standardization=False, regParam=1.0 / (params["C"] * total_weight), elasticNetParam=0.0)
    if name == "SVM":
        svc = LinearSVC(**common, maxIter=200, tol=1e-3, standardization=False, regParam=1.0 / (params["C"] * total_weight))
        return svc if n_classes == 2 else OneVsRest(classifier=svc, featuresCol="features", labelCol="y", weightCol="weight")
    if name == "Random Forest":
        return RandomForestClassifier(**common, numTrees=params["n_estimators"], maxDepth=depth(params["max_depth"]), seed=seed)
    if name == "Boosted Trees":
        gbt = GBTClassifier(
            featuresCol="features", labelCol="y", maxIter=params["n_estimators"], maxDepth=params["max_depth"], stepSize=params["learning_rate"],
            subsamplingRate=params.get("subsample", 1.0), seed=seed)
        return gbt if n_classes == 2 else OneVsRest(classifier=gbt, featuresCol="features", labelCol="y")
    raise ValueError(f"unknown model {name!r}; use one of {sorted(DEFAULTS)}")


@dataclass(frozen=True)
class Forest:
    """A random forest of deep trees, written group by group, so that the driver never holds more than a few trees."""

    groups: list[tuple[str, int]]  # path of the model, number of its trees
    parallelism: int

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``probability`` and ``prediction`` from the votes of all trees, added up in the order of the groups."""
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        out = run_folder(rows.sparkSession, "votes")

        def vote(g: int) -> None:
            p = PipelineModel.load(self.groups[g][0]).transform(rows)
            p.select("_row", F.lit(g).alias("g"), vector_to_array("rawPrediction").alias("v")).write.mode("append").parquet(f"{out}/g={g}")

        with ThreadPoolExecutor(self.parallelism) as pool:
            list(pool.map(vote, range(len(self.groups))))
        votes = rows.sparkSession.read.parquet(*[f"{out}/g={g}" for g in range(len(self.groups))])
        each = F.array_sort(F.collect_list(F.struct("g", "v")))
        add = lambda a, s: F.when(F.size(a) == 0, s["v"]).otherwise(F.zip_with(a, s["v"], lambda x, y: x + y))
        total = votes.groupBy("_row").agg(F.aggregate(each, F.array().cast("array<double>"), add).alias("_v"))
        size = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
        p = rows.join(total, "_row").withColumn("probability", F.transform("_v", lambda x: x / size))
        return p.withColumn("prediction", (F.array_position("_v", F.array_max("_v")) - 1).cast("double")).drop("_row", "_v")

    def importances(self) -> np.ndarray:
        """Mean over the trees of their scaled impurity importances."""
        total = sum(n for _, n in self.groups)
        return sum(PipelineModel.load(path).stages[-1].featureImportances.toArray() * (n / total) for path, n in self.groups)


def fit(train: DataFrame, cols: Sequence[str], name: str, params: dict | None = None, seed: int = 42, parallelism: int = 4) -> PipelineModel | Forest | forest.Grown:
    """Fit one classifier on prepared (imputed, scaled) rows."""
    w = class_weights(train)
    row = w.agg(F.sum("weight").alias("w"), F.count_distinct("y").alias("k"), F.count(F.lit(1)).alias("n")).first()
    params = {**DEFAULTS[name], **(params or {})}
    assemble = VectorAssembler(inputCols=list(cols), outputCol="features")
    if name == "Random Forest" and (params["max_depth"] is None or params["max_depth"] > SHALLOW):
        if row["n"] > MANY_ROWS:
            return forest.grow(cut(w), assemble, params["n_estimators"], UNLIMITED_DEPTH if params["max_depth"] is None else params["max_depth"], seed)
        return _grow(cut(w), assemble, params, seed, row["k"], row["w"], row["n"], parallelism)
    if name != "Random Forest" and params.get("subsample", 1.0) == 1.0:
        # Hundreds of short passes: few rows in many tasks cost more in tasks than in work. Draws of rows would depend on the tasks.
        w = w.coalesce(-(-row["n"] // ROWS_A_TASK) or 1)
    return Pipeline(stages=[assemble, build(name, params, seed, row["k"], row["w"])]).fit(w)


def _grow(w: DataFrame, assemble: VectorAssembler, params: dict, seed: int, n_classes: int, total_weight: float, n_rows: int, parallelism: int) -> Forest:
    """All trees of a forest in groups, a few groups at a time; a group's seed follows from the first of its trees."""
    trees = params["n_estimators"]
    most = max(1, min(-(-trees // parallelism), NODES_AT_ONCE // n_rows))
    starts = range(0, trees, most)
    folder = run_folder(w.sparkSession, "forest")

    def grow(first: int) -> tuple[str, int]:
        n, path = min(most, trees - first), f"{folder}/{first}"
        part = build("Random Forest", {**params, "n_estimators": n}, seed + first, n_classes, total_weight)
        Pipeline(stages=[assemble, part]).fit(w).write().save(path)
        return path, n

    with ThreadPoolExecutor(parallelism) as pool:
        return Forest(list(pool.map(grow, starts)), parallelism)


def predict(model: PipelineModel | Forest | forest.Grown, df: DataFrame, name: str) -> DataFrame:
    """(model, id, fold, y_true, y_pred, probs); margins stand in where a model has no probabilities."""
    p = model.transform(df)
    if isinstance(model, (Forest, forest.Grown)):
        probs = F.col("probability")
    elif "probability" in p.columns:
        probs = vector_to_array("probability")
    elif "rawPrediction" in p.columns:
        probs = vector_to_array("rawPrediction")
    else:
        probs = F.lit(None).cast("array<double>")
    fold = F.col("fold") if "fold" in df.columns else F.lit(0)
    return p.select(F.lit(name).alias("model"), "id", fold.cast("int").alias("fold"), F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), probs.alias("probs"))


def prepare_fold(train: DataFrame, val: DataFrame, cols: Sequence[str], imputer: str = "median") -> tuple[DataFrame, DataFrame]:
    """Impute and scale with statistics of the training rows."""
    if imputer == "knn":
        tr, va = impute_knn(train, train, cols), impute_knn(val, train, cols)
    else:
        tr, va = impute_simple(train, val, cols, imputer)
    a, b = standardise(tr, [va], cols)
    return a, b


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(
    df: DataFrame, cols: Sequence[str], models: dict[str, dict], k: int = 5, seed: int = 42, imputer: str = "median",
    tuner: Callable[[DataFrame], Callable[[str], dict]] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold predictions of every model and of the majority baseline.

    The fits of folds and models run ``parallelism`` at a time (one after another with a tuner, which runs its own fits
    so); rows stay in Spark. ``tuner`` gets a fold's training rows as they are, neither
    imputed nor scaled, and gives the function that chooses a model's parameters.
    """
    d = cut(df if "fold" in df.columns else stratified_folds(df, k, seed))
    parts = [majority_baseline(d).withColumn("probs", F.lit(None).cast("array<double>"))]

    def prepared(f: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        # Every solver iteration reads the prepared rows, so they are written once per fold.
        own = d.filter(F.col("fold") != f)
        return own, *map(cut, prepare_fold(own, d.filter(F.col("fold") == f), cols, imputer))

    def one(tr: DataFrame, va: DataFrame, name: str, params: dict) -> DataFrame:
        # Written at once: a plan of all fits would hold every model on the driver. A forest's groups take turns with the other fits.
        return cut(predict(fit(tr, cols, name, params, seed, 1 if tuner is None else parallelism), va, name))

    if tuner is None:
        with ThreadPoolExecutor(parallelism) as pool:
            folds = list(pool.map(prepared, range(k)))
            # The longest fits begin first, so that none is left to run alone; the parts keep the order of the models.
            jobs = {name: [pool.submit(one, tr, va, name, models[name]) for _, tr, va in folds] for name in sorted(models, key=LONGEST.index)}
            parts += [j.result() for name in models for j in jobs[name]]
    else:
        for own, tr, va in map(prepared, range(k)):
            choose = tuner(own)
            parts += [one(tr, va, name, choose(name)) for name in models]
    return cut(_union([p.select("model", "id", "fold", F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), "probs") for p in parts]))


def sample_params(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Distinct random candidates from a search space."""
    grid = [{}]
    for key, values in space.items():
        grid = [{**g, key: v} for g in grid for v in values]
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


def nested_cross_validate(
    df: DataFrame, cols: Sequence[str], models: Sequence[str], k_outer: int = 5, k_inner: int = 3, n_iter: int = 20, seed: int = 42,
    imputer: str = "median", spaces: dict | None = None, parallelism: int = 4,
) -> DataFrame:
    """Outer predictions of models tuned by balanced accuracy on inner folds of the outer training rows.

    Every inner fold is imputed and scaled with statistics of its own training rows, so no held-out row is seen by
    what prepares it. The fits of candidates and folds run ``parallelism`` at a time.
    """
    spaces = spaces or SEARCH

    def tuner(train: DataFrame) -> Callable[[str], dict]:
        inner = cut(stratified_folds(train.drop("fold"), k_inner, seed))
        folds = [tuple(map(cut, prepare_fold(inner.filter(F.col("fold") != f), inner.filter(F.col("fold") == f), cols, imputer))) for f in range(k_inner)]

        def score(name: str, params: dict, f: int) -> float:
            tr, va = folds[f]
            return classification_metrics(predict(fit(tr, cols, name, params, seed), va, name), ["fold"], "binary").first()["balanced_accuracy"]

        def choose(name: str) -> dict:
            candidates = sample_params(spaces[name], n_iter, seed)
            with ThreadPoolExecutor(parallelism) as pool:
                jobs = [[pool.submit(score, name, params, f) for f in range(k_inner)] for params in candidates]
                means = [sum(j.result() for j in js) / k_inner for js in jobs]
            return candidates[max(range(len(candidates)), key=means.__getitem__)]

        return choose

    return cross_validate(df, cols, {m: {} for m in models}, k_outer, seed, imputer, tuner)


def permutation_importance(
    model: PipelineModel | Forest | forest.Grown, df: DataFrame, cols: Sequence[str], name: str, repeats: int = 3, seed: int = 42, average: str = "binary", parallelism: int = 4
) -> DataFrame:
    """(feature, mean, std): balanced accuracy lost when one column is dealt anew among the rows, over ``repeats`` deals.

    ``df`` holds prepared rows with ids of their own. A deal orders the rows by a seeded hash of their id and gives each the
    value of the row at the same place in another such order; places are counted per chunk of hashes.
    """
    df = cut(df.withColumn("_all", F.lit(0)))
    spark = df.sparkSession
    score = lambda d: classification_metrics(predict(model, d, name), ["model"], average).first()["balanced_accuracy"]
    whole = score(df)

    def in_order(*salt: Column) -> DataFrame:
        d = df.withColumn("_h", F.xxhash64(F.lit(seed), *salt, "id"))
        return row_index(with_value_chunk(d, ["_all"], "_h", 64), ["_all"], ["_h", "id"], "_at")

    placed = cut(in_order().select("_at", *cols))

    def lost(c: str, r: int) -> float:
        return whole - score(in_order(F.lit(r), F.lit(c)).drop(c).join(placed.select("_at", c), "_at"))

    with ThreadPoolExecutor(parallelism) as pool:
        jobs = {c: [pool.submit(lost, c, r) for r in range(repeats)] for c in cols}
        rows = [(c, *_mean_std([j.result() for j in js])) for c, js in jobs.items()]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def _mean_std(x: Sequence[float]) -> tuple[float, float]:
    m = sum(x) / len(x)
    return float(m), float((sum((v - m) ** 2 for v in x) / len(x)) ** 0.5)


def mdi_importance(model: PipelineModel | Forest | forest.Grown, spark, cols: Sequence[str], top: int | None = None) -> DataFrame:
    """Impurity importance of each feature, largest first."""
    v = model.importances() if isinstance(model, (Forest, forest.Grown)) else model.stages[-1].featureImportances.toArray()
    d = spark.createDataFrame([(c, float(x)) for c, x in zip(cols, v)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return d if top is None else d.limit(top)


def pca_2d(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("id", "y")) -> tuple[DataFrame, list[float]]:
    """First two components of the scaled features and their share of the variance."""
    z = standardise(df, [], cols)[0]
    v = VectorAssembler(inputCols=list(cols), outputCol="features").transform(z)
    m = PCA(k=2, inputCol="features", outputCol="pc").fit(v)
    pc = vector_to_array("pc")
    return m.transform(v).select(*keep, pc[0].alias("pc1"), pc[1].alias("pc2")), [float(x) for x in m.explainedVariance]
