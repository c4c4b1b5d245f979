"""Model comparison: ROC, DeLong, paired bootstrap, and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.functions.distributions import normal_two_sided
from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.functions.ranks import cumulative_counts, rank_sums, value_counts
from sleepsignal.operators.resample import PRIME, replicate_aucs
from sleepsignal.plans.chunked import CHUNK, join_salted, row_index, with_value_chunk
from sleepsignal.session import cut



def check_aligned(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    """Counts of ids missing on either side and of labels that differ."""
    j = a.select(on, F.col("y_true").alias("_a")).join(b.select(on, F.col("y_true").alias("_b")), on, "full")
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_mismatch"))


def long_scores(oof: DataFrame, scores: Sequence[str], keep: Sequence[str] = ("id", "y_true")) -> DataFrame:
    cells = [F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores]
    return oof.select(*keep, F.explode(F.array(*cells)).alias("_s")).select(*keep, "_s.*")


def delong_components(long: DataFrame) -> DataFrame:
    """Structural component of every prediction: share of the other class it outranks, ties one half.

    Comes from counts per distinct score, so the cost is one sort instead of all pairs.
    """
    cum = cumulative_counts(value_counts(long, ["model"], "score", "y_true"), ["model"])
    tot = cum.groupBy("model").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    c = cum.join(tot, "model").select(
        "model", F.col("_v").alias("score"), ((F.col("_cneg") - F.col("_neg") / F.lit(2.0)) / F.col("_n")).alias("_v10"),
        (1 - (F.col("_cpos") - F.col("_pos") / F.lit(2.0)) / F.col("_p")).alias("_v01"))
    return long.join(c, ["model", "score"]).select(
        "model", "id", "y_true", F.when(F.col("y_true") == 1, F.col("_v10")).otherwise(F.col("_v01")).alias("component"))


def delong_test(oof: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """AUCs, variances, covariance, z, two-sided p and confidence intervals of two models."""
    comp = delong_components(long_scores(oof, [a, b]))
    wide = comp.groupBy("id", "y_true").agg(
        F.max(F.when(F.col("model") == a, F.col("component"))).alias("ca"), F.max(F.when(F.col("model") == b, F.col("component"))).alias("cb"))
    one, zero = F.col("y_true") == 1, F.col("y_true") == 0
    pick = lambda c, k: F.when(k, F.col(c))
    s = wide.agg(
        F.count_if(one).alias("m"), F.count_if(zero).alias("n"), F.avg(pick("ca", one)).alias("auc_a"), F.avg(pick("cb", one)).alias("auc_b"),
        F.var_samp(pick("ca", one)).alias("a1"), F.var_samp(pick("ca", zero)).alias("a0"), F.var_samp(pick("cb", one)).alias("b1"),
        F.var_samp(pick("cb", zero)).alias("b0"), F.covar_samp(pick("ca", one), pick("cb", one)).alias("c1"),
        F.covar_samp(pick("ca", zero), pick("cb", zero)).alias("c0"))
    s = s.select(
        "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("auc_diff"), (F.col("a1") / F.col("m") + F.col("a0") / F.col("n")).alias("var_a"),
        (F.col("b1") / F.col("m") + F.col("b0") / F.col("n")).alias("var_b"), (F.col("c1") / F.col("m") + F.col("c0") / F.col("n")).alias("cov_ab"))
    se = F.sqrt(F.greatest(F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"), F.lit(0.0)))
    s = s.withColumn("z", F.coalesce(F.col("auc_diff") / F.nullif(se, F.lit(0.0)), F.lit(0.0))).withColumn("p_value", normal_two_sided("z"))
    crit = NormalDist().inv_cdf(1 - alpha / 2)
    ends = {f"ci_{m}_{side}": F.col(f"auc_{m}") + sign * crit * F.sqrt(f"var_{m}") for m in ("a", "b") for side, sign in (("lower", -1), ("upper", 1))}
    return s.withColumns(ends).withColumn("significant", F.col("p_value") < alpha)


def draw(i: Column, b: Column, n: Column, seed: int) -> Column:
    """Index drawn at position i of replicate b: a quadratic generator over a prime field, modulo n."""
    x = F.pmod((i + 1) * F.lit(48271).cast("long") + (b + 1) * F.lit(69621).cast("long") + F.lit(seed), F.lit(PRIME))
    y = F.pmod(x * x + F.lit(seed + 12345), F.lit(PRIME))
    return F.pmod(F.pmod(y * y + x, F.lit(PRIME)), n)


def numbered(oof: DataFrame) -> DataFrame:
    """Predictions with a 0-based number by id and the total."""
    d = oof.withColumn("_all", F.lit(0))
    n = d.groupBy("_all").agg(F.count(F.lit(1)).alias("n"))
    return row_index(with_value_chunk(d, ["_all"], "id"), ["_all"], ["id"], "i").drop(CHUNK).join(F.broadcast(n), "_all").drop("_all")


def bootstrap_weights(num: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """How often each subject is drawn in each replicate: (replicate, i, w)."""
    d = num.select("i", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("replicate"))
    return d.groupBy("replicate", draw(F.col("i"), F.col("replicate"), F.col("n"), seed).alias("i")).agg(F.count(F.lit(1)).alias("w"))


def bootstrap_deltas(oof: DataFrame, a: str, b: str, n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """AUC of both models in every paired resample; replicates without both classes are NULL."""
    num = cut(numbered(oof))
    first = num.select("n").first()
    if first is None:
        return num.sparkSession.createDataFrame([], "replicate long, auc_1 double, auc_2 double, delta double")
    auc = replicate_aucs(num.select("i", "y_true", F.col(a).alias("_a"), F.col(b).alias("_b")), ["_a", "_b"], first["n"], n_boot, seed)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("auc")))
    return auc.groupBy("replicate").agg(pick(0).alias("auc_1"), pick(1).alias("auc_2")).withColumn("delta", F.col("auc_1") - F.col("auc_2"))


def bootstrap_auc(oof: DataFrame, a: str, b: str, n_boot: int = 10_000, seed: int = 42, deltas: DataFrame | None = None) -> DataFrame:
    """Observed AUCs, their difference, share of resamples with delta <= 0 and the 95 % interval."""
    # One row per replicate, read by the share and by both passes of the quantiles.
    d = cut(bootstrap_deltas(oof, a, b, n_boot, seed) if deltas is None else deltas).withColumn("_all", F.lit(0))
    obs = rank_sums(long_scores(oof, [a, b]), ["model"], "score", "y_true").withColumn("_all", F.lit(0)).groupBy("_all").agg(
        F.max(F.when(F.col("model") == a, F.col("auc"))).alias("auc_1"), F.max(F.when(F.col("model") == b, F.col("auc"))).alias("auc_2"))
    p = d.groupBy("_all").agg(F.avg((F.col("delta") <= 0).cast("int")).alias("p_value"))
    ci = exact_quantiles(d, ["_all"], "delta", {"ci_lower": 0.025, "ci_upper": 0.975})
    return obs.join(p, "_all").join(ci, "_all").select("auc_1", "auc_2", (F.col("auc_1") - F.col("auc_2")).alias("delta_auc"), "p_value", "ci_lower", "ci_upper")


def macro_auc(long: DataFrame, keys: Sequence[str] = ("model",), weight: str | None = None) -> DataFrame:
    """Macro one-vs-rest AUC; rows carry the true class and ``probs`` by class."""
    cols = [*keys, "y_true"] + ([weight] if weight else [])
    each = long.select(*cols, F.posexplode("probs").alias("class", "score")).withColumn("hit", (F.col("y_true") == F.col("class")).cast("int"))
    return rank_sums(each, [*keys, "class"], "score", "hit", weight).groupBy(*keys).agg(F.avg("auc").alias("auc"))


def roc_curve(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One point per distinct score, from the highest down: threshold, fpr, tpr."""
    keys = list(keys)
    cum = cumulative_counts(value_counts(long, keys, "score", "y_true"), keys)
    tot = cum.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    at_least = lambda c, own, total: F.col(total) - F.col(c) + F.col(own)
    return cum.join(tot, keys).select(
        *keys, F.col("_v").alias("threshold"), (at_least("_cneg", "_neg", "_n") / F.nullif(F.col("_n"), F.lit(0))).alias("fpr"),
        (at_least("_cpos", "_pos", "_p") / F.nullif(F.col("_p"), F.lit(0))).alias("tpr"))


def roc_auc(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return rank_sums(long, keys, "score", "y_true").select(*keys, "n_pos", "n_neg", "auc")


def one_vs_rest(pred: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Long (model, class, y_true, score) from true class and probability array."""
    cells = [F.struct(F.lit(k).alias("class"), (F.col("y_true") == k).cast("int").alias("y"), F.col("probs")[i].alias("score")) for i, k in enumerate(classes)]
    return pred.select("model", F.explode(F.array(*cells)).alias("_s")).select("model", "_s.class", F.col("_s.y").alias("y_true"), "_s.score")


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts per (true, predicted) and their share of the true class."""
    c = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y_true")))


def classification_metrics(pred: DataFrame, keys: Sequence[str] = ("model", "fold"), average: str = "binary") -> DataFrame:
    """accuracy, balanced accuracy, F1, precision, recall; a zero denominator counts as 0.

    ``binary`` scores class 1; ``weighted`` averages the classes by their support.
    """
    keys = list(keys)
    c = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(*keys, "n", F.explode(F.array(
        F.struct(F.col("y_true").cast("int").alias("k"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("h")),
        F.struct(F.col("y_pred").cast("int").alias("k"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("_s")).select(*keys, "n", "_s.*")
    per = sides.groupBy(*keys, "k").agg(F.sum(F.col("n") * F.col("t")).alias("sup"), F.sum(F.col("n") * F.col("q")).alias("prd"), F.sum(F.col("n") * F.col("h")).alias("hit"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = per.withColumns({"prec": div(F.col("hit"), F.col("prd")), "rec": div(F.col("hit"), F.col("sup")), "f": div(2 * F.col("hit"), F.col("sup") + F.col("prd"))})
    if average == "binary":
        score = lambda x: F.coalesce(F.max(F.when(F.col("k") == 1, F.col(x))), F.lit(0.0))
    else:
        score = lambda x: F.sum(F.col(x) * F.col("sup")) / F.sum("sup")
    return per.groupBy(*keys).agg(
        (F.sum("hit") / F.sum("sup")).alias("accuracy"), F.avg(F.when(F.col("sup") > 0, F.col("rec"))).alias("balanced_accuracy"),
        score("f").alias("f1"), score("prec").alias("precision"), score("rec").alias("recall"))


METRICS = ("accuracy", "balanced_accuracy", "f1", "precision", "recall")


def cv_summary(folds: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and sample std of every metric per model, best balanced accuracy first."""
    aggs = [a for m in METRICS for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return folds.groupBy(*keys).agg(*aggs).orderBy(F.desc("balanced_accuracy_mean"), *keys)


def task_table(summary: DataFrame, metric: str = "balanced_accuracy_mean") -> DataFrame:
    """Models by tasks."""
    return summary.groupBy("model").pivot("task").agg(F.first(metric))


def probability_strip(pred: DataFrame, binary: bool = True) -> DataFrame:
    """Plotted probability of every subject with its class size."""
    p = F.col("probs")[1] if binary else F.array_max("probs")
    n = pred.groupBy("model", "y_true").agg(F.count(F.lit(1)).alias("n_class"))
    return join_salted(pred, n, ["model", "y_true"]).select("model", "id", "y_true", p.alias("prob"), "n_class")


def stratified_folds(df: DataFrame, k: int, seed: int = 42, y: str = "y", subject: str = "id") -> DataFrame:
    """Shuffled folds of equal class mix: rank by a seeded draw inside the class, modulo k."""
    s = F.pmod(F.col(subject) * F.lit(48271).cast("long") + F.lit(seed), F.lit(PRIME))
    d = df.withColumn("_r", F.pmod(s * s + F.lit(seed), F.lit(PRIME)))
    r = row_index(with_value_chunk(d, [y], "_r"), [y], ["_r", subject], "_i").drop(CHUNK, "_r")
    return r.withColumn("fold", F.pmod("_i", F.lit(k)).cast("int")).drop("_i")


def majority_baseline(df: DataFrame, y: str = "y") -> DataFrame:
    """For each fold the most common class of the other folds as prediction (smallest class on ties)."""
    c = df.groupBy("fold", y).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    total = c.groupBy(y, "_one").agg(F.sum("n").alias("_t"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("_m"))
    folds = c.groupBy("_one").agg(F.collect_set("fold").alias("_f"))
    per = total.join(folds, "_one").withColumn("val", F.explode("_f")).withColumn("n", F.col("_t") - F.coalesce(F.try_element_at("_m", F.col("val")), F.lit(0)))
    best = per.groupBy(F.col("val").alias("fold")).agg(F.max_by(y, F.struct("n", -F.col(y))).alias("y_pred"))
    return join_salted(df, best, ["fold"]).select(F.lit("Baseline (majority)").alias("model"), "fold", "id", F.col(y).alias("y_true"), "y_pred")
