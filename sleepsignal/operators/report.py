"""Tables behind the cohort report: descriptions, histograms, box statistics, audits, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.functions.quantile import exact_quantiles
from sleepsignal.plans.chunked import join_salted

BOX = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def long_features(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(ids..., feature, value) with every feature cast to double."""
    d = df.select(*ids, *[F.col(f"`{n}`").cast("double").alias(n) for n in cols])
    return d.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{n}`") for n in cols], "feature", "value")


def describe_features(long: DataFrame) -> DataFrame:
    """count, mean, sample and population std, min, quartiles, max and NULL count per feature."""
    s = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"),
        F.round(F.stddev_pop("value"), 4).alias("std_pop"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    q = exact_quantiles(long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return s.join(q.select("feature", *[F.round(n, 4).alias(n) for n in ("p25", "p50", "p75")]), "feature", "left")


def histogram(long: DataFrame, keys: Sequence[str] = ("feature",), n_bins: int | None = None) -> DataFrame:
    """Equal-width bins, the last one closed; min(20, max(5, n // 3)) bins unless given.

    Groups with fewer than two values have no histogram.
    """
    keys = list(keys)
    v = long.filter(F.col("value").isNotNull())
    b = v.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")).filter("n >= 2")
    bins = F.lit(n_bins) if n_bins else F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 3)))
    b = b.withColumn("n_bins", bins.cast("int"))
    pos = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("n_bins"))
    at = F.coalesce(F.least(F.col("n_bins") - 1, pos), F.lit(0)).cast("int")
    counts = join_salted(v, b, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = b.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    step = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + step * F.col("bin")).alias("left"), (F.col("lo") + step * (F.col("bin") + 1)).alias("right"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def boxplot_stats(long: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR clipped to the data range, and number of outliers."""
    keys = list(keys)
    v = long.filter(F.col("value").isNotNull())
    q = exact_quantiles(v, keys, "value", BOX)
    r = v.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max")).join(q, keys)
    iqr = F.col("q3") - F.col("q1")
    r = r.withColumns({
        "whisker_lo": F.greatest("_min", F.col("q1") - iqr * 1.5), "whisker_hi": F.least("_max", F.col("q3") + iqr * 1.5)})
    out = join_salted(v, r.select(*keys, "whisker_lo", "whisker_hi"), keys).groupBy(*keys).agg(
        F.count_if(~F.col("value").between(F.col("whisker_lo"), F.col("whisker_hi"))).alias("n_outliers"))
    return r.drop("_min", "_max").join(out, keys)


def outliers(long: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    box = boxplot_stats(long, keys).select(*keys, "whisker_lo", "whisker_hi")
    return join_salted(long, box, keys).filter(~F.col("value").between(F.col("whisker_lo"), F.col("whisker_hi"))).drop("whisker_lo", "whisker_hi")


def group_distribution(long: DataFrame, group: str = "group") -> DataFrame:
    """Box statistics per feature and diagnostic group."""
    return boxplot_stats(long, ["feature", group])


def null_audit(long: DataFrame) -> DataFrame:
    """NULL count and percentage per feature."""
    n = F.count_if(F.col("value").isNull())
    return long.groupBy("feature").agg(n.alias("n_null"), F.round(n * 100.0 / F.count(F.lit(1)), 4).alias("pct_null"))


def null_audit_sessions(long: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Number and sorted names of missing features per session (bounded by the number of features)."""
    miss = F.collect_list(F.when(F.col("value").isNull(), F.col("feature")))
    return long.groupBy(subject).agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.array_join(F.array_sort(miss), ",").alias("missing"))


def rank_min(df: DataFrame, col: str, name: str, by: Sequence[str] = (), desc: bool = True) -> DataFrame:
    """Competition rank over the non-null values; NULL stays unranked.

    For tables with one row per feature and run.
    """
    order = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.rank().over(w).cast("long")))


def importance_stability(imp: DataFrame, top_k: int = 20) -> DataFrame:
    """Rank statistics of each feature over runs; frac_top_k divides by all runs."""
    r = rank_min(imp, "importance", "rank", ["run_tag"])
    runs = r.agg(F.count_distinct("run_tag").alias("_runs")).withColumn("_one", F.lit(1))
    in_top = F.count_if(F.col("rank") <= top_k)
    s = r.groupBy("feature").agg(
        F.count("rank").alias("n_runs"), F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"), F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"), F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"),
        in_top.alias("times_top_k"))
    s = s.join(exact_quantiles(r, ["feature"], "rank", {"median_rank": 0.5}), "feature", "left")
    return s.withColumn("_one", F.lit(1)).join(F.broadcast(runs), "_one").withColumn("frac_top_k", F.col("times_top_k") / F.col("_runs")).drop("_one", "_runs")


def sweep_runs(sweep: DataFrame, mode: str | None = None, model: str | None = None) -> DataFrame:
    """Successful runs of a sweep table, optionally of one mode and model."""
    ok = sweep.filter(F.col("status") == "ok")
    if mode is not None:
        ok = ok.filter(F.col("mode") == mode)
    return ok if model is None else ok.filter(F.col("best_model") == model)


def rank_matrix(imp: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """Feature by run table of ranks."""
    r = rank_min(imp, "importance", "rank", ["run_tag"])
    g = r.groupBy("feature")
    g = g.pivot("run_tag", list(runs)) if runs else g.pivot("run_tag")
    return g.agg(F.min("rank"))


def importance_join(stats: DataFrame, mdi: DataFrame | None = None, permutation: DataFrame | None = None) -> DataFrame:
    """Univariate table with importances and the rank of every metric."""
    m = stats
    if mdi is not None:
        m = m.join(mdi.select("feature", F.col("importance").alias("mdi")), "feature", "left")
        m = rank_min(m, "mdi", "rank_mdi")
    if permutation is not None:
        keep = [F.col("mean").alias("permutation")] + ([F.col("std").alias("permutation_std")] if "std" in permutation.columns else [])
        m = m.join(permutation.select("feature", *keep), "feature", "left")
        m = rank_min(m, "permutation", "rank_permutation")
    for col, name, desc in (("abs_cohens_d", "rank_abs_d", True), ("abs_cliffs_delta", "rank_abs_delta", True), ("auc", "rank_auc", True), ("p", "rank_p", False)):
        m = rank_min(m, col, name, desc=desc)
    return m


def rank_correlations(merged: DataFrame) -> DataFrame:
    """Spearman correlation of every pair of rank columns over complete rows (one row per feature)."""
    cols = [n for n in merged.columns if n.startswith("rank_")]
    full = merged.select(*cols).dropna()
    mids = full.select(*[
        (F.rank().over(Window.orderBy(n)) + (F.count(F.lit(1)).over(Window.partitionBy(n)) - 1) / 2).alias(n) for n in cols])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for a in cols for b in cols]
    return mids.agg(F.array(*pairs).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def effect_outer(tables: dict[str, DataFrame], metric: str = "abs_cliffs_delta") -> DataFrame:
    """One column per comparison and the largest effect of each feature."""
    out = None
    for label, t in tables.items():
        one = t.select("feature", F.col(metric).alias(label))
        out = one if out is None else out.join(one, "feature", "full")
    return out.withColumn("max_effect", F.greatest(*tables) if len(tables) > 1 else F.col(next(iter(tables))))


def top_abs(df: DataFrame, metric: str, n: int) -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).orderBy(F.abs(metric).desc(), "feature").limit(n)


def top_combined_rank(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("combined", F.col(x) + F.col(y))
    return d.orderBy("combined", "feature").limit(n)


def top_max_effect(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("max_effect").desc_nulls_last(), "feature").limit(n)


def top_per_group(long: DataFrame, group: str, metric: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(metric).desc_nulls_last(), "feature")
    return long.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= n)


def top_significant(df: DataFrame, n: int = 10) -> DataFrame:
    """Smallest p-values with -log10(p) and the significance flag after FDR."""
    d = df.filter(F.col("p").isNotNull()).withColumn("neg_log10_p", -F.log10(F.greatest("p", F.lit(1e-300))))
    return d.orderBy("p", "feature").limit(n)


def top_frequency(stability: DataFrame, n: int = 30) -> DataFrame:
    return stability.filter(F.col("frac_top_k") > 0).orderBy("median_rank", "feature").limit(n)


def sort_summary(summary: DataFrame, by: str = "balanced_accuracy_mean") -> DataFrame:
    return summary.orderBy(F.col(by).desc_nulls_last(), "model")


