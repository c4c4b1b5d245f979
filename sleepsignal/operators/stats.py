"""Univariate statistics on the long table (split, feature, y, value): one job for all features and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.functions.distributions import exact_u, normal_ppf, normal_two_sided, shapiro_from_sums, student_two_sided
from sleepsignal.functions.ranks import rank_sums
from sleepsignal.plans.chunked import CHUNK, row_index_and_total, with_value_chunk

KEYS = ("split", "feature")
# The standing comparisons, positive groups against negative groups.
SPLITS = {
    "control_vs_irbd": (("iRBD",), ("Control",)),
    "control_vs_pdrbd": (("PD(+RBD)",), ("Control",)),
    "control_vs_all": (("iRBD", "PD(+RBD)"), ("Control",)),
}
EXACT_MAX = 8  # fixed value: the published limit up to which ``auto`` takes the exact test


def binary_split(long: DataFrame, splits: dict = SPLITS, group: str = "group") -> DataFrame:
    """Rows of every split they belong to, with y = 1 / 0.

    An empty tuple of negative groups means one against the rest.
    """
    parts = []
    for name, (pos, neg) in splits.items():
        y = F.when(F.col(group).isin(*pos), 1).when(F.col(group).isin(*neg) if neg else F.lit(True), 0)
        parts.append(F.when(y.isNotNull(), F.struct(F.lit(name).alias("split"), y.alias("y"))))
    return long.withColumn("_s", F.explode(F.array_compact(F.array(*parts)))).select("_s.*", *long.columns)


def moments(labelled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    side = lambda k: F.when(F.col("y") == k, F.col("value"))
    return labelled.groupBy(*keys).agg(
        F.count(side(1)).alias("n_pos"), F.count(side(0)).alias("n_neg"), F.avg(side(1)).alias("mean_pos"), F.avg(side(0)).alias("mean_neg"),
        F.var_samp(side(1)).alias("var_pos"), F.var_samp(side(0)).alias("var_neg"))


def _enough() -> Column:
    return (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)


def cohens_d() -> Column:
    """Pooled-sd difference from the columns of ``moments``; NULL for small groups or no spread."""
    n1, n0 = F.col("n_pos"), F.col("n_neg")
    pooled = F.sqrt(((n1 - 1) * F.col("var_pos") + (n0 - 1) * F.col("var_neg")) / (n1 + n0 - 2))
    return F.when(_enough(), (F.col("mean_pos") - F.col("mean_neg")) / F.nullif(pooled, F.lit(0.0)))


def cliffs_delta() -> Column:
    return 2 * F.col("auc_pos") - 1


def feature_auc() -> Column:
    return F.greatest(F.col("auc_pos"), 1 - F.col("auc_pos"))


def _steps(x: Column, limits: Sequence[tuple[float, str]], last: str) -> Column:
    a = F.abs(x)
    out = F.when(x.isNull(), "n/a")
    for limit, word in limits:
        out = out.when(a < limit, word)
    return out.otherwise(last)


def interpret_d(d: Column) -> Column:
    return _steps(d, [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")], "large")


def interpret_cliffs(delta: Column) -> Column:
    return _steps(delta, [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")], "large")


def welch_t(m: DataFrame) -> DataFrame:
    """Adds t, df and the two-sided p of Welch's test to the moments."""
    a, b = F.col("var_pos") / F.col("n_pos"), F.col("var_neg") / F.col("n_neg")
    se2 = F.nullif(a + b, F.lit(0.0))
    t = F.when(_enough(), (F.col("mean_pos") - F.col("mean_neg")) / F.sqrt(se2))
    df = F.when(_enough(), se2 * se2 / (a * a / (F.col("n_pos") - 1) + b * b / (F.col("n_neg") - 1)))
    return m.withColumns({"t": t, "df": df}).withColumn("p_t", student_two_sided("t", "df"))


def mann_whitney(labelled: DataFrame, keys: Sequence[str] = KEYS, method: str = "auto") -> DataFrame:
    """U of the positives, z with tie and continuity correction, two-sided p, AUC.

    ``method``: ``asymptotic``; ``exact``, which fails on ties; ``auto`` is exact when one group has at most 8
    values and nothing is tied, else asymptotic, whatever the size of the other group.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"method must be auto, exact or asymptotic, not {method!r}")
    r = rank_sums(labelled, keys, "value", "y").withColumnRenamed("auc", "auc_pos")
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n0
    mu = n1 * n0 / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    big = F.greatest("u", n1 * n0 - F.col("u"))
    ok = (n1 >= 1) & (n0 >= 1)
    z = F.when(ok, (big - mu - 0.5) / F.nullif(sd, F.lit(0.0)))
    untied = F.col("tie_term") == 0
    small = {"auto": ok & (F.least(n1, n0) <= EXACT_MAX) & untied, "asymptotic": F.lit(False),
             "exact": ok & F.when(untied, True).otherwise(F.raise_error(F.lit("the exact test needs values without ties")).cast("boolean"))}[method]
    r = r.withColumns({"z_u": z, "_exact": small}).withColumns({
        "_pa": F.when(F.col("z_u") < 0, F.lit(1.0)).otherwise(normal_two_sided("z_u")),
        "_pe": exact_u(F.when(F.col("_exact"), F.col("u")), n1, n0)})
    return r.withColumn("p_u", F.when(F.col("_exact"), F.col("_pe")).otherwise(F.col("_pa"))).drop("_pa", "_pe", "_exact")


def bh_fdr(df: DataFrame, p: str = "p", by: Sequence[str] = ("split",), name: str = "p_bh_fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p; NULL p is ignored.  For tables with one row per feature."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col(p).asc_nulls_last(), "feature")
    m = F.count(p).over(w)
    d = df.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * m / F.row_number().over(order)))
    # The minimum over the larger p-values, taken as a running minimum from the other end.
    back = w.orderBy(F.col(p).desc_nulls_first(), F.col("feature").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min("_q").over(back), F.lit(1.0))
    return d.withColumn(name, F.when(F.col(p).isNotNull(), q)).drop("_q")


def _places(rows: DataFrame, keys: Sequence[str], subject: str, total: str) -> DataFrame:
    """Place ``i`` of each row in the order of values, from 0, and the number of rows; ties in the order of hashed subjects."""
    h = F.pmod(F.xxhash64(subject), F.lit(1 << 30)) / F.lit(float(1 << 30))
    v = with_value_chunk(rows.withColumn("_h", h), keys, "value", ties="_h")
    return row_index_and_total(v, keys, ["value", "_h", subject], "i", total).drop("_h")


def shapiro_summary(labelled: DataFrame, subject: str = "subject_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """W and p per class over all its values, from sums over the ordered values; no class is held in one task.

    ``subject`` breaks ties of the order and changes no result; a value repeated very often is dealt over many chunks by it.
    """
    keys = list(keys)
    all_keys = [*keys, "class"]
    cls = F.when(F.col("y") == 1, "positive").otherwise("negative")
    rows = labelled.withColumn("class", cls).select(*all_keys, subject, "value")
    counts = rows.groupBy(*all_keys).agg(F.count("value").alias("n"))
    r = _places(rows.filter(F.col("value").isNotNull()), all_keys, subject, "_n")
    r = r.withColumn("m", normal_ppf((F.col("i") + 0.625) / (F.col("_n") + 0.25)))
    at = lambda place, c="value": F.max(F.when(F.col("i") == place, F.col(c)))
    size = F.col("_n")
    s = r.groupBy(*all_keys).agg(
        F.sum(F.col("m") * F.col("m")).alias("ssq"), at(size - 1, "m").alias("m_last"), at(size - 2, "m").alias("m_second"),
        at(F.lit(0)).alias("x1"), at(F.lit(1)).alias("x2"), at(size - 2).alias("x3"), at(size - 1).alias("x4"),
        F.sum(F.when((F.col("i") >= 2) & (F.col("i") <= size - 3), F.col("m") * F.col("value"))).alias("inner"),
        (F.var_pop("value") * F.count("value")).alias("ss"))
    t = counts.join(s, all_keys, "left").withColumn("_t", shapiro_from_sums("n", "ssq", "m_last", "m_second", "x1", "x2", "x3", "x4", "inner", "ss"))
    value = lambda c: F.nanvl(F.col(f"_t.{c}"), F.lit(None).cast("double")).alias(c)
    return t.select(*all_keys, "n", value("W"), value("p")).withColumn("normal_at_0.05", F.col("p") >= 0.05)


def normality_overview(shapiro: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    flag = lambda c: F.bool_or(F.when(F.col("class") == c, F.col("`normal_at_0.05`")))
    o = shapiro.groupBy(*keys).agg(flag("positive").alias("positive"), flag("negative").alias("negative"))
    return o.withColumn("both_normal", F.coalesce(F.col("positive") & F.col("negative"), F.lit(False)))


def choose_test(shapiro: DataFrame, mode: str = "auto", keys: Sequence[str] = KEYS) -> DataFrame:
    """'t' when both classes pass the normality test, else 'u'."""
    keys_df = shapiro.groupBy(*keys).agg(F.min(F.coalesce(F.col("p") >= 0.05, F.lit(False)).cast("int")).alias("_ok"), F.count(F.lit(1)).alias("_c"))
    if mode in ("t", "u"):
        return keys_df.select(*keys, F.lit(mode).alias("chosen"))
    return keys_df.select(*keys, F.when((F.col("_ok") == 1) & (F.col("_c") == 2), "t").otherwise("u").alias("chosen"))


def univariate_table(labelled: DataFrame, mode: str = "auto", subject: str = "subject_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Test, effect sizes and FDR per feature; 'n/a' where a class has fewer than two values."""
    keys = list(keys)
    m = welch_t(moments(labelled, keys))
    u = mann_whitney(labelled, keys).drop("n_pos", "n_neg")
    m = m.join(u, keys, "left")
    if mode in ("t", "u"):
        m = m.withColumn("chosen", F.lit(mode))
    else:
        m = m.join(choose_test(shapiro_summary(labelled, subject, keys), mode, keys), keys, "left")
    ok, is_t = _enough(), F.col("chosen") == "t"
    d, delta, auc = cohens_d(), F.when(ok, cliffs_delta()), F.when(ok, feature_auc())
    r = m.select(
        *keys, F.when(~ok, "n/a").when(is_t, "welch_t").otherwise("mann_whitney_u").alias("test"),
        F.when(ok, F.when(is_t, F.col("t")).otherwise(F.col("u"))).alias("stat"), F.when(ok, F.when(is_t, F.col("p_t")).otherwise(F.col("p_u"))).alias("p"),
        d.alias("cohens_d"), F.abs(d).alias("abs_cohens_d"), F.when(ok, interpret_d(d)).alias("cohens_d_interpretation"),
        delta.alias("cliffs_delta"), F.abs(delta).alias("abs_cliffs_delta"), F.when(ok, interpret_cliffs(delta)).alias("cliffs_interpretation"),
        auc.alias("auc"), "n_pos", "n_neg")
    r = bh_fdr(r, "p", [k for k in keys if k != "feature"])
    return r.withColumn("significant_fdr_0.05", F.coalesce(F.col("p_bh_fdr") < 0.05, F.lit(False)))


def qq_points(labelled: DataFrame, subject: str = "subject_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordered values against normal order-statistic medians, per class."""
    all_keys = [*keys, "y"]
    v = labelled.filter(F.col("value").isNotNull()).select(*all_keys, subject, "value")
    r = _places(v, all_keys, subject, "n").drop(CHUNK)
    i, size = F.col("i") + 1, F.col("n")
    top = F.pow(F.lit(0.5), 1 / size)
    pos = F.when(i == size, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (size + 0.365))
    return r.withColumn("position", pos).withColumn("theoretical", normal_ppf("position")).select(*all_keys, "i", "position", "theoretical", F.col("value").alias("ordered"))


def qq_line(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return points.groupBy(*keys, "y").agg(
        F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"))
